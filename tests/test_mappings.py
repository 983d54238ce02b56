"""Declarations, lenses, proofs and refusals: no data needed but for compiled expressions."""

import itertools
import uuid
from dataclasses import replace
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bilens import catalog as C
from bilens.functions import expr as E
from bilens.functions.compile import bare, compile, literal
from bilens.functions.keys import uuid5_column, uuid5_value
from bilens.model import DeclarationError, Entity, Field, LegacyTable, Phase, Relationship, Source, spark_type, storage_type
from bilens.plans import diagram, info, lineage, mechanism, migration, obligations
from bilens.plans import mappings as M
from bilens.plans.lens import inverse_literal, lenses
from bilens.plans.verify import ORDER, Refused, refusals, verify
from bilens.sources.tables import check_domain, describe, frames, observed_domain, render

USERS = LegacyTable(
    "users",
    (
        Field("id", "bigint", False), Field("login", "string", False), Field("email", "string"), Field("first", "string"), Field("last", "string"),
        Field("state", "string", False, one_of=("passive", "pending", "active")), Field("born", "timestamp_ntz"), Field("gone", "boolean"), Field("paid", "boolean", False), Field("cents", "bigint"),
    ),
    ("id",), (("login",),),
)


def entity(*mappings, attributes=None, table=USERS, **options):
    names = {m.attribute: m for m in mappings}
    given = {a.name: a for a in attributes or []}
    fields = tuple(given.get(n, Field(n, "string")) for n in names)
    key = () if any(isinstance(m, M.Key) for m in mappings) else (M.Key("id", "id"),)
    fields = (*fields, *((Field("id", "bigint", False),) if key else ()))
    source_options = {k: options.pop(k) for k in ("writes", "on_update", "notify", "interlock") if k in options}
    return Entity("people", fields, Source(table, (*mappings, *key), **source_options), **options)


def refused(e, verifier, text):
    with pytest.raises(Refused) as caught:
        verify(e)
    assert caught.value.verifier == verifier and text in str(caught.value)


# --- The language


def value(spark, node, **columns):
    df = spark.createDataFrame([tuple(v for v in columns.values()) or (1,)], ", ".join(f"{k} {t}" for k, t in types(columns)) or "x int")
    return df.select(compile(node, bare(now="2024-05-06 07:08:09")).alias("v")).first()["v"]


def types(columns):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", Decimal: "decimal(12,2)", datetime: "timestamp_ntz", type(None): "string"}
    return [(k, kinds[type(v)]) for k, v in columns.items()]


@pytest.mark.parametrize(
    ("node", "columns", "expected"),
    [
        (E.call("and", E.Lit(True), E.call("eq", E.ref("a"), 1)), {"a": 1}, True),
        (E.call("or", E.call("eq", E.ref("a"), 2), E.call("ne", E.ref("a"), 2)), {"a": 1}, True),
        (E.call("not", E.call("is_null", E.ref("a"))), {"a": None}, False),
        (E.call("eq", E.ref("a"), None), {"a": None}, True),
        (E.call("ne", E.ref("a"), None), {"a": "x"}, True),
        (E.call("lt", E.ref("a"), 2), {"a": 1}, True),
        (E.call("add", E.call("mul", E.ref("a"), 3), E.call("neg", E.call("sub", E.ref("a"), 1))), {"a": 5}, 11),
        (E.call("div", E.ref("a"), 0), {"a": 5}, None),
        (E.call("in", E.ref("a"), "x", "y"), {"a": "y"}, True),
        (E.call("join", E.ref("a"), E.ref("b")), {"a": "x", "b": None}, None),
        (E.call("coalesce", E.ref("a"), "d"), {"a": None}, "d"),
        (E.call("trim", E.call("lower", E.ref("a"))), {"a": " Ab\t "}, "ab\t"),
        (E.call("length", E.call("upper", E.ref("a"))), {"a": "é🙂"}, 2),
        (E.call("least", E.ref("a"), E.ref("b")), {"a": 3, "b": 2}, 2),
        (E.call("greatest", E.call("abs", E.ref("a")), 1), {"a": -7}, 7),
        (E.call("ceil", E.ref("a")), {"a": 1.2}, 2),
        (E.call("list", E.ref("a"), 2), {"a": 1}, [1, 2]),
        (E.if_(True, "x", "y"), {}, "x"),
        (E.when((E.call("eq", E.ref("a"), 1), "one"), (E.call("eq", E.ref("a"), 2), "two"), default="many"), {"a": 2}, "two"),
        (E.Case(E.ref("a"), ((1, "one"), (2, "two"))), {"a": 3}, None),
        (E.Cast(E.ref("a"), "int"), {"a": "12"}, 12),
        (E.fragment("concat(?, '-', ?, ?)", E.ref("a"), E.Lit("it's \\ é"), E.Lit(7)), {"a": "x"}, "x-it's \\ é7"),
        (E.call("now"), {}, datetime(2024, 5, 6, 7, 8, 9)),
    ],
)
def test_compiled_values(spark, node, columns, expected):
    assert value(spark, node, **columns) == expected


def test_unknown_calls_and_literals_are_refused_by_name(spark):
    for op in ("exists", "concat", "regexp"):
        with pytest.raises(DeclarationError, match=op):
            E.call(op, 1)
    for bad in ("a\0b", Decimal("NaN"), float("inf"), object()):
        with pytest.raises(DeclarationError):
            literal(bad)
    with pytest.raises(DeclarationError, match="places"):
        E.fragment("f(?)", 1, 2)
    with pytest.raises(DeclarationError, match="exists"):
        compile(E.Exists(("a",), E.ref("b")), bare())
    with pytest.raises(DeclarationError, match="behind a join"):
        compile(E.ref("b", "a"), bare())


def test_walks():
    node = E.when((E.call("eq", E.ref("a"), E.ref("b", "p")), E.ref("a")), default=E.fragment("f(?)", E.ref("c")))
    assert E.refs(node) == [E.ref("a"), E.ref("b", "p"), E.ref("c")] and E.opaque(node)
    assert E.reduce(node, 0, lambda n, x: n + isinstance(x, E.Ref)) == 4
    assert E.refs(E.Exists(("kids",), E.call("eq", E.ref("age"), 1))) == [E.ref("age", "kids")]
    assert E.rewrite(node, lambda n: E.ref("z") if n == E.ref("a") else n) != node
    assert E.simple_reference(E.ref("a")) and not E.simple_reference(node)


def test_three_valued_evaluation_agrees_with_the_engine(spark):
    a, b = E.ref("a"), E.ref("b")
    nodes = [E.call("and", a, b), E.call("or", a, E.call("not", b)), E.call("eq", a, b), E.call("is_null", a), E.call("in", a, True, None), E.when((a, True), (b, False)), E.call("coalesce", a, b)]
    cases = list(itertools.product([True, False, None], repeat=2))
    df = spark.createDataFrame(cases, "a boolean, b boolean")
    rows = df.select("a", "b", *[compile(n, bare()).alias(f"v{k}") for k, n in enumerate(nodes)]).collect()
    for r in rows:
        for k, n in enumerate(nodes):
            assert E.evaluate(n, {a: r["a"], b: r["b"]}) == r[f"v{k}"], (n, r)


def test_types():
    assert storage_type("int") == storage_type("bigint") and storage_type("array<int>") == "array<bigint>"
    assert spark_type("ci_string") == "string" and spark_type("array<uuid>") == "array<string>"
    with pytest.raises(DeclarationError, match="interval"):
        storage_type("interval")


# --- Keys


def test_derived_keys_are_version_five_uuids(spark):
    ids = [1, 42, 10**15, None]
    df = spark.createDataFrame([(i,) for i in ids], "k bigint").select("k", uuid5_column(C.NAMESPACE, "naïve", F.col("k")).alias("id"))
    for r in df.collect():
        assert r["id"] == (None if r["k"] is None else str(uuid.uuid5(uuid.UUID(C.NAMESPACE), f"naïve:{r['k']}")))
    assert uuid5_value(C.NAMESPACE, "t", 1) == str(uuid.uuid5(uuid.UUID(C.NAMESPACE), "t:1"))
    dns = uuid.uuid5(uuid.NAMESPACE_DNS, "www.example.com:1")
    assert uuid5_value(str(uuid.NAMESPACE_DNS), "www.example.com", 1) == str(dns)


# --- Lenses


def lens(mapping, attribute=None, **kw):
    return lenses(entity(mapping, attributes=[attribute] if attribute else None, **kw))[mapping.attribute]


def test_lens_kinds():
    rename = lens(M.Map("mail", source="email"))
    assert (rename.combinator, rename.invertible, rename.kind, rename.writes) == ("rename", "yes", "identity", (("email", E.ref("mail")),))
    assert lens(M.Map("n", source="cents"), Field("n", "int")).combinator == "rename"
    assert (lens(M.Map("n", source="cents")).combinator, lens(M.Map("n", source="cents")).invertible) == ("cast", "yes")
    assert lens(M.Map("n", source="login"), Field("n", "bigint")).invertible == "semi"
    assert lens(M.Map("t", source="born", zone="UTC"), Field("t", "timestamp")).combinator == "zone"
    free = lens(M.Map("x", source=E.call("lower", E.ref("login"))))
    assert (free.kind, free.invertible, free.writes) == ("masked", "no", ())
    assert lens(M.Map("x", source=E.fragment("f(?)", E.ref("login")))).opaque
    shut = lens(M.Map("mail", source="email", read_only=True, because="it's kept"))
    assert (shut.writes, shut.kind, shut.because) == ((), "masked", "it's kept")
    assert lens(M.Unmapped("x", because="new")).kind == "structural"
    two = lens(M.Concat("name", sources=("first", "last")))
    assert [c for c, _ in two.writes] == ["first", "last"] and two.invertible == "semi"
    assert lens(M.Negate("here", source="gone"), Field("here", "boolean")).invertible == "yes"
    assert lens(M.Affine("n", source="cents", multiply=-1, add=5), Field("n", "bigint")).invertible == "yes"
    assert lens(M.Affine("n", source="cents", multiply=3), Field("n", "bigint")).invertible == "semi"


def test_sql_text_is_refused_with_what_to_use():
    with pytest.raises(DeclarationError, match=r"ref\(\).*call\(\).*fragment\(\)"):
        M.Map("x", source="lower(email)")
    assert M.Constant("x", value="any text (at all)").value == E.Lit("any text (at all)")


@pytest.mark.parametrize(
    "make",
    [
        lambda: M.Unmapped("x"), lambda: M.Unmapped("x", as_="zero", because="y"), lambda: M.Affine("x", source="cents", multiply=0), lambda: M.Concat("x", sources=("a",), separator=""),
        lambda: M.Default("x", source="a"), lambda: M.Decode("x", source="a"), lambda: M.Collapse("x"),
        lambda: M.Collapse("x", clauses=(M.Clause(1, M.OTHERWISE), M.Clause(2, E.Lit(True)))),
        lambda: M.Collapse("x", clauses=(M.Clause(1, E.Lit(True), {"a": 1}), M.Clause(2, M.OTHERWISE, {"b": 1}))),
        lambda: M.Collapse("x", clauses=(M.Clause(1, E.Lit(True)),), hit_policy="any"),
    ],
)
def test_malformed_mappings(make):
    with pytest.raises(DeclarationError):
        make()


def test_inverse_literals_only_for_bijections():
    by = lambda e, a: lenses(e)[a]
    assert inverse_literal(by(C.PLAIN_ORDERS, "status_code"), 1) == ("o_orderstatus", "F")
    assert inverse_literal(by(C.PLAIN_ORDERS, "status_code"), 9) is None
    assert inverse_literal(by(C.NEGATED, "clean"), True) == ("toxic", False)
    assert inverse_literal(by(C.CENTS, "cents"), Decimal(125)) == ("price", Decimal("1.25"))
    assert inverse_literal(by(C.DEFAULTED, "quality"), 1) is None


# --- Proofs


def found(e, obligation):
    return [f for f in obligations.check(e) if f.obligation == obligation]


STATE = Field("s", "int", False, minimum=0, maximum=2)
ALL = {"passive": 0, "pending": 1, "active": 2}


def test_a_total_bijective_decode_has_no_findings():
    assert obligations.check(entity(M.Decode("s", source="state", values=ALL), attributes=[STATE])) == []


@pytest.mark.parametrize(
    ("mapping", "attribute", "obligation", "text"),
    [
        (M.Decode("s", source="state", values={"passive": 0, "pending": 1}), Field("s", "int", minimum=0, maximum=1), "get_total", "'active'"),
        (M.Decode("s", source="state", values=ALL), Field("s", "int", minimum=0, maximum=3), "put_total", "3"),
        (M.Decode("s", source="state", values=ALL), Field("s", "int"), "put_total", "not listed"),
        (M.Decode("s", source="state", values=ALL | {"pending": 0}), Field("s", "int", minimum=0, maximum=2), "put_get", "'passive' and 'pending'"),
        (M.Decode("s", source="state", values=ALL), Field("s", "string", one_of=("0",)), "type_agreement", "string"),
        (M.Decode("s", source="state", values={k: k for k in ALL}), Field("s", "string", one_of=tuple(ALL)), "redundancy", "use Map"),
        (M.Affine("n", source="cents"), Field("n", "bigint"), "redundancy", "use Map"),
        (M.Concat("n", sources=("first",)), None, "redundancy", "use Map"),
    ],
)
def test_obligations_that_fail(mapping, attribute, obligation, text):
    hits = found(entity(mapping, attributes=[attribute] if attribute else None), obligation)
    assert hits and hits[0].severity == "error" and text in hits[0].message


def clauses(*pairs, **kw):
    return entity(M.Collapse("s", clauses=tuple(M.Clause(v, g, {"gone": None, "paid": True}) for v, g in pairs), **kw), attributes=[Field("s", "string", one_of=tuple(v for v, _ in pairs))])


GONE, PAID = E.ref("gone"), E.ref("paid")


def test_a_nullable_guard_leaves_a_gap_that_two_valued_logic_would_miss():
    gap = clauses(("a", GONE), ("b", E.call("not", GONE)))
    assert "gone=None" in found(gap, "completeness")[0].message
    closed = clauses(("a", PAID), ("b", E.call("not", PAID)))
    assert not found(closed, "completeness")
    shut = clauses(("a", GONE), ("b", E.call("not", GONE)), ("c", E.call("is_null", GONE)))
    assert not found(shut, "completeness")


def test_collapse_findings():
    assert "'b' is never reached" in found(clauses(("a", PAID), ("b", E.call("and", PAID, GONE)), ("c", M.OTHERWISE)), "masked_rule")[0].message
    over = found(clauses(("a", PAID), ("b", GONE), ("c", M.OTHERWISE), hit_policy="unique"), "non_overlap")
    assert over[0].severity == "warning" and over[0].assertion is not None
    assert not found(clauses(("a", PAID), ("b", E.call("not", PAID)), hit_policy="unique"), "non_overlap")
    unknown = clauses(("a", E.fragment("f(?)", GONE)), ("b", M.OTHERWISE))
    assert found(unknown, "guards")[0].severity == "warning"
    missing = replace(clauses(("a", PAID), ("b", M.OTHERWISE)), attributes=(Field("s", "string", one_of=("a", "b", "z")), Field("id", "bigint", False)))
    assert "'z'" in found(missing, "surjectivity")[0].message
    text = clauses(("a", E.call("lt", E.ref("cents"), 5)), ("b", E.call("is_null", E.ref("login"))))
    assert "unknown" in found(text, "completeness")[0].message


def test_measured_obligations(spark):
    df = spark.createDataFrame([(1, "x y", "a", None), (2, "b", None, 0), (3, "b", "c", 5)], "id bigint, first string, last string, cents bigint").select("*", *[F.lit(None).cast("string").alias(c) for c in ("login", "email")], F.lit("odd").alias("state"), F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(None).cast("boolean").alias("gone"), F.lit(True).alias("paid"))
    from bilens.operators.check import violations

    e = entity(M.Concat("name", sources=("first", "last")), M.Default("n", source="cents", default=0), M.Decode("s", source="state", values=ALL), attributes=[Field("n", "bigint"), STATE])
    got = {f.obligation: sorted(r["id"] for r in violations(e, frames(users=df), f).collect()) for f in obligations.assertions(e)}
    assert got == {"get_put_concat": [1], "get_put_coalesce": [2]}
    open_ = replace(USERS, fields=tuple(replace(f, one_of=None) if f.name == "state" else f for f in USERS.fields))
    e = entity(M.Decode("s", source="state", values=ALL), attributes=[STATE], table=open_)
    f = found(e, "get_total")[0]
    assert f.severity == "warning" and violations(e, frames(users=df), f).count() == 3


def test_one_writer_for_a_column():
    hits = found(entity(M.Map("a", source="email"), M.Map("b", source="email")), "linearity")
    assert "a and b" in hits[0].message


# --- Refusals, each beside what is accepted


def test_all_demonstrations_are_accepted():
    for e in C.ENTITIES:
        assert refusals(e) == [], e.name


def test_refusals():
    ok = M.Map("mail", source="email")
    verify(entity(ok))
    refused(entity(M.Map("x", source="nothing")), "legacy_table", "no column 'nothing'")
    many = USERS.with_relationships(Relationship("orders", C.ORDERS, "id", "o_custkey", many=True))
    refused(entity(M.Map("x", source=E.ref("o_orderpriority", "orders"), **C.READ), table=many), "legacy_table", "to-many")
    half = entity(ok)
    refused(replace(half, attributes=(*half.attributes, Field("extra", "string"))), "complete_mapping", "extra")
    verify(replace(half, attributes=(*half.attributes, Field("extra", "string", private=True))))
    refused(entity(M.Concat("x", sources=("first",))), "not_redundant", "use Map")
    refused(entity(M.Map("t", source="born"), attributes=[Field("t", "timestamp")]), "timestamp_zones", "zone=")
    verify(entity(M.Map("t", source="born", zone="UTC"), attributes=[Field("t", "timestamp")]))
    refused(entity(M.Map("x", source=E.call("lower", E.ref("email")))), "derived_writability", "read_only=True")
    refused(entity(M.Map("x", source="email", read_only=True)), "derived_writability", "because")
    refused(entity(M.Map("x", source="email", because="why")), "derived_writability", "is not")
    one = USERS.with_relationships(Relationship("order", C.ORDERS, "id", "o_custkey"))
    refused(entity(M.Map("x", source=E.ref("o_orderpriority", "order")), table=one), "joined_writes", "through a join")
    refused(entity(M.Decode("s", source="state", values={"active": 1}), attributes=[STATE]), "proofs", "get_total")
    decoded = M.Decode("s", source="state", values=ALL)
    refused(entity(decoded, attributes=[STATE], upserts=True), "no_upserts", "upserts")
    verify(entity(ok, upserts=True))
    refused(entity(M.Default("x", source="email", default="-"), phase=Phase.READ_FROM_NEW), "reverse_mappable", "loses")
    verify(entity(ok, phase=Phase.READ_FROM_NEW))
    refused(entity(ok, identities=(("mail",),)), "identities_backed", "no unique set")
    verify(entity(M.Map("handle", source="login"), identities=(("handle",),)))
    with pytest.raises(DeclarationError, match="exactly one key"):
        verify(Entity("x", (Field("mail", "string"),), Source(USERS, (ok,))))
    assert len(ORDER) == 11


def test_zone_on_an_expression_is_refused():
    with pytest.raises(DeclarationError, match="plain column"):
        lenses(entity(M.Map("t", source=E.call("now"), zone="UTC")))


# --- Mechanism, lineage, diagrams, plans


def test_mechanism():
    assert mechanism.of_entity(entity(M.Map("mail", source="email"))) == "plain"
    assert mechanism.of_entity(entity(M.Decode("s", source="state", values=ALL), attributes=[STATE])) == "instead_of"
    assert mechanism.writes(C.PLACES) == "triggers" and mechanism.writes(entity(M.Map("mail", source="email"))) == "auto"
    assert mechanism.writes(entity(M.Map("mail", source="email"), writes="none")) == "none"
    assert dict((a, (i, e)) for a, i, e in mechanism.report(C.TOUCHED))["urgency"] == ("instead_of", "instead_of")


def test_lineage_and_its_facet():
    edges = {(e.from_column, e.type, e.subtype) for e in lineage.edges(C.LIFECYCLE) if e.to_attribute == "lifecycle"}
    assert edges == {("l_returnflag", "INDIRECT", "CONDITIONAL"), ("l_linestatus", "INDIRECT", "CONDITIONAL")}
    facet = lineage.facet(C.CONSTANTS, "ns")
    assert facet["fields"]["tenant"] == {"inputFields": []}
    assert facet["fields"]["name"]["inputFields"][0]["transformations"][0]["subtype"] == "IDENTITY"
    assert '"columnLineage"' in lineage.encode(lineage.datasets([C.PLACES, C.CONSTANTS], "ns"))
    assert lineage.summary(C.PLACES)["INDIRECT JOIN"] == 12
    assert lineage.shortened("one two three", 8) == "one two…" and lineage.shortened("short") == "short"


def test_diagrams(tmp_path):
    text = diagram.mapping(C.MODERN_ORDERS)
    assert text.startswith("flowchart LR\n") and "<==>" in text and "decode F→1, O→0, P→2" in text
    assert "plain columns" in diagram.mapping(C.RENAMED) and "plain columns" not in diagram.mapping(C.RENAMED, verbose=True)
    assert "5 attributes, 1 only read" in diagram.overview(C.ENTITIES)
    diagram.write(str(tmp_path / "m.md"), text)
    assert "```mermaid" in (tmp_path / "m.md").read_text()


def test_migration_steps(spark):
    region = spark.createDataFrame([(1, "EUROPE")], "r_regionkey int, r_name string")
    todo = migration.plan([C.CONSTANTS, C.CONSTANTS], frames(region=region), database="bilens_test")
    assert [s.name for s in todo] == ["database bilens_test", "view stamped_regions"]
    migration.apply(spark, todo)
    assert spark.table("stamped_regions").first()["tenant"] == "main"
    migration.undo(spark, todo)
    assert not spark.catalog.tableExists("stamped_regions") and not spark.catalog.databaseExists("bilens_test")
    migration.declare(C.CONSTANTS)
    assert migration.declared() == [C.CONSTANTS]
    gone = replace(C.CONSTANTS, phase=Phase.DECOMMISSIONED)
    assert migration.steps(gone, frames(region=region)) == []


# --- Describing tables


def test_descriptions(spark):
    df = spark.createDataFrame([(1, "a", None, 1)], "id bigint, kind string, odd map<string,int>, plan_id bigint")
    plans = LegacyTable("plans", (Field("id", "bigint"),))
    table, left = describe(df, "things", ["id"], [["kind"], ["odd"], ["id"]], {"kind": ("a", "b")}, {"plan_id": (plans, "id")})
    assert left == ["odd"] and table.uniques == (("kind",),) and table.relationship("plan").target is plans
    assert table.field("kind").domain() == ("a", "b")
    scope = {"LegacyTable": LegacyTable, "Field": Field, "Relationship": Relationship, "PLANS": plans}
    exec(render(table), scope)
    assert scope["THINGS"] == table
    assert observed_domain(df, "kind") == ("a",) and observed_domain(df.union(df.withColumn("kind", F.lit("z"))), "kind", limit=1) is None


@pytest.mark.parametrize(
    ("clause", "expected"),
    [
        ("CHECK ((state = ANY (ARRAY['a'::text, 'b''c'::text])))", ("state", ("a", "b'c"))), ("CHECK (kind = 'x')", ("kind", ("x",))), ("kind IN ('x', 'y')", ("kind", ("x", "y"))),
        ("CHECK (n > 5)", None), ("CHECK (a = 'x' OR b = 'y')", None),
    ],
)
def test_check_clauses(clause, expected):
    assert check_domain(clause) == expected


def test_introspection(spark, sf):
    from bilens.sources.tables import parquet

    assert info.bound(C.PLACES) and info.relation(C.PLACES) == "orders" and info.primary_alias() == "legacy"
    assert info.joins(C.PLACES) == [("customer",), ("customer", "nation"), ("customer", "nation", "region")]
    assert info.join_aliases(C.PLACES)["customer", "nation"] == "legacy__customer__nation"
    assert [m.attribute for m in info.mappings(C.CONSTANTS)] == ["name"] and len(info.constants(C.CONSTANTS)) == 1 and len(info.unmapped(C.CONSTANTS)) == 2
    assert info.accounted_for(C.CONSTANTS) == {"id", "name", "tenant", "note", "visits"}
    assert (info.writes(C.PLACES), info.on_update(C.EDIT_ORDERS), info.notifies(C.MODERN_ORDERS), info.interlocked(C.PLACES)) == ("triggers", "changed_columns", True, False)
    assert info.channel(C.MODERN_ORDERS) == info.DEFAULT_CHANNEL
    schema = info.view_schema(C.MODERN_ORDERS, parquet(spark, sf))
    assert {f.name: f.dataType.simpleString() for f in schema} == info.declared_schema(C.MODERN_ORDERS)
