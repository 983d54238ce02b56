"""Views, write-back, checks, reconcile, backfill and change feeds over small tables."""

import glob
import os
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bilens import catalog as C
from bilens.functions import expr as E
from bilens.model import LEGACY_ID, DeclarationError, Entity, Field, LegacyTable, Phase, Relationship, Source
from bilens.operators import backfill, changes, check, reconcile
from bilens.operators.put import WriteRefused, as_upsert, put
from bilens.operators.roundtrip import lost
from bilens.operators.view import find, modern_view, reverse_view
from bilens.plans import mappings as M
from bilens.sources.tables import frames, parquet

ACCOUNTS = LegacyTable(
    "accounts",
    (
        Field("id", "bigint", False), Field("email", "string"), Field("first", "string"), Field("last", "string"), Field("active", "boolean", False, default=True), Field("state", "string", one_of=("on", "off")),
        Field("changed", "timestamp_ntz"), Field("flag", "boolean"), Field("mail_column", "string", column="mailColumn"),
    ),
    ("id",), (("email",),),
)
ROWS = [
    (1, "a@x", "Ann", "Lee", True, "on", datetime(2020, 1, 1), True, "m1"),
    (2, "b@x", "Bo|b", "O'Neil", False, "off", datetime(2020, 1, 2), True, "m2"),
    (3, None, None, "", True, None, None, True, None),
    (4, "É İ ß", "x", "two words", True, "on", datetime(2024, 3, 10, 2, 30), None, "m4"),
]
SCHEMA = "id bigint, email string, first string, last string, active boolean, state string, changed timestamp_ntz, flag boolean, mailColumn string"
PEOPLE = Entity(
    "people", (Field("id", "uuid", False), Field("mail", "string"), Field("name", "string"), Field("inactive", "boolean"), Field("code", "int", minimum=0, maximum=1), Field("seen_at", "timestamp"), Field("loud", "string")),
    Source(ACCOUNTS, (
        M.Key("id", "id", C.NAMESPACE), M.Map("mail", source="email"), M.Concat("name", sources=("first", "last")), M.Negate("inactive", source="active"), M.Decode("code", source="state", values={"on": 1, "off": 0}),
        M.Map("seen_at", source="changed", zone="UTC"), M.Map("loud", source=E.call("upper", E.ref("email")), read_only=True, because="it's derived"),
    ), interlock="flag", notify=True), Phase.DUAL_WRITE, (("mail",),),
)


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def load(accounts):
    return frames(accounts=accounts)


def change(spark, *rows, schema="op string, __legacy_id bigint, mail string, name string, inactive boolean, code int, seen_at timestamp, loud string"):
    return spark.createDataFrame(rows, schema)


def after(result):
    return {r["id"]: r.asDict() for r in result.legacy.collect()}


# --- Views


def test_view(load):
    rows = {r[LEGACY_ID]: r for r in modern_view(PEOPLE, load).collect()}
    assert (rows[2]["name"], rows[2]["inactive"], rows[2]["code"], rows[2]["loud"]) == ("Bo|b O'Neil", True, 0, "B@X")
    assert (rows[3]["name"], rows[3]["code"], rows[3]["mail"]) == (" ", None, None)
    assert modern_view(PEOPLE, load).columns == ["id", LEGACY_ID, "mail", "name", "inactive", "code", "seen_at", "loud"]


def test_a_view_needs_every_attribute_and_no_other(load):
    short = replace(PEOPLE, attributes=(*PEOPLE.attributes, Field("more", "string")))
    with pytest.raises(DeclarationError, match="more"):
        modern_view(short, load)
    with pytest.raises(DeclarationError, match="nothing"):
        modern_view(PEOPLE, load, ["nothing"])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
def test_zones_do_not_depend_on_the_session(spark, load, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        seconds = [r[0] for r in modern_view(PEOPLE, load).orderBy(LEGACY_ID).select(F.unix_timestamp("seen_at")).collect()]
        assert seconds == [1577836800, 1577923200, None, 1710037800]
        timed = replace(PEOPLE, attributes=tuple(a for a in PEOPLE.attributes if a.name in ("id", "seen_at")), source=replace(PEOPLE.source, mappings=tuple(m for m in PEOPLE.source.mappings if m.attribute in ("id", "seen_at"))))
        assert lost(timed, load).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_and_filter_only_what_is_needed(spark, sf):
    load = parquet(spark, sf)
    plan = plan_of(find(C.PLAIN_ORDERS, load, "status_code", 1, ["id"]))
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
    assert "Join" not in plan_of(modern_view(C.PLACES, load, ["id", "priority"]))
    assert plan_of(modern_view(C.PLACES, load)).count("Join") >= 3
    assert "Python" not in plan_of(modern_view(C.MODERN_ORDERS, load))
    assert "EqualTo(c_name" in plan_of(modern_view(C.RENAMED, load).filter("full_name = 'x'"))


def test_joins_keep_rows_and_tell_aliases_apart(spark):
    city = LegacyTable("city", (Field("id", "bigint"), Field("name", "string")))
    person = LegacyTable("person", (Field("id", "bigint"), Field("city_id", "bigint")), relationships=(Relationship("home", city, "city_id", "id"),))
    firm = LegacyTable("firm", (Field("id", "bigint"), Field("city_id", "bigint"), Field("boss_id", "bigint")), relationships=(Relationship("home", city, "city_id", "id"), Relationship("boss", person, "boss_id", "id")))
    e = Entity("f", (Field("id", "bigint"), Field("own", "string"), Field("boss_city", "string")), Source(firm, (M.Key("id", "id"), M.Map("own", source=E.ref("name", "home"), **C.READ), M.Map("boss_city", source=E.ref("name", "boss", "home"), **C.READ))))
    data = frames(
        city=spark.createDataFrame([(1, "Ulm"), (2, "Rom")], "id bigint, name string"), person=spark.createDataFrame([(7, 2)], "id bigint, city_id bigint"),
        firm=spark.createDataFrame([(1, 1, 7), (2, None, None), (3, 9, 8)], "id bigint, city_id bigint, boss_id bigint"),
    )
    assert sorted(map(tuple, modern_view(e, data).select("id", "own", "boss_city").collect())) == [(1, "Ulm", "Rom"), (2, None, None), (3, None, None)]


def test_reverse_view(spark, sf):
    load = parquet(spark, sf)
    back = reverse_view(C.PLAIN_ORDERS, modern_view(C.PLAIN_ORDERS, load).withColumnRenamed(LEGACY_ID, "legacy_id"))
    stored = load(C.ORDERS).select(back.columns)
    assert back.exceptAll(stored).count() == 0 and stored.exceptAll(back).count() == 0
    with pytest.raises(DeclarationError, match="lose"):
        reverse_view(C.DEFAULTED, load(C.LABELS))
    with pytest.raises(DeclarationError, match="lose|joins"):
        reverse_view(C.PLACES, load(C.ORDERS))


# --- Writing


def test_the_key_holds(spark, load):
    row = ("n@x", "Cy Doe", True, 1, datetime(2022, 2, 2), None)
    twice = change(spark, ("update", 1, *row), ("update", 1, *row), ("insert", 2, *row), ("insert", 70, *row), ("insert", 70, *row), ("upsert", 3, *row), ("insert", None, *row))
    said = {(r["legacy_id"], r["message"].partition(": ")[2] or r["message"]) for r in put(PEOPLE, load, twice, validate=False).refused.collect()}
    assert {i for i, _ in said} == {1, 2, 70, 3}
    rows = after(put(PEOPLE, load, twice, validate=False))
    assert len(rows) == put(PEOPLE, load, twice, validate=False).legacy.count() and 70 not in rows
    with pytest.raises(WriteRefused):
        put(PEOPLE, load, twice)
    near = max(rows)
    free = put(PEOPLE, load, change(spark, ("insert", None, *row), ("insert", None, *row), ("insert", near + 1, *row)), validate=False).legacy
    assert free.count() == free.select("id").distinct().count()


def test_updates_inserts_and_deletes(spark, load):
    result = put(PEOPLE, load, change(
        spark,
        ("update", 1, "new@x", "Ann Lee", False, 0, datetime(2021, 5, 5), "A@X"),
        ("delete", 2, None, None, None, None, None, None),
        ("insert", None, "c@x", "Cy Doe", True, 1, datetime(2022, 2, 2), None),
        ("insert", 50, "d@x", "Di Foe", False, None, None, None),
    ))
    rows = after(result)
    assert set(rows) == {1, 3, 4, 5, 50}
    assert (rows[1]["email"], rows[1]["state"], rows[1]["changed"], rows[1]["flag"]) == ("new@x", "off", datetime(2021, 5, 5), False)
    assert (rows[5]["first"], rows[5]["last"], rows[5]["active"], rows[5]["state"], rows[5]["flag"], rows[5]["mail_column"]) == ("Cy", "Doe", False, "on", False, None)
    assert rows[3]["flag"] is True and rows[4]["email"] == "É İ ß" and rows[50]["active"] is True
    assert {(r["legacy_id"], r["op"]) for r in result.events.collect()} == {("1", "update"), ("2", "delete"), ("5", "insert"), ("50", "insert")}
    shown = {r[LEGACY_ID]: r for r in result.returned.collect()}
    assert set(shown) == {1, 5, 50} and shown[1]["loud"] == "NEW@X"


def test_what_is_not_given_stays(spark, load):
    result = put(PEOPLE, load, change(spark, ("update", 4, 0), schema="op string, __legacy_id bigint, code int"))
    row = after(result)[4]
    assert (row["state"], row["email"], row["last"]) == ("off", "É İ ß", "two")
    assert result.changed_columns.first()["n_changed"] == 1


def test_changed_columns_leave_the_others_as_stored(spark, load):
    careful = replace(PEOPLE, source=replace(PEOPLE.source, on_update="changed_columns"))
    row = after(put(careful, load, change(spark, ("update", 4, 0), schema="op string, __legacy_id bigint, code int")))[4]
    assert (row["state"], row["last"]) == ("off", "two words")


def test_refused_writes(spark, load):
    loud = change(spark, ("update", 1, "a@x", "Ann Lee", False, 1, datetime(2020, 1, 1), "OTHER"))
    with pytest.raises(WriteRefused, match="cannot write accounts.loud: it's derived"):
        put(PEOPLE, load, loud)
    put(PEOPLE, load, loud.withColumn("loud", F.lit("A@X")))
    with pytest.raises(WriteRefused, match="no such row"):
        put(PEOPLE, load, change(spark, ("delete", 99, None, None, None, None, None, None)))
    left = put(PEOPLE, load, loud.unionByName(change(spark, ("update", 2, "z@x", "B C", True, 0, None, "B@X"))), validate=False)
    assert after(left)[1]["email"] == "a@x" and after(left)[2]["email"] == "z@x" and left.refused.count() == 1
    with pytest.raises(DeclarationError, match="phase"):
        put(replace(PEOPLE, phase=Phase.READ_FROM_NEW), load, loud)


def test_no_changes(spark, load, accounts):
    result = put(PEOPLE, load, change(spark).limit(0))
    assert result.legacy.count() == accounts.count() and result.events.count() == 0 and result.returned.count() == 0


def test_upsert(spark, load):
    rows = spark.createDataFrame([("a@x", "New Name"), ("n@x", "No One"), (None, "Null Mail")], "mail string, name string")
    result = put(PEOPLE, load, as_upsert(PEOPLE, load, rows, ("mail",)))
    found = after(result)
    assert found[1]["first"] == "New" and len(found) == 6
    with pytest.raises(DeclarationError, match="identity"):
        as_upsert(PEOPLE, load, rows, ("name",))


def test_touch(spark, sf):
    load = parquet(spark, sf)
    view = modern_view(C.TOUCHED, load).limit(5).withColumns({"op": F.lit("update")})
    same = put(C.TOUCHED, load, view, now=C.NOW).legacy
    assert same.filter(f"o_orderdate = TIMESTAMP_NTZ '{C.NOW}'").count() == 0
    other = view.withColumn("urgency", F.when(F.col("urgency") == "rush", "normal").otherwise("rush"))
    assert put(C.TOUCHED, load, other, now=C.NOW).legacy.filter(f"o_orderdate = TIMESTAMP_NTZ '{C.NOW}'").count() == 5


def test_losses_are_over_what_is_stored(load):
    got = {(r[LEGACY_ID], r["column"]) for r in lost(PEOPLE, load).collect()}
    assert got == {(3, "first"), (4, "last")}


# --- Checks


def test_report_and_its_outcome(spark, load):
    report = check.run(spark, PEOPLE, load)
    rows = {(r["check"], r["subject"]): r for r in report.collect()}
    assert rows["nulls", "id"]["status"] == "ok" and rows["identity", "mail"]["status"] == "ok" and rows["unique", "accounts(id)"]["status"] == "ok"
    assert rows["assertion", "name"]["status"] == "warn" and rows["assertion", "name"]["measured"] == 1
    assert check.outcome(report) == "warn"
    no_data = check.run(spark, PEOPLE, load, data=False)
    assert {r["check"] for r in no_data.collect()} <= {"declaration", "obligation"}


def test_a_check_that_cannot_run_stops_no_other(spark, accounts):
    broken = frames(accounts=accounts.drop("first"))
    statuses = {r["status"] for r in check.run(spark, PEOPLE, broken).collect()}
    assert "unrun" in statuses and "ok" in statuses
    # A lost column is a stale description, which fails; a table that is not there cannot be measured.
    assert check.outcome(check.run(spark, PEOPLE, broken)) == "fail"
    gone = check.run(spark, PEOPLE, frames())
    assert check.outcome(gone) == "unrun" and "ok" in {r["status"] for r in gone.collect()}


def test_duplicates_are_of_normal_forms(spark, accounts):
    ci = replace(PEOPLE, attributes=tuple(replace(a, type="ci_string") if a.name == "mail" else a for a in PEOPLE.attributes))
    more = accounts.unionByName(accounts.filter("id = 1").withColumns({"id": F.lit(9).cast("bigint"), "email": F.lit(" A@X ")})).unionByName(accounts.filter("id = 3").withColumn("id", F.lit(10).cast("bigint")))
    assert [tuple(r) for r in check.duplicates(ci, frames(accounts=more), ("mail",)).collect()] == [("a@x", 2)]
    assert check.duplicates(PEOPLE, frames(accounts=more), ("mail",)).count() == 0
    assert check.duplicates(replace(PEOPLE, nulls_distinct=False), frames(accounts=more), ("mail",)).count() == 1


def test_fan_out(spark, sf):
    r = check.fan_out(C.FANNED, parquet(spark, sf)).first()
    assert r["joined_rows"] > r["base_rows"]
    r = check.fan_out(C.LABELLED, parquet(spark, sf)).first()
    assert r["joined_rows"] == r["base_rows"]


def test_declared_but_could_be_written(load):
    shut = replace(PEOPLE, source=replace(PEOPLE.source, mappings=tuple(replace(m, read_only=True, because="later") if m.attribute == "mail" else m for m in PEOPLE.source.mappings)))
    assert any("rename can be taken back" in (d or "") for *_, d in check.declaration(shut))


# --- Reconcile


def perturbed(df, kind):
    one = F.col(LEGACY_ID) == 2
    return {
        "same": df, "value": df.withColumn("name", F.when(one, "x").otherwise(F.col("name"))), "null": df.withColumn("mail", F.when(one, F.lit(None)).otherwise(F.col("mail"))),
        "missing": df.filter(~one), "extra": df.unionByName(df.filter(one).withColumn(LEGACY_ID, F.lit(77).cast("bigint"))),
        "empty_for_null": df.withColumn("mail", F.coalesce("mail", F.lit(""))), "word_for_null": df.withColumn("mail", F.coalesce("mail", F.lit("NULL"))),
        "moved_separator": df.withColumn("mail", F.when(one, "b@x'|'Bo").otherwise(F.col("mail"))),
        "swapped_keys": df.withColumn(LEGACY_ID, F.when(F.col(LEGACY_ID) == 1, 2).when(one, 1).otherwise(F.col(LEGACY_ID))),
    }[kind]


@pytest.mark.parametrize("kind", ["same", "value", "null", "missing", "extra", "empty_for_null", "word_for_null", "moved_separator", "swapped_keys"])
@pytest.mark.parametrize("ordered", [False, True])
def test_checksums_see_every_change(load, kind, ordered):
    modern = perturbed(modern_view(PEOPLE, load), kind)
    pair = reconcile.plan(PEOPLE, load, modern)
    agrees = reconcile.checksums(pair, 2, ordered).filter("NOT agrees").count() == 0
    assert agrees == (kind == "same") == (reconcile.mismatched(pair).count() == 0)
    assert reconcile.diff(pair, 1000, pin=ordered).agrees == (kind == "same")


def test_normalizers(load):
    modern = modern_view(PEOPLE, load).withColumn("mail", F.upper("mail"))
    assert reconcile.mismatched(reconcile.plan(PEOPLE, load, modern)).count() > 0
    assert reconcile.mismatched(reconcile.plan(PEOPLE, load, modern, {"mail": "downcase"}, only=["mail"])).filter(f"{LEGACY_ID} < 4").count() == 0
    assert reconcile.mismatched(reconcile.plan(PEOPLE, load, modern, {"mail": lambda c: F.lit(1)}, only=["mail"])).count() == 0
    with pytest.raises(DeclarationError, match="unknown normalizer"):
        reconcile.plan(PEOPLE, load, modern, {"mail": "shout"})
    pair = reconcile.plan(PEOPLE, load, modern)
    assert "loud" in pair.columns and "id" not in pair.columns


# --- Backfill


def test_backfill_fills_once_and_resumes(spark):
    df = spark.range(1, 26).select(F.col("id"), F.lit(0).alias("counter"))
    table = LegacyTable("widgets", (Field("id", "bigint", False), Field("counter", "int")), ("id",))
    e = Entity("w", (Field("id", "bigint", False),), Source(table, (M.Key("id", "id"),)))
    fill = backfill.plan(e, overrides={"counter": F.col("counter") + 1, "tenant": F.lit("t")})
    seen = []
    one = backfill.run(df, fill, batch_size=10, max_batches=1, progress=lambda n, total: seen.append((n, total)))
    assert (one.rows, one.batches, one.complete, seen) == (9, 1, False, [(9, 25)])
    two = backfill.run(one.table, fill, batch_size=10)
    assert (two.rows, two.batches, two.complete) == (16, 2, True)
    assert two.table.agg(F.sum("counter"), F.count_if(F.col("tenant") == "t"), F.count_if(F.col(backfill.FLAG))).first()[:] == (25, 25, 0)
    again = backfill.run(two.table, fill)
    assert (again.rows, again.passes) == (0, 0)
    assert backfill.drop_flag(again.table).columns == ["id", "counter", "tenant"]
    late = backfill.run(df, fill, again=lambda t: t if t.filter("id = 3 AND counter = 1").isEmpty() else t.withColumn(backfill.FLAG, F.col("id") == 3))
    assert late.passes == 2 and late.table.filter("id = 3").first()["counter"] == 2
    with pytest.raises(RuntimeError, match="stay flagged"):
        backfill.run(df, fill, again=lambda t: t.withColumn(backfill.FLAG, F.lit(True)))


def test_backfill_plans(spark, load):
    fill = backfill.plan(PEOPLE, store_key="public_id")
    assert (fill.relation, fill.key, list(fill.set)) == ("accounts", "id", ["public_id"])
    filled = backfill.run(backfill.add_flag(load(ACCOUNTS)), fill).table
    assert {r["public_id"] for r in filled.collect()} == {r["id"] for r in modern_view(PEOPLE, load).collect()}
    for bad in ({"store_key": "no name"}, {"overrides": {"x": "sql"}}, {}, {"overrides": {backfill.FLAG: F.lit(1)}}):
        with pytest.raises(DeclarationError):
            backfill.plan(PEOPLE, **bad)


# --- Changes


def test_change_events(spark, accounts, load):
    later = accounts.filter("id <> 1").withColumn("email", F.when(F.col("id") == 2, "n@x").otherwise(F.col("email"))).unionByName(accounts.filter("id = 4").withColumn("id", F.lit(8).cast("bigint")))
    events = changes.diff(PEOPLE, accounts, later, "id")
    assert {(r["legacy_id"], r["op"]) for r in events.collect()} == {("1", "delete"), ("2", "update"), ("8", "insert")}
    rows = {r[LEGACY_ID]: r for r in changes.reread(PEOPLE, frames(accounts=later), events.unionByName(events)).collect()}
    assert rows[1]["mail"] is None and rows[2]["mail"] == "n@x" and rows[8]["action"] == "legacy_write" and len(rows) == 3
    assert changes.emits(PEOPLE) and not changes.emits(replace(PEOPLE, phase=Phase.READ_FROM_NEW)) and changes.channel(PEOPLE) == changes.DEFAULT_CHANNEL


def test_bad_lines_stop_nothing(spark, tmp_path, load):
    from bilens.streaming.listen import follow, lines

    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "a.json").write_text('{"resource":"people","legacy_id":"2","op":"update"}\n' * 2 + '{bad\n\n{"resource":"other","legacy_id":"1","op":"update"}\n{"resource":"people","legacy_id":"x","op":"update"}\n{"resource":"people","legacy_id":"9","op":"drop"}\n{"resource":"people","legacy_id":"77","op":"delete"}\n')
    got, bad = [], []
    follow(lines(spark, str(feed)), [PEOPLE], load, lambda e, df: got.extend(df.collect()), str(tmp_path / "c"), lambda df: bad.extend(r[0] for r in df.collect())).awaitTermination()
    assert sorted((r["op"], r[LEGACY_ID], r["mail"]) for r in got) == [("delete", 77, None), ("update", 2, "b@x")]
    assert len(bad) >= 3 and any("{bad" in x for x in bad)


# --- Registered queries


def test_sql_says_the_same(spark, sf):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    oracle = C.oracle_sql()
    for name, query in C.queries().items():
        df = query(spark, sf)
        rows = df.collect()
        if name in oracle:
            result = con.execute(oracle[name])
            columns = [c[0] for c in result.description]
            assert sorted(columns) == sorted(df.columns), name
            assert sorted(str(tuple(map(str, r))) for r in result.fetchall()) == sorted(str(tuple(str(r[c]) for c in columns)) for r in rows), name


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
