"""Checks measured by one read of a table, beside each by its own; stale descriptions."""

import pytest

from bilens import catalog as C
from bilens.functions import expr as E
from bilens.model import Entity, Field, LegacyTable, Phase, Relationship, Source
from bilens.operators import check, onepass
from bilens.operators.view import modern_view
from bilens.plans import mappings as M
from bilens.sources.tables import frames

STATES = LegacyTable("states", (Field("code", "string", False), Field("title", "string")), ("code",), (("title",),))
ITEMS = LegacyTable(
    "items", (Field("id", "bigint", False), Field("a", "string"), Field("b", "string"), Field("n", "string"), Field("state", "string")), ("id",), (("a", "b"),),
    (Relationship("status", STATES, "state", "code"),),
)


def entity(nulls_distinct=True):
    return Entity(
        "things", (Field("id", "bigint", False), Field("a", "ci_string", False), Field("b", "string"), Field("n", "bigint"), Field("title", "string", False)),
        Source(ITEMS, (M.Key("id", "id"), M.Map("a", source="a"), M.Map("b", source="b"), M.Map("n", source="n"), M.Map("title", source=E.ref("title", "status"), read_only=True, because="joined"))),
        Phase.READ_FROM_LEGACY, (("a", "b"), ("title",)), nulls_distinct=nulls_distinct,
    )


@pytest.fixture(scope="module")
def load(spark):
    items = [(1, "x", None, "1", "on"), (2, None, "x", "one", "on"), (3, "X ", "y", None, "off"), (4, "x", "y", "9" * 30, "gone"), (4, "x", "y", "5", None), (5, None, "x", "6", "on"), (6, "xy", "", "7", "on"), (7, "x", "y", "8", "on")]
    states = [("on", "On"), ("off", "Off"), ("off", "On")]
    return frames(items=spark.createDataFrame(items, "id bigint, a string, b string, n string, state string"), states=spark.createDataFrame(states, "code string, title string"))


@pytest.mark.parametrize("nulls_distinct", [True, False])
def test_together_and_each_alone_say_the_same(spark, load, nulls_distinct):
    e = entity(nulls_distinct)
    reports = [sorted(map(tuple, check.run(spark, e, load, together=t).collect()), key=str) for t in (True, False)]
    assert reports[0] == reports[1]
    said = {(r[0], r[1]): (r[2], r[3]) for r in reports[0]}
    assert said["fan_out", "things"] == ("fail", 1) and said["casts", "n"] == ("fail", 2) and said["nulls", "a"] == ("fail", 2)
    assert said["unique", "items(a, b)"] == ("fail", 1) and said["unique", "states(code)"] == ("fail", 1)
    # x y, X y and x y are one identity; without distinct nulls the two (null, x) are another; (x, null) is not (null, x).
    assert said["identity", "a, b"] == ("fail", 1 if nulls_distinct else 2)


def test_a_table_is_read_once(spark, sf):
    scans = lambda e: onepass.measured(e, C._load(spark, sf))._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans(C.NUMBERED_LINES) == scans(C.GAPPED) == scans(C.BAD_CAST) == 1
    assert scans(C.LABELLED) == 4  # documents; documents and labels joined; labels for its own key


def test_what_stops_all_together_is_found_out_alone(spark, load):
    broken = M.Map("n", source=E.fragment("raise_error(?)", E.ref("n")), read_only=True, because="it fails")
    base = entity()
    e = Entity("things", (*base.attributes[:3], Field("n", "bigint", False), base.attributes[4]), Source(ITEMS, (*base.source.mappings[:3], broken, base.source.mappings[4])), base.phase, base.identities)
    said = {(r["check"], r["subject"]): r["status"] for r in check.run(spark, e, load).collect()}
    assert said["nulls", "things"] == "unrun" and said["identity", "a, b"] == "fail" and said["unique", "items(id)"] == "fail"


def test_a_lost_column_is_a_failure(spark, load):
    items = load.raw(ITEMS)
    stale = frames(items=items.drop("n").withColumn("more", items["id"]), states=load.raw(STATES))
    report = check.run(spark, entity(), stale)
    said = {(r["check"], r["subject"]): (r["status"], r["detail"]) for r in report.collect()}
    assert said["freshness", "items.n"] == ("fail", "no column n") and said["freshness", "items.more"][0] == "warn" and said["freshness", "states"][0] == "ok"
    assert said["nulls", "things"][0] == "unrun" and check.outcome(report) == "fail"


def test_whole_division_is_exact_and_of_the_declared_type(spark):
    table = LegacyTable("t", (Field("k", "bigint", False), Field("n", "bigint"), Field("d", "int"), Field("x", "double")), ("k",))
    q = lambda name, *args: M.Map(name, source=E.call("div", *args), read_only=True, because="computed")
    e = Entity(
        "quotients", tuple(Field(n, t) for n, t in (("k", "bigint"), ("q", "bigint"), ("twice", "bigint"), ("half", "double"))),
        Source(table, (M.Key("k", "k"), q("q", E.ref("n"), E.ref("d")), q("twice", E.call("div", E.ref("n"), 3), E.call("abs", E.ref("d"))), q("half", E.ref("x"), E.ref("d")))),
    )
    rows = [(1, (1 << 53) + 1, 1, 3.0), (2, (1 << 63) - 1, -2, -3.0), (3, -(1 << 63), 1, 1.0), (4, -(1 << 63), -1, 1.0), (5, -7, 2, 1.0), (6, 7, 0, 1.0), (7, None, 3, None), (8, -(1 << 63) + 1, -1, 0.5)]
    got = {r["k"]: (r["q"], r["half"]) for r in modern_view(e, frames(t=spark.createDataFrame(rows, "k bigint, n bigint, d int, x double"))).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: (1 << 53) + 1, 2: -(((1 << 63) - 1) // 2), 3: -(1 << 63), 4: None, 5: -3, 6: None, 7: None, 8: (1 << 63) - 1}
    assert got[1][1] == 3.0 and got[2][1] == 1.5 and got[6][1] is None
