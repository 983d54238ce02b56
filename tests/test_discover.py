"""Keys, unique sets and references found in data."""

import random
from itertools import combinations

import pytest

from bilens import catalog as C
from bilens.model import Field, LegacyTable
from bilens.sources import discover
from bilens.sources.tables import frames


def brute(rows, names, most):
    found = []
    for level in range(1, most + 1):
        for s in combinations(range(len(names)), level):
            values = [tuple(r[i] for i in s) for r in rows]
            whole = [v for v in values if None not in v]
            if whole and len(set(whole)) == len(whole) and not any(set(f) <= set(s) for f, _ in found):
                found.append((s, len(whole) < len(rows)))
    return {(tuple(names[i] for i in s), nulls) for s, nulls in found}


@pytest.mark.parametrize("seed", range(3))
def test_the_smallest_unique_sets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, i // 5, i % 5, rng.randrange(40), None if i % 9 else f"u{i}", rng.choice("ab"), i // 25, (i // 5) % 5) for i in range(1000)]
    names = ["id", "group", "place", "some", "rare", "two", "block", "part"]
    df = spark.createDataFrame(rows, "id bigint, group bigint, place int, some int, rare string, two string, block bigint, part bigint")
    for most in (1, 2, 3):
        assert {(u.columns, u.nulls) for u in discover.unique_sets(df, most)} == brute(rows, names, most)


def test_nothing_is_observed_where_there_is_nothing(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    assert discover.unique_sets(df) == []
    nulls = spark.createDataFrame([(None, 1), (None, 1)], "a bigint, b bigint")
    assert discover.unique_sets(nulls, 2) == []


def test_references_by_all_values(spark):
    people = LegacyTable("people", (Field("p_id", "bigint", False), Field("name", "string"), Field("boss_id", "int")), ("p_id",))
    desks = LegacyTable("desks", (Field("d_id", "bigint", False), Field("o_id", "bigint"), Field("label", "string"), Field("none", "bigint")), ("d_id",))
    load = frames(
        people=spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "p_id bigint, name string, boss_id int"),
        desks=spark.createDataFrame([(10, 1, "a", None), (11, 3, "c", None), (12, None, "c", None), (3, 4, "z", None)], "d_id bigint, o_id bigint, label string, none bigint"),
    )
    found = discover.references(load, [people, desks], {"people": ["p_id", "name"], "desks": ["d_id"]})
    assert {(r.table, r.column, r.target, r.key, r.n_values, r.n_keys) for r in found} == {("people", "boss_id", "people", "p_id", 1, 3)}
    held = frames(people=load.raw(people), desks=load.raw(desks).filter("d_id > 9"))
    found = discover.references(held, [people, desks], {"people": ["p_id", "name"], "desks": ["d_id"]})
    assert {(r.table, r.column, r.target, r.key) for r in found} == {("people", "boss_id", "people", "p_id"), ("desks", "o_id", "people", "p_id"), ("desks", "label", "people", "name")}


def test_more_keys_than_one_number_has_bits(spark, monkeypatch):
    monkeypatch.setattr(discover, "MOST_BITS", 2)
    tables = [LegacyTable(f"t{k}", (Field("id", "bigint", False),), ("id",)) for k in range(5)]
    load = frames(**{f"t{k}": spark.range(k, 5) for k in range(5)})
    found = discover.references(load, tables, {t.name: ["id"] for t in tables})
    assert {(r.table, r.target) for r in found} == {(f"t{a}", f"t{b}") for a in range(5) for b in range(5) if a > b}


def test_the_demonstration_tables(spark, sf):
    load = C._load(spark, sf)
    sets = {t.name: discover.unique_sets(load(t), 2, t.names()) for t in (C.CUSTOMER, C.ORDERS)}
    bare = LegacyTable("orders", C.ORDERS.fields)
    ways = discover.likely(discover.references(load, [C.CUSTOMER, C.ORDERS], {"customer": ["c_custkey"], "orders": ["o_orderkey"]}))
    made = discover.described(bare, sets["orders"], ways, {"customer": C.CUSTOMER})
    assert made.primary_key == ("o_orderkey",) and [(r.target.name, r.source_field, r.target_field) for r in made.relationships] == [("customer", "o_custkey", "c_custkey")]
    assert discover.Unique(("c_custkey",), False) in sets["customer"] and discover.Unique(("c_name",), False) in sets["customer"]
