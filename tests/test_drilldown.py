"""Descending two trees of sums, beside a join of all rows."""

import os
import random
import shutil
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from bilens.model import LEGACY_ID, DeclarationError, Field, LegacyTable
from bilens.operators import drilldown, reconcile
from bilens.sources.files import Snapshot, SnapshotChanged


def pair(spark, left, right, kind="bigint"):
    schema = f"{LEGACY_ID} {kind}, a string, b int"
    return reconcile.Pair(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["a", "b"])


def cells(df):
    return sorted(map(str, map(tuple, df.collect())))


def sample(key=lambda i: i):
    rng = random.Random(1)
    left = [(key(i), f"v{i}", i % 5) for i in rng.sample(range(-3000, 40_000), 3000)]
    right = [list(r) for r in left]
    for i in (5, 700, 701, 2999):
        right[i][1] = None
    del right[1234]
    return left, [tuple(r) for r in right] + [(key(90_000), "more", None)]


@pytest.mark.parametrize("key, kind", [(lambda i: i, "bigint"), (lambda i: f"k{i}", "string"), (lambda i: float(i) / 3, "double")])
def test_the_same_cells_as_a_join_of_everything(spark, key, kind):
    p = pair(spark, *sample(key), kind=kind)
    found = drilldown.drilldown(p, 20)
    assert cells(found.mismatched) == cells(reconcile.mismatched(p)) and not found.agrees
    # Six leaves differ at most, so the rows that are joined are a few of the 3000.
    assert found.leaves.count() <= 6 and found.rows.legacy.count() + found.rows.modern.count() <= 6 * 2 * (20 if kind == "bigint" else 80)
    assert [level for level, _, _ in found.levels] == sorted((level for level, _, _ in found.levels), reverse=True)
    # Below the top, only children of what differed were compared.
    for (_, _, bad), (_, n, _) in zip(found.levels, found.levels[1:]):
        assert n <= bad << drilldown.FAN_BITS


def test_equal_sides_take_one_comparison_of_the_top(spark):
    left, _ = sample()
    found = drilldown.drilldown(pair(spark, left, list(reversed(left))), 20)
    assert found.agrees and len(found.levels) == 1 and found.levels[0][1] <= 1 << drilldown.FAN_BITS and found.mismatched.count() == 0


def test_rows_without_a_key_and_empty_sides(spark):
    left, right = [(None, "x", 1), (3, "y", 2), (-(1 << 63), "z", 3)], [(None, "x", 1), (3, "y", 2), ((1 << 63) - 1, "z", 3)]
    p = pair(spark, left, right)
    assert cells(drilldown.drilldown(p).mismatched) == cells(reconcile.mismatched(p))
    for a, b in (([], right), (left, []), ([], [])):
        p = pair(spark, a, b)
        assert cells(drilldown.drilldown(p).mismatched) == cells(reconcile.mismatched(p))


def test_many_bad_ranges_are_joined_instead_of_listed(spark, monkeypatch):
    monkeypatch.setattr(drilldown, "MOST_RANGES", 3)
    p = pair(spark, *sample())
    assert cells(drilldown.drilldown(p, 20).mismatched) == cells(reconcile.mismatched(p))


def test_a_kept_tree_reads_no_row_again(spark, tmp_path):
    left, right = sample()
    p = pair(spark, left, right)
    drilldown.tree(p.legacy, p.columns, 20, folder=f"file://{tmp_path}/t")
    kept = drilldown.opened(spark, f"file://{tmp_path}/t")
    assert all("/nodes/" in f for f in kept.nodes.inputFiles())
    trees = kept, drilldown.tree(p.modern, p.columns, 20)
    assert cells(drilldown.drilldown(p, 20, trees).mismatched) == cells(reconcile.mismatched(p))
    with pytest.raises(DeclarationError, match="cut differently"):
        drilldown.descend(kept, drilldown.tree(p.modern, p.columns, 30))


def test_the_ranges_reach_the_scan(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias(LEGACY_ID), F.lit("v").alias("a"), F.lit(1).alias("b")).write.parquet(f"{tmp_path}/l")
    side = spark.read.parquet(f"{tmp_path}/l")
    p = reconcile.Pair(side, side.withColumn("a", F.when(F.col(LEGACY_ID) == 4321, "w").otherwise(F.col("a"))), ["a", "b"])
    found = drilldown.drilldown(p, 100)
    plan = found.rows.legacy._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual({LEGACY_ID},4300),LessThanOrEqual({LEGACY_ID},4399" in plan  # among the scan's pushed filters
    assert [tuple(r) for r in found.mismatched.collect()] == [(4321, "a", "v", "w")]


def test_a_snapshot_is_one_list_of_files(spark, tmp_path):
    table = LegacyTable("t", (Field("id", "bigint", False), Field("v", "string")), ("id",))
    rows = spark.range(100).select("id", F.concat(F.lit("v"), "id").alias("v"))
    rows.repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    fixed = Snapshot(spark, f"file://{tmp_path}")
    compare = lambda: reconcile.given(fixed.load(table), fixed.load(table), "id", {"v": (F.col("v"), F.col("v"))})
    assert reconcile.diff(compare(), snapshot=fixed).agrees
    # A file that comes later is not seen, and changes nothing.
    spark.createDataFrame([(1000, "late")], "id bigint, v string").write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert fixed.load(table).count() == 100 and reconcile.diff(compare(), snapshot=fixed).agrees
    # One that is replaced is found out.
    one = Path(urlparse(next(iter(fixed.held["t"][1]))).path)
    other = next(p for p in sorted(tmp_path.glob("t.parquet/part-*")) if p.stat().st_size != one.stat().st_size)
    shutil.copy(other, f"{one}.new")
    os.replace(f"{one}.new", one)
    (one.parent / f".{one.name}.crc").unlink()
    with pytest.raises(SnapshotChanged, match="1 files changed"):
        reconcile.diff(compare(), snapshot=fixed)
