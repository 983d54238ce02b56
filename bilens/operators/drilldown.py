"""Finding what differs between two copies by trees of mergeable sums.

A leaf sums the rows of one range of keys, a node those of FAN children. Both sides' trees
are compared from the top: only children of nodes that differ are looked at, so a clean
table costs one comparison and a few wrong rows a few nodes a level. Rows are joined in the
leaves that differ and nowhere else. A tree is a small table that can be kept: of a side
that has not changed since, no row is read before its leaf differs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..model import LEGACY_ID, DeclarationError
from .reconcile import RANGE_SIZE, Pair, encoded, mismatched
from ..sources.staging import pinned, shared_dir

#: Children of a node: two to this power.
FAN_BITS = 5
#: Ranges of keys that become a filter of the scan; more are joined with the rows.
MOST_RANGES = 500
#: Leaves of keys that have no arithmetic: two to this power at most, by the keys' hashes.
HASH_BITS = 40


def leaf_of(key: Column, whole: bool, size: int, bits: int) -> Column:
    """The leaf of a key: of whole numbers a range of ``size`` values, of others the upper bits of a hash; null keys are in leaf 0."""
    if whole:  # in whole numbers, rounded down
        leaf = F.call_function("div", key, F.lit(size)) - F.when((key < 0) & (F.pmod(key, F.lit(size)) != 0), 1).otherwise(0)
    else:
        leaf = F.shiftrightunsigned(F.xxhash64(key), 64 - bits) if bits else F.lit(0)
    return F.coalesce(leaf.cast("bigint"), F.lit(0).cast("bigint"))


@dataclass
class Tree:
    """The sums of one side: (level, node, n, mixed, total), level 0 being the leaves. Both sides need the same ``shape``."""

    nodes: DataFrame
    whole: bool
    size: int
    bits: int
    levels: int

    @property
    def shape(self) -> tuple:
        return self.whole, self.size, self.bits

    def level(self, number: int) -> DataFrame:
        return self.nodes.filter(F.col("level") == number).drop("level")


def tree(side: DataFrame, columns: list[str], size: int = RANGE_SIZE, rows: int | None = None, folder: str | None = None) -> Tree:
    """The tree of one side of a pair (__legacy_id, columns), in one pass over its rows.

    ``rows`` is about how many there are, for keys that are hashed: both sides must be given
    the same. With ``folder`` the tree is kept there, and ``opened`` brings it back.
    """
    whole = isinstance(side.schema[LEGACY_ID].dataType, IntegralType)
    bits = 0 if whole else min(HASH_BITS, max(0, ((rows if rows is not None else side.count()) // size).bit_length()))
    h = F.xxhash64(encoded([F.col(LEGACY_ID), *[F.col(c) for c in columns]]))
    hashed = side.select(leaf_of(F.col(LEGACY_ID), whole, size, bits).alias("node"), h.alias("h"))
    leaves = pinned(hashed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("mixed"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total")))
    ends = leaves.agg(F.min("node").alias("low"), F.max("node").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    levels, all_ = 1, leaves.withColumn("level", F.lit(0))
    layer = leaves
    while (high >> (FAN_BITS * (levels - 1))) - (low >> (FAN_BITS * (levels - 1))) >= 1 << FAN_BITS:
        layer = layer.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("total").cast("decimal(38,0)").alias("total"))
        all_ = all_.unionByName(layer.withColumn("level", F.lit(levels)))
        levels += 1
    made = Tree(all_, whole, size, bits, levels)
    if folder is None:
        made.nodes = pinned(all_)
        return made
    all_.repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.partitionBy("level").parquet(f"{folder}/nodes")
    side.sparkSession.createDataFrame([(whole, size, bits, levels)], "whole boolean, size bigint, bits int, levels int").coalesce(1).write.parquet(f"{folder}/shape")
    return opened(side.sparkSession, folder)


def opened(spark: SparkSession, folder: str) -> Tree:
    """A tree kept earlier; a level is a folder of its own, so one level is read at a time."""
    s = spark.read.parquet(f"{folder}/shape").first()
    return Tree(spark.read.parquet(f"{folder}/nodes"), s["whole"], s["size"], s["bits"], s["levels"])


@dataclass
class Drill:
    """What a descent found: nodes compared and differing at each level, the leaves that differ, and the cells in them."""

    levels: list[tuple[int, int, int]]
    leaves: DataFrame
    rows: Pair
    mismatched: DataFrame

    @property
    def agrees(self) -> bool:
        return not self.levels or self.levels[-1][2] == 0


def descend(a: Tree, b: Tree) -> tuple[list[tuple[int, int, int]], DataFrame]:
    """(level, nodes compared, nodes that differ) from the top down, and the leaves (node) that differ."""
    if a.shape != b.shape:
        raise DeclarationError("the two trees are cut differently; build both with the same size and rows")
    told: list[tuple[int, int, int]] = []
    spark = a.nodes.sparkSession
    open_ = None
    # Where one tree is deeper, the other side's keys do not reach as far: begin where both have nodes.
    for level in range(min(a.levels, b.levels) - 1, -1, -1):
        sides = []
        for t in (a, b):
            nodes = t.level(level)
            if open_ is not None:
                nodes = nodes.withColumn("parent", F.shiftright("node", FAN_BITS)).join(open_, "parent", "left_semi").drop("parent")
            sides.append(nodes.select("node", F.struct("n", "mixed", "total").alias("sums")))
        met = sides[0].alias("a").join(sides[1].alias("b"), "node", "full")
        seen = pinned(met.select("node", (~F.col("a.sums").eqNullSafe(F.col("b.sums"))).alias("differs")))
        counts = seen.agg(F.count(F.lit(1)).alias("n"), F.count_if("differs").alias("bad")).first()
        told.append((level, counts["n"], counts["bad"]))
        open_ = seen.filter("differs").select(F.col("node").alias("parent"))
        if not counts["bad"]:
            break
    leaves = open_.withColumnRenamed("parent", "node") if told and told[-1][0] == 0 else spark.createDataFrame([], "node bigint")
    return told, leaves


def drilldown(pair: Pair, size: int = RANGE_SIZE, trees: tuple[Tree, Tree] | None = None) -> Drill:
    """``mismatched`` of ``pair``, with the rows of differing leaves joined and no others.

    ``trees`` are those of its sides, where they are kept. Rows without a key match none and
    are always among the result, as ``mismatched`` has them.
    """
    if trees is None:
        rows = None if isinstance(pair.legacy.schema[LEGACY_ID].dataType, IntegralType) else pair.legacy.count()
        trees = tuple(tree(df, pair.columns, size, rows) for df in (pair.legacy, pair.modern))
    told, leaves = descend(*trees)
    one = trees[0]
    bad = told[-1][2] if told else 0
    key = F.col(LEGACY_ID)
    if one.whole and bad <= MOST_RANGES:
        # Neighbouring leaves become one range, which the scans can use to leave out files.
        ranges: list[list[int]] = []
        for node in sorted(r["node"] for r in leaves.collect()):
            if ranges and ranges[-1][1] == node * size:
                ranges[-1][1] += size
            else:
                ranges.append([node * size, node * size + size])
        wanted = key.isNull()
        for low, high in ranges:
            wanted = wanted | ((key >= max(low, -(1 << 63))) & (key <= min(high, 1 << 63) - 1))
        some = Pair(pair.legacy.filter(wanted), pair.modern.filter(wanted), pair.columns)
    else:
        leaf = leaf_of(key, one.whole, one.size, one.bits)

        def within(df: DataFrame) -> DataFrame:
            held = df.filter(key.isNotNull()).withColumn("node", leaf).join(leaves, "node", "left_semi").drop("node")
            return held.unionByName(df.filter(key.isNull()))

        some = Pair(within(pair.legacy), within(pair.modern), pair.columns)
    return Drill(told, leaves, some, mismatched(some))


def kept_in(spark: SparkSession, name: str) -> str:
    """A folder for a tree in the shared one."""
    return f"{shared_dir(spark)}/tree-{name}"
