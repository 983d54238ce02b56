"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every linked node with the smallest node that it reaches.

    ``links`` has two bigint columns; order, repeats, self links and links with a
    null end do not matter. Returns (node, label) with one row for each node that
    has a link to another node; nodes without links are their own component and
    are not returned. No links: an empty table. Each round is two aggregations and
    two joins; nothing but a row count and a checksum reaches the driver, and each
    round is checkpointed, so a lost executor costs one round.
    """
    edges = (
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small"))
        .distinct()
    )
    edges = cut(edges)
    before = _digest(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # Large star: every larger neighbour of a node moves to the node's least neighbour.
        both = edges.select(F.col("small").alias("u"), F.col("big").alias("v")).unionByName(
            edges.select(F.col("big").alias("u"), F.col("small").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("small"), F.least("u", "m").alias("m"))
        large = edges.join(least, "small").select("big", F.col("m").alias("small")).distinct()
        # Small star: the smaller neighbours of a node, and the node, move to the least of them.
        least = large.groupBy("big").agg(F.min("small").alias("m"))
        moved = large.join(least, "big")
        small = (
            moved.filter("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
            .unionByName(least.select("big", F.col("m").alias("small")))
            .distinct()
        )
        edges = cut(small)
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("big").alias("node"), F.col("small").alias("label")).unionByName(
        edges.select(F.col("small").alias("node"), F.col("small").alias("label")).distinct()
    )
