"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn and share the
    total of all sizes. A target stops at ``most`` times its source's size, and the
    excess is shared again by weight: at the end target = min(cap, level * weight) for
    one level. Sources reach their caps in the order of cap / weight, so running
    totals in that order find the level without iteration. No sources: no rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # cap / weight in order, compared as whole numbers: the weights' product is a common multiple.
    common = 1
    for w in weights:
        common *= int(w)
    ranked = ranked.withColumn("reach", F.col("cap").cast("decimal(38,0)") * F.expr(f"{common} div weight"))
    before = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    summed = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weight_total"),
    )
    # Capped when its cap is below what the level would be with all before it capped.
    summed = summed.withColumn("left", F.col("total") - F.col("cap_before")).withColumn("weight_left", F.col("weight_total") - F.col("weight_before"))
    capped = F.col("cap").cast("decimal(38,0)") * F.col("weight_left") < F.col("left").cast("decimal(38,0)") * F.col("weight")
    summed = summed.withColumn("capped", capped)
    rest = summed.withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(0))).over(everything)).withColumn(
        "open_weight", F.sum(F.when(F.col("capped"), F.lit(0)).otherwise(F.col("weight"))).over(everything)
    )
    level = ((F.col("total") - F.col("cap_sum")) * F.col("weight")).cast("double") / F.col("open_weight").cast("double")
    return rest.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, row): how often the mix takes each row of ``docs``, and the row.

    Rate = target / source_size. A document is taken floor(rate) times, and once more
    if the hash of its seed, id and text, as a number in [0, 1), is below the fraction; so
    reruns agree, and rows with one id, or none, are drawn each by their text; only rows
    that repeat an id and a text fare alike. Null texts have size 0, null ids and texts
    hash as the word ``null``, null sources are one source; in a source of
    size 0 no row is taken. ``row`` holds all columns of the input, whatever their names.
    No rows: no rows.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.coalesce(F.md5(text_col), F.lit("null")).alias("digest"), whole.alias("row"))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumnRenamed("source", "mix_source")
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["mix_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("digest")))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    extra = F.when(draw < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))
    return joined.select("doc_id", "size", "source_size", "target", F.least(F.floor(rate) + extra, F.lit(most)).cast("bigint").alias("copies"), "row")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, in its own columns."""
    taken = copies(docs, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIXTURE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(text), 'null') AS digest FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         source_size * 3 AS cap FROM per
), s AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weight_total
  FROM w WINDOW b AS (ORDER BY cap * (10 // weight), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, cap::HUGEINT * (weight_total - weight_before) < (total - cap_before)::HUGEINT * weight AS capped FROM s
), t AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS cap_sum,
         sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS open_weight FROM c
), plan AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE
         ELSE ((total - cap_sum) * weight)::DOUBLE / open_weight::DOUBLE END AS target FROM t
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, size, source_size, target,
       (size * least(floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM r
"""
