"""How document filters interact: what each removes alone, after others, and over every order.

Filters are judged once, each on the whole input; a document's failures are a mask with one
bit a filter. Counts of the masks of each part (one conditional count for each mask) say all
that any order of the filters would do, so no order is ever run.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 50
#: In percent: the least share of distinct words, the greatest of capital letters.
LEAST_DISTINCT, MOST_CAPITALS = 65, 5
BLANK = r"[\x20\x09-\x0D]+"
COUNTED = ("n", "good", "toxic")


def _key(text: Column) -> list[Column]:
    """128 bits of a text: rows are known by their text, so rows without an id, or that share one, do not mix."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def word_totals(texts: DataFrame) -> DataFrame:
    """(k1, k2, n_words, n_distinct) of the texts of ``texts`` (k1, k2, text) that have a word.

    Equal texts count once, merged in each map task before they travel, so copies make no hot
    key. The words of a text stay where the text is: both aggregations use its key's partitions.
    """
    once = texts.dropDuplicates(["k1", "k2"])
    words = once.select("k1", "k2", F.explode(F.split("text", BLANK)).alias("word")).filter("word <> ''")
    counted = words.groupBy("k1", "k2", "word").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("k1", "k2").agg(F.sum("c").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, and how many are labelled so.

    Bits of ``mask``: 1 under 50 words, 2 under 65 % distinct words, 4 over 5 % capital
    letters, 8 a character of ``[#$%&*|]``, 16 the same text under a smaller id anywhere.
    Null texts are empty, null sources the part ''. A null id is not smaller than another and
    has no smaller one. A document is good or toxic if any label row of its id says so.
    Rows that repeat an id and text count each, and are no copies of one another.
    A part may have several rows with one mask; no documents: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("part"),
        *_key(text),
        ((100 * capitals > MOST_CAPITALS * F.length(text)).cast("int") * 4 + text.rlike(r"[#$%&*|]").cast("int") * 8).alias("own"),
    )
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left")
    first = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("is_first", F.lit(1))
    copied = (F.col("doc_id").isNotNull() & F.col("is_first").isNull()).cast("int") * 16
    rows = rows.join(first, ["k1", "k2", "doc_id"], "left").withColumn("own", F.col("own") + copied)
    # Copies are counted before their text's words are looked up, so no text is a hot key of the join.
    few = rows.groupBy("k1", "k2", "part", "own").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")])
    words = word_totals(docs.select(*_key(text), text.alias("text")))
    total, distinct = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_words", "n_distinct"))
    worded = (total < LEAST_WORDS).cast("int") + (100 * distinct < LEAST_DISTINCT * total).cast("int") * 2
    return few.join(words, ["k1", "k2"], "left").select("part", (F.col("own") + worded).alias("mask"), *COUNTED)


def cube(masks: DataFrame, n_filters: int) -> DataFrame:
    """One row for each part, with a column for each count and mask: n0, n1, ... good0, ... toxic0, ..."""
    return masks.groupBy("part").agg(*[F.expr(f"sum(CASE WHEN mask = {m} THEN {c} ELSE 0 END) AS {c}{m}") for c in COUNTED for m in range(1 << n_filters)])


def orders_audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of all filters and step: what stays, and what the step's filter does there.

    ``masks`` is (part, mask, n, good, toxic), as ``failures`` returns it; filters are single
    letters in the order of their bits. Returns (part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley): documents left after the step,
    removed in it, failing its filter but removed earlier, failing no other filter, good and
    toxic ones among those removed, and the filter's removals summed over all orders. Every
    part has all its rows, zeros included.
    """
    n, masked = len(filters), range(1 << len(filters))
    bit = "CASE substring(filter_order, {}, 1) " + " ".join(f"WHEN '{f}' THEN {1 << i}" for i, f in enumerate(filters)) + " END"
    bits = [bit.format(j) for j in range(1, n + 1)]
    steps = ", ".join(f"struct({j + 1} AS step, {bits[j]} AS bit, {' + '.join(bits[:j]) or 0} AS before)" for j in range(n))
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(filters))
    rows = cube(masks, n).withColumn("filter_order", F.expr(f"explode(array({orders}))")).select("*", F.expr(f"inline(array({steps}))"))

    def summed(name: str, count: str, holds: str, weight=lambda m: 1) -> Column:
        """The sum of a count over the masks for which ``holds``."""
        found = [f"CASE WHEN {holds.format(m=m)} THEN {count}{m} * {weight(m)} ELSE 0 END" for m in masked]
        return F.expr(f"CAST({' + '.join(found)} AS bigint) AS {name}")

    now = "{m} & bit <> 0 AND {m} & before = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        summed("kept", "n", "{m} & (before | bit) = 0"),
        summed("removed", "n", now),
        summed("redundant", "n", "{m} & bit <> 0 AND {m} & before <> 0"),
        summed("unique_fails", "n", "{m} = bit"),
        summed("good_lost", "good", now),
        summed("toxic_lost", "toxic", now),
        # Of a document that fails k filters, each of the k comes first in an equal share of all orders.
        summed("shapley", "n", "{m} & bit <> 0", lambda m: factorial(n) // max(1, m.bit_count())),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``orders_audit`` of the five filters of ``failures``: 600 rows for each part of ``docs``."""
    return orders_audit(failures(docs, labels, **columns))


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), g AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM g p JOIN g q ON q.x <> p.x JOIN g r ON r.x NOT IN (p.x, q.x) JOIN g s ON s.x NOT IN (p.x, q.x, r.x) JOIN g t ON t.x NOT IN (p.x, q.x, r.x, s.x)
), k AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
)
SELECT part, filter_order, step::INT AS step,
       sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM m, k GROUP BY part, filter_order, step
"""
