"""Do the legacy table and its modern copy still say the same? Counts, and checksums of key ranges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.compile import compile, qualified
from ..model import LEGACY_ID, DeclarationError, Entity, Field
from ..plans.lens import key_of, lenses
from ..sources.files import Snapshot
from ..sources.staging import pinned
from ..sources.tables import Load
from .put import numbered
from .view import attribute_column, joined_source

RANGE_SIZE = 1000
#: Fixed: ways to bring a value into normal form before it is compared.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "downcase_trim": lambda c: F.lower(F.btrim(c)),
    "downcase": F.lower,
    "trim": F.btrim,
}
Normalizer = Callable[[Column], Column]


def normal_form(attribute: Field) -> Normalizer:
    """What the attribute's type does to its values: case-insensitive ones are lowered, trimmed ones trimmed."""
    if attribute.type == "ci_string":
        return NORMALIZERS["downcase_trim" if attribute.trim else "downcase"]
    if attribute.type == "string" and attribute.trim:
        return NORMALIZERS["trim"]
    return lambda c: c


@dataclass
class Pair:
    """Both sides as (key, compared columns), in one order."""

    legacy: DataFrame
    modern: DataFrame
    columns: list[str]


def encoded(columns: list[Column]) -> Column:
    """One text for a row, different for different rows: quotes doubled, null unquoted, parts barred off."""
    part = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    return F.concat_ws("|", *[part(c) for c in columns])


def plan(entity: Entity, load: Load, modern: DataFrame, normalizers: dict[str, str | Normalizer] | None = None, only: list[str] | None = None) -> Pair:
    """Legacy values through the view's own expressions, beside the modern table's.

    Read-only attributes are compared too; the key, constants and unmapped attributes are
    not. Both sides pass the same normalizers: the attribute types' own, or those given.
    ``modern`` carries ``__legacy_id``.
    """
    named = {}
    for name, n in (normalizers or {}).items():
        if isinstance(n, str) and n not in NORMALIZERS:
            raise DeclarationError(f"unknown normalizer {n!r}; there are {', '.join(NORMALIZERS)}, or give a function of a column")
        named[name] = NORMALIZERS[n] if isinstance(n, str) else n
    compared = [x for x in lenses(entity).values() if x.kind != "structural" and (only is None or x.attribute in only)]
    frame = qualified(table=entity.source.table)
    normal = lambda a: named.get(a, normal_form(entity.attribute(a)))
    legacy = joined_source(entity, load, compared).select(
        compile(key_of(entity).source, frame).alias(LEGACY_ID), *[normal(x.attribute)(attribute_column(entity, x, frame)).alias(x.attribute) for x in compared]
    )
    names = [x.attribute for x in compared]
    return Pair(legacy, modern.select(LEGACY_ID, *[normal(a)(F.col(a)).alias(a) for a in names]), names)


def given(legacy: DataFrame, modern: DataFrame, key: str, columns: dict[str, tuple[Column, Column]]) -> Pair:
    """A comparison by hand: for each name, the expression of either side."""
    sides = [df.select(F.col(key).alias(LEGACY_ID), *[c[k].alias(n) for n, c in columns.items()]) for k, df in enumerate((legacy, modern))]
    return Pair(*sides, list(columns))


def count_drift(pair: Pair) -> DataFrame:
    """(legacy, view, drift, agrees): rows of either side, and the difference."""
    legacy = pair.legacy.agg(F.count(F.lit(1)).alias("legacy"))
    view = pair.modern.agg(F.count(F.lit(1)).alias("view")).scalar()
    counted = legacy.select("legacy", view.alias("view"))
    return counted.select("legacy", "view", (F.col("view") - F.col("legacy")).alias("drift"), (F.col("view") == F.col("legacy")).alias("agrees"))


def _ranged(pair: Pair, size: int, pages: bool) -> DataFrame:
    sides = [df.select(F.lit(k).alias("side"), F.col(LEGACY_ID).alias("key"), encoded([F.col(LEGACY_ID), *[F.col(c) for c in pair.columns]]).alias("text")) for k, df in enumerate((pair.legacy, pair.modern))]
    both = sides[0].unionByName(sides[1])
    if not pages and isinstance(both.schema["key"].dataType, NumericType):
        return both.withColumn("range", F.floor(F.col("key") / F.lit(size)).cast("bigint"))
    # Pages of exactly ``size`` keys of either side: keys are numbered in order, by ranges.
    pages_ = numbered(both.select("key").distinct(), [F.col("key")], F.lit(0)).select(F.col("key").alias("page_key"), F.floor((F.col("number") - 1) / F.lit(size)).cast("bigint").alias("range"))
    return both.join(pages_, F.col("key").eqNullSafe(F.col("page_key"))).drop("page_key")


def checksums(pair: Pair, size: int = RANGE_SIZE, ordered: bool = False, pages: bool = False) -> DataFrame:
    """(lower, upper, rows, legacy_sum, view_sum, agrees) of each range of keys, in one pass over both sides.

    Ranges of numbers are of key values, so that no sort of all keys is needed; keys of
    any other type that has an order are cut by count.
    A sum is order-free and mergeable: counts, exclusive-or and total of row hashes, the
    key among them. ``ordered`` digests the rows' texts in key order instead, which any
    database can repeat; ``pages`` cuts by count, which needs all keys in one order.
    """
    rows = _ranged(pair, size, pages)

    def total(side: int) -> Column:
        mine = F.col("side") == side
        if ordered:
            listed = F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("key", "text")))), lambda x: x["text"])
            return F.md5(F.array_join(listed, "\n"))
        h = F.when(mine, F.xxhash64("text"))
        return F.concat_ws(":", F.count(h).cast("string"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string"))

    summed = rows.groupBy("range").agg(F.min("key").alias("lower"), F.max("key").alias("upper"), F.count_distinct("key").alias("rows"), total(0).alias("legacy_sum"), total(1).alias("view_sum"))
    return summed.select("lower", "upper", "rows", "legacy_sum", "view_sum", (F.col("legacy_sum") == F.col("view_sum")).alias("agrees"))


def mismatched(pair: Pair) -> DataFrame:
    """(__legacy_id, column, legacy, view): each value that differs; a missing row is one difference under ``*``."""
    a, b = pair.legacy.alias("a"), pair.modern.alias("b")
    joined = a.join(b, F.col(f"a.{LEGACY_ID}") == F.col(f"b.{LEGACY_ID}"), "full")
    key_a, key_b = F.col(f"a.{LEGACY_ID}"), F.col(f"b.{LEGACY_ID}")
    missing = F.when(key_b.isNull(), F.struct(F.lit("*").alias("column"), F.lit("present").alias("legacy"), F.lit("missing").alias("view"))).when(
        key_a.isNull(), F.struct(F.lit("*").alias("column"), F.lit("missing").alias("legacy"), F.lit("present").alias("view"))
    )
    cells = [F.when(key_a.isNotNull() & key_b.isNotNull() & ~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")), F.struct(F.lit(c).alias("column"), F.col(f"a.`{c}`").cast("string").alias("legacy"), F.col(f"b.`{c}`").cast("string").alias("view"))) for c in pair.columns]
    out = joined.select(F.coalesce(key_a, key_b).alias(LEGACY_ID), F.explode(F.filter(F.array(missing, *cells), lambda x: x.isNotNull())).alias("d"))
    return out.select(LEGACY_ID, "d.column", "d.legacy", "d.view")


@dataclass
class Diff:
    """What a comparison found."""

    agrees: bool
    legacy: int
    view: int
    ranges: int
    mismatched: DataFrame


def diff(pair: Pair, size: int = RANGE_SIZE, pin: bool = False, snapshot: Snapshot | None = None) -> Diff:
    """Counts and checksums together; only two counts and two sums of ranges reach the driver.

    ``pin`` computes both sides once first, for sources that may change between two reads.
    Where both sides are read through a ``snapshot``, no copy is needed: what was found
    stands only if its files are what they were.
    """
    if pin:
        pair = Pair(pinned(pair.legacy), pinned(pair.modern), pair.columns)
    counts = count_drift(pair).first()
    sums = checksums(pair, size)
    seen = sums.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("agrees")).alias("bad")).first()
    if snapshot is not None:
        snapshot.verify()
    return Diff(bool(counts["agrees"]) and seen["bad"] == 0, counts["legacy"], counts["view"], seen["n"], sums.filter("NOT agrees"))


