"""Filling new columns for rows that exist, in key ranges, resumably."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.compile import compile, quoted
from ..functions import expr as E
from ..functions.compile import Frame
from ..model import IDENTIFIER, DeclarationError, Entity, spark_type
from ..plans.lens import key_of, lenses
from ..sources.files import FileTable, VersionTaken
from ..sources.staging import pinned
from .put import numbered
from .view import key_column

BATCH_SIZE = 1000
FLAG = "needs_backfill"
#: Sweeps that change nothing before a run gives up.
EMPTY_PASSES = 3


@dataclass(frozen=True)
class Plan:
    """What a backfill sets: columns of the relation as functions of its own row."""

    relation: str
    key: str
    flag: str
    set: dict[str, Column]


@dataclass
class Result:
    """What a run did, and the table afterwards."""

    table: DataFrame
    rows: int
    batches: int
    passes: int
    total: int
    complete: bool


def plan(entity: Entity, store_key: str | None = None, overrides: dict[str, Column] | None = None, flag: str = FLAG) -> Plan:
    """Columns to set: those given, the derived key under ``store_key``, and constants the relation has a column for.

    The key is the view's own expression, so that what is stored is what the view shows.
    """
    table = entity.source.table
    own = Frame(lambda r: quoted(r.name))
    names = [*(overrides or {}), *([store_key] if store_key else []), flag]
    bad = [n for n in names if not IDENTIFIER.match(n)]
    if bad:
        raise DeclarationError(f"{', '.join(bad)} cannot name a column")
    wrong = [n for n, c in (overrides or {}).items() if not isinstance(c, Column)]
    if wrong:
        raise DeclarationError(f"{', '.join(wrong)}: give a column expression, such as lit(...)")
    if overrides and flag in overrides:
        raise DeclarationError(f"{flag} is the progress flag, and is set by the run")
    chosen = dict(overrides or {})
    if store_key and store_key not in chosen:
        chosen[store_key] = key_column(entity, own)
    for lens in lenses(entity).values():
        if lens.combinator == "constant" and table.has(lens.attribute) and lens.attribute not in chosen:
            chosen[lens.attribute] = compile(lens.forward, own).cast(spark_type(table.field(lens.attribute).type))
    if not chosen:
        raise DeclarationError(f"{entity.name}: nothing to fill; give store_key or columns")
    key = E.simple_reference(key_of(entity).source)
    if key is None:
        raise DeclarationError(f"{entity.name}: the key must be a plain column")
    return Plan(table.name, key.name, flag, chosen)


def add_flag(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """The table with its progress flag, true where it is new; a second call changes nothing."""
    return df if flag in df.columns else df.withColumn(flag, F.lit(True))


def drop_flag(df: DataFrame, flag: str = FLAG) -> DataFrame:
    return df.drop(flag)


def pending(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """(pending, total): rows still to fill, and all rows."""
    return df.agg(F.count_if(F.col(flag)).alias("pending"), F.count(F.lit(1)).alias("total"))


def apply(df: DataFrame, fill: Plan, chosen: Column | None = None) -> DataFrame:
    """The flagged rows filled and unflagged, those that ``chosen`` names or all; one narrow pass."""
    now = F.col(fill.flag) & (F.lit(True) if chosen is None else chosen)
    now = F.coalesce(now, F.lit(False))
    kept = [c for c in df.columns if c not in fill.set and c != fill.flag]
    made = [F.when(now, value).otherwise(F.col(quoted(c)) if c in df.columns else F.lit(None)).alias(c) for c, value in fill.set.items()]
    return df.select(*[F.col(quoted(c)) for c in kept], *made, F.when(now, False).otherwise(F.col(fill.flag)).alias(fill.flag))


def _value_ranges(df: DataFrame, fill: Plan, size: int, limit: int | None) -> tuple[int, int, Column | None]:
    """Flagged rows and ranges of key values that one pass takes, and which rows these are."""
    bucket = F.floor(F.col(quoted(fill.key)) / F.lit(size))
    per_range = df.filter(F.col(fill.flag)).groupBy(bucket.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    if limit is None:
        seen = per_range.agg(F.count(F.lit(1)).alias("ranges"), F.sum("n").alias("n")).first()
        return seen["n"], seen["ranges"], None
    # Only as many lowest ranges as are still allowed.
    seen = per_range.orderBy("range").limit(limit).agg(F.count(F.lit(1)).alias("ranges"), F.sum("n").alias("n"), F.max("range").alias("top")).first()
    return seen["n"], seen["ranges"], bucket <= F.lit(seen["top"])


def _counted_ranges(df: DataFrame, fill: Plan, size: int, limit: int | None, left: int) -> tuple[int, int, Column | None]:
    """The same in key order, ``size`` flagged rows a range; rows of one key are taken together."""
    if limit is None or left <= limit * size:
        return left, -(-left // size), None
    key = F.col(quoted(fill.key))
    keys = df.filter(F.col(fill.flag)).select(key.alias("key"))
    top = numbered(keys, [F.col("key")], F.lit(0)).filter(F.col("number") == limit * size).first()["key"]
    return keys.filter(F.col("key") <= F.lit(top)).count(), limit, key <= F.lit(top)


def run(df: DataFrame, fill: Plan, batch_size: int = BATCH_SIZE, max_batches: int | None = None, progress: Callable[[int, int], None] | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> Result:
    """Fill what is flagged, in ranges of ``batch_size`` key values, lowest first; keys that are no numbers go by count.

    All ranges of a pass are filled at once; ``max_batches`` stops after so many, and a
    later run goes on from the flags. ``again`` stands for writers meanwhile: it gets the
    table after a pass and may flag rows, which another pass takes. A pass that finds
    flagged rows and unflags none is counted, and a few in a row end the run.
    """
    if batch_size < 1 or max_batches is not None and max_batches < 1:
        raise DeclarationError("batch_size and max_batches are at least 1")
    df = add_flag(df, fill.flag)
    total = pending(df, fill.flag).first()["pending"]
    rows = batches = passes = idle = 0
    numbers = isinstance(df.schema[fill.key].dataType, NumericType)
    left = total
    while left:
        passes += 1
        limit = None if max_batches is None else max_batches - batches
        if numbers:
            n_rows, n_ranges, chosen = _value_ranges(df, fill, batch_size, limit)
        else:
            n_rows, n_ranges, chosen = _counted_ranges(df, fill, batch_size, limit, left)
        df = pinned(apply(df, fill, chosen))
        rows, batches = rows + n_rows, batches + n_ranges
        if progress:
            progress(rows, total)
        if again is not None:
            df = pinned(again(df))
        before, left = left, pending(df, fill.flag).first()["pending"]
        idle = idle + 1 if left >= before else 0
        if idle >= EMPTY_PASSES:
            raise RuntimeError(f"{fill.relation}: {left} rows stay flagged after {passes} passes")
        if max_batches is not None and batches >= max_batches:
            break
    return Result(df, rows, batches, passes, total, left == 0)


@dataclass
class FilesResult:
    """What a run over files did: steps committed, rows filled, and files still to fill."""

    version: int
    steps: int
    rows: int
    left: int

    @property
    def complete(self) -> bool:
        return self.left == 0


def pending_files(files: FileTable, fill: Plan) -> list[str]:
    """The files with rows still to fill, lowest keys first; of files, only the flag is read.

    A file written before the table had the flag has it null: nothing of it is filled.
    """
    manifest = files.manifest()
    if fill.flag in files.schema().fieldNames():
        flag = F.col(quoted(fill.flag))
        paths = [r["path"] for r in manifest.select("path").collect()]
        open_ = files.read_files(paths).filter(flag.isNull() | flag).select(F.col("_metadata.file_path").alias("path")).distinct() if paths else manifest.select("path")
        manifest = manifest.join(open_, "path", "left_semi")
    return [r["path"] for r in manifest.orderBy("low").select("path").collect()]


def run_files(files: FileTable, fill: Plan, step: int = 64, max_steps: int | None = None, progress: Callable[[int, int], None] | None = None) -> FilesResult:
    """Fill a table kept in files, ``step`` files at a time, each step a version of its own.

    A step is there whole or not at all, so a run that is lost goes on where it stopped: the
    next one asks which files are open. Files are ranges of keys, so steps go up the key.
    Writers may commit between steps: a step that finds its version taken is done again on
    theirs. A step whose files are still the first ones open afterwards is not tried for
    ever: after a few the run ends with an error.
    """
    if step < 1 or max_steps is not None and max_steps < 1:
        raise DeclarationError("step and max_steps are at least 1")
    steps = rows = idle = 0
    start = None
    open_ = pending_files(files, fill)
    total = len(open_)
    while open_ and (max_steps is None or steps < max_steps):
        base, some = files.latest(), open_[:step]
        manifest = files.manifest(base)
        held = [r["path"] for r in manifest.filter(F.col("path").isin(some)).select("path").collect()]
        if len(held) == len(some):
            before = files.read_files(some)
            flagged = before.withColumn(fill.flag, F.coalesce(F.col(quoted(fill.flag)), F.lit(True)) if fill.flag in before.columns else F.lit(True))
            after = apply(flagged, fill)
            try:
                files.replace(base, some, after, after.schema)
            except VersionTaken:
                held = []
        if len(held) == len(some):  # else somebody else has changed the table: look again
            low = manifest.filter(F.col("path").isin(some)).agg(F.min("low"), F.sum("n_rows")).first()
            steps, rows = steps + 1, rows + (low[1] or 0)
            # The same keys come first again: something flags them as fast as they are filled.
            idle, start = (idle + 1, start) if low[0] == start else (0, low[0])
            if idle >= EMPTY_PASSES:
                raise RuntimeError(f"{fill.relation}: rows from key {start} on stay flagged after {idle + 1} steps")
        open_ = pending_files(files, fill)
        if progress:
            progress(total - len(open_), total)
    return FilesResult(files.latest(), steps, rows, len(open_))
