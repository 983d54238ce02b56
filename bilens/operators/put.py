"""The write direction: changes to the view become changes to the legacy table, as sets."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.compile import Frame, compile, literal, quoted
from ..model import LEGACY_ID, DeclarationError, Entity, Phase, spark_type
from ..plans.lens import key_of, lenses
from ..sources.staging import pinned
from ..sources.files import FileTable
from ..sources.tables import Load, named, replacing
from .view import STORED, modern_view, write_targets

OP = "op"


class WriteRefused(ValueError):
    """Some change cannot be carried out; none was."""


@dataclass
class PutResult:
    """The legacy table afterwards, the changed rows as the view shows them, and who is told."""

    legacy: DataFrame
    returned: DataFrame
    events: DataFrame
    refused: DataFrame
    changed_columns: DataFrame


def numbered(df: DataFrame, order: list[Column], start: Column) -> DataFrame:
    """``df`` with a number from ``start`` on, without bringing all rows to one task.

    Rows are ranged into partitions and pinned, each partition's size is known from an
    aggregate, and a row's number is what comes before its partition and its place in it.
    """
    ranged = pinned(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("place", place).join(before, "part").withColumn("number", start + F.col("before") + F.col("place")).drop("part", "place", "before")


def _problems(entity: Entity, by_name) -> Column:
    """What the declaration and the table's key do not allow of one change, as an array of messages."""
    table, known = entity.source.table.name, F.col(quoted("old", LEGACY_ID)).isNotNull()
    found = [
        F.when(~F.coalesce(F.col("new.op").isin("insert", "update", "delete"), F.lit(False)), F.concat(F.lit("no such operation: "), F.coalesce("new.op", F.lit("null")))),
        F.when(F.col("new.op").isin("update", "delete") & ~known, F.lit(f"{table} has no such row")),
        F.when((F.col("new.op") == "insert") & known, F.lit(f"{table} has such a row already")),
        F.when(F.col("times") > 1, F.lit(f"{table}: more than one change of one row")),
    ]
    for lens in by_name.values():
        if lens.writes or lens.kind == "structural":
            continue
        new, old = F.col(quoted("new", lens.attribute)), F.col(quoted("old", lens.attribute))
        changed = ((F.col("new.op") == "insert") & new.isNotNull()) | ((F.col("new.op") == "update") & ~new.eqNullSafe(old))
        found.append(F.when(changed, F.lit(f"cannot write {table}.{lens.attribute}: {lens.because or 'it is only read'}")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def put(entity: Entity, load: Load, changes: DataFrame, now: Any = None, validate: bool = True, top: int | None = None) -> PutResult:
    """Carry out ``changes`` (op, __legacy_id, attributes) on the legacy table.

    op is insert, update or delete. Attributes that ``changes`` lacks keep their value on
    update, and are null on insert. An insert without an id gets the next free one.
    Columns that no attribute writes keep their value, or take the table's declared
    default on insert. One join on the legacy id carries all updates and deletes. The
    table's key holds: an insert of an id that exists and several changes of one id are
    refused, all of them, as an unknown row or operation is. With ``validate`` the guards
    run first and refuse the whole set; else ``refused`` has what they would say, and
    those changes are left out. ``top`` is the table's greatest id, for those who load
    only the part of it that the changes name.
    """
    if entity.phase not in (Phase.DUAL_WRITE, Phase.READ_FROM_LEGACY) or entity.source.writes == "none":
        raise DeclarationError(f"{entity.name} does not write to its legacy table in phase {entity.phase.value}")
    table = entity.source.table
    by_name = lenses(entity)
    joins = [lens.attribute for lens in by_name.values() if lens.writes and any(r.path for r in lens.sources)]
    if joins:
        raise DeclarationError(f"{', '.join(joins)} would write through a join")
    key = E.simple_reference(key_of(entity).source).name
    legacy = load(table)
    old = modern_view(entity, load, now=now, stored=True)
    have = set(changes.columns)
    given = [a for a in by_name if a in have and by_name[a].combinator != "key"]
    new = changes.select(OP, F.col(LEGACY_ID), *given).alias("new")
    joined = new.join(old.alias("old"), F.col(quoted("new", LEGACY_ID)) == F.col(quoted("old", LEGACY_ID)), "left")
    # One row for each change, with the whole new row: what was not given stays.
    full = joined.select(
        F.col("new.op").alias(OP), F.col(quoted("new", LEGACY_ID)).alias(LEGACY_ID),
        F.struct(*[(F.col(quoted("new", a)) if a in given else F.when(F.col("new.op") != "insert", F.col(quoted("old", a)))).alias(a) for a in by_name]).alias("new"),
        F.struct(*[F.col(quoted("old", c)).alias(c) for c in old.columns]).alias("old"),
    )
    full = full.withColumn("new", F.col("new").withField(OP, F.col(OP)).withField(LEGACY_ID, F.col(LEGACY_ID)))
    # A row may be changed once: two changes of it have no order.
    times = changes.filter(F.col(LEGACY_ID).isNotNull()).groupBy(F.col(LEGACY_ID).alias("times_id")).agg(F.count(F.lit(1)).alias("times"))
    full = full.join(times.filter("times > 1"), F.col(LEGACY_ID) == F.col("times_id"), "left").withColumn("problems", _problems(entity, by_name)).drop("times_id", "times")
    refused = full.select(F.col(LEGACY_ID).alias("legacy_id"), F.explode("problems").alias("message"))
    if validate:
        some = refused.limit(5).collect()
        if some:
            raise WriteRefused(f"{refused.count()} changes refused: " + "; ".join(f"{r['message']} (id {r['legacy_id']})" for r in some))
    full = full.filter(F.size("problems") == 0).drop("problems")
    targets = {c: w for c, w in write_targets(entity, by_name).items() if c != key}
    new_name = lambda r: quoted("new", r.name)
    types = lambda r: entity.attribute(r.name).type
    inserting = Frame(new_name, now, types=types)
    updating = Frame(new_name, now, old=lambda a: quoted("old", a), stored=lambda c: quoted("old", STORED + c), types=types)
    same = lambda a: F.col(quoted("new", a)).eqNullSafe(F.col(quoted("old", a)))
    writes, inserts = [], []
    for f in table.fields:
        kind, kept = spark_type(f.type), F.col(quoted("old", STORED + f.name))
        if f.name == entity.source.interlock:
            writes.append(F.lit(False).alias(f.name))
            inserts.append(F.lit(False).alias(f.name))
        elif f.name in targets:
            attribute, value = targets[f.name]
            put_ = compile(value, updating).cast(kind)
            writes.append((F.when(same(attribute), kept).otherwise(put_) if entity.source.on_update == "changed_columns" else put_).alias(f.name))
            inserts.append(compile(value, inserting).cast(kind).alias(f.name))
        elif f.name != key:
            writes.append(kept.alias(f.name))
            inserts.append(literal(f.default).cast(kind).alias(f.name))
    changed = F.aggregate(F.array(*[(~same(a)).cast("int") for a in given] or [F.lit(0)]), F.lit(0), lambda s, x: s + x)
    touched = full.filter("op <> 'insert'").select(F.col(LEGACY_ID).alias("change_id"), F.col(OP), F.struct(*writes).alias("w"), changed.alias("n_changed"))
    added = full.filter("op = 'insert'")
    kind = spark_type(table.field(key).type)
    if added.filter(F.col(LEGACY_ID).isNull()).isEmpty():
        ids = added.withColumn("number", F.col(LEGACY_ID))
    else:
        top = legacy.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"] if top is None else top
        given_id, wanted = F.col(LEGACY_ID), added.filter(F.col(LEGACY_ID).isNull()).count()
        # Given ids in the way of the next free ones: go on above all of them.
        taken = added.agg(F.max(given_id).alias("most"), F.count_if((given_id > top) & (given_id <= top + wanted)).alias("n")).first()
        top = F.lit(max(top, taken["most"]) if taken["n"] else top)
        free = numbered(added.filter(F.col(LEGACY_ID).isNull()), [F.xxhash64("new"), F.to_json("new")], top)
        ids = free.unionByName(added.filter(F.col(LEGACY_ID).isNotNull()).withColumn("number", F.col(LEGACY_ID)))
    ids = ids.withColumn(LEGACY_ID, F.col("number").cast(kind))
    inserted = ids.select(F.col(LEGACY_ID).alias(key), *inserts).select(*table.names())
    rows = legacy.join(touched, legacy[key] == touched["change_id"], "left").filter("op IS NULL OR op <> 'delete'")
    kept = rows.select(*[legacy[n] if n == key else F.when(F.col(OP) == "update", F.col(f"w.{quoted(n)}")).otherwise(legacy[n]).alias(n) for n in table.names()])
    after = kept.unionByName(inserted)
    told = full.filter("op <> 'insert'").select(F.col(LEGACY_ID), F.col(OP)).unionByName(ids.select(LEGACY_ID, OP))
    affected = told.filter("op <> 'delete'").select(F.col(LEGACY_ID).alias("affected_id")).distinct()
    shown = modern_view(entity, replacing(load, table, after), now=now)
    returned = shown.join(affected, shown[LEGACY_ID] == affected["affected_id"], "left_semi")
    events = told.select(F.lit(entity.name).alias("resource"), F.col(LEGACY_ID).cast("string").alias("legacy_id"), OP)
    return PutResult(after, returned, events, refused, touched.select(F.col("change_id").alias("legacy_id"), "op", "n_changed"))


@dataclass
class FilesPut:
    """The version that holds the changes, the files that were rewritten for it, and what ``put`` says of the part in them."""

    version: int
    rewritten: list[str]
    result: PutResult


def put_files(entity: Entity, files: FileTable, load: Load, changes: DataFrame, now: Any = None, validate: bool = True, version: int | None = None) -> FilesPut:
    """``put`` on a table kept in files: the files that hold a changed id are read and rewritten, no others.

    Ids that no file holds are unknown to the table, so the part in those files decides what
    is refused as the whole table would. ``load`` gives the tables that are joined. Of two
    writers that start from one version, the second is refused with ``VersionTaken``. Columns
    that the description does not declare are null in rewritten rows, as they are no part of
    ``put``; a backfill finds such rows open and fills them again.
    """
    table = entity.source.table
    paths = {r.path[: k + 1] for lens in lenses(entity).values() for r in lens.sources for k in range(len(r.path))}
    if any(table.follow(p).name == table.name for p in paths):
        raise DeclarationError(f"{entity.name} joins {table.name} to itself, so all of it is needed: use put")
    base = files.latest() if version is None else version
    ids = changes.filter(F.col(LEGACY_ID).isNotNull()).select(F.col(LEGACY_ID).alias("id")).distinct()
    rewritten = files.touched(ids, base)
    part = named(files.read_files(rewritten), table)
    greatest = files.manifest(base).agg(F.max("high")).first()[0]
    result = put(entity, replacing(load, table, part), changes, now, validate, top=greatest if isinstance(greatest, int) else None)
    stored = result.legacy.select(*[F.col(quoted(f.name)).alias(f.physical) for f in table.fields])
    return FilesPut(files.replace(base, rewritten, stored), rewritten, result)


def as_upsert(entity: Entity, load: Load, rows: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """Changes that update the rows whose identity exists and insert the others.

    Rows with a null in the identity are inserts, nulls being distinct. Rows that repeat
    an identity have no order: they come out as the operation ``repeated identity``,
    which ``put`` refuses.
    """
    if tuple(identity) not in entity.identities:
        raise DeclarationError(f"{entity.name} has no identity {identity}")
    known = modern_view(entity, load, [*identity, LEGACY_ID])
    known = known.select(F.col(LEGACY_ID), *[F.col(i).alias(f"known_{i}") for i in identity])
    on = [rows[i] == known[f"known_{i}"] for i in identity]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    whole = F.lit(True)
    for i in identity:
        whole = whole & F.col(i).isNotNull()
    times = rows.filter(whole).groupBy(*[F.col(i).alias(f"times_{i}") for i in identity]).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    repeated = F.lit(True)
    for i in identity:
        repeated = repeated & (rows[i] == times[f"times_{i}"])
    joined = rows.drop(LEGACY_ID).join(known, condition, "left").join(times, repeated, "left")
    return joined.select(F.when(F.col("times") > 1, "repeated identity").when(F.col(LEGACY_ID).isNull(), "insert").otherwise("update").alias(OP), LEGACY_ID, *[c for c in rows.columns if c != LEGACY_ID])
