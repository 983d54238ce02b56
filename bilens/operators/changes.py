"""Change events: keys of what changed, never its values, and the rows they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LEGACY_ID, Entity, Phase
from ..sources.tables import Load
from .view import modern_view

EVENT = "resource string, legacy_id string, op string"
DEFAULT_CHANNEL = "bilens_changes"
OPS = ("insert", "update", "delete")
#: The action of an event whose entity names none.
ACTION = "legacy_write"


def channel(entity: Entity) -> str:
    """Where an entity's events go: one place for all, unless it names another."""
    return entity.source.channel or DEFAULT_CHANNEL


def emits(entity: Entity) -> bool:
    """Once the new table is read, writes to the old one are no news."""
    return entity.source.notify and entity.phase in (Phase.READ_FROM_LEGACY, Phase.DUAL_WRITE)


def diff(entity: Entity, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(resource, legacy_id, op) for each row that two states of a table differ in; one shuffle on the key."""
    columns = [c for c in after.columns if c != key]
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.struct(*columns).alias(f"{name}_row"))
    joined = side(before, "old").join(side(after, "new"), F.col("old_key") == F.col("new_key"), "full")
    op = F.when(F.col("old_key").isNull(), "insert").when(F.col("new_key").isNull(), "delete").when(~F.col("old_row").eqNullSafe(F.col("new_row")), "update")
    out = joined.select(F.lit(entity.name).alias("resource"), F.coalesce("new_key", "old_key").cast("string").alias("legacy_id"), op.alias("op"))
    return out.filter("op IS NOT NULL")


def collapsed(events: DataFrame) -> DataFrame:
    """Each event once, as within one transaction."""
    return events.select("resource", "legacy_id", "op").dropDuplicates(["resource", "legacy_id", "op"])


def parsed(lines: DataFrame, column: str = "value", allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Events out of JSON lines, and the lines that are none: bad JSON, missing keys, unknown ops or entities."""
    event = F.from_json(F.col(column), EVENT, {"mode": "PERMISSIVE"})
    read = lines.select(F.col(column).alias("line"), event.alias("e"))
    good = F.col("e.resource").isNotNull() & F.col("e.legacy_id").isNotNull() & F.col("e.op").isin(*OPS)
    if allowed is not None:
        good = good & F.col("e.resource").isin(*allowed)
    good = F.coalesce(good, F.lit(False))
    return read.filter(good).select("e.*"), read.filter(~good).select("line")


def reread(entity: Entity, load: Load, events: DataFrame, action: str | None = None, now=None) -> DataFrame:
    """The events' rows as the view shows them now: action, op, ``__legacy_id`` and the attributes.

    A deleted row has its id alone. An event whose row is gone by now is a delete to come,
    and is left out.
    """
    mine = collapsed(events.filter(F.col("resource") == entity.name))
    view = modern_view(entity, load, now=now)
    kind = view.schema[LEGACY_ID].dataType
    asked = mine.select(F.col("op"), F.col("legacy_id").try_cast(kind).alias("event_id"))
    joined = asked.join(view, (F.col("event_id") == view[LEGACY_ID]) & (F.col("op") != "delete"), "left")
    shown = joined.filter((F.col("op") == "delete") | F.col(LEGACY_ID).isNotNull())
    attributes = [c for c in view.columns if c != LEGACY_ID]
    return shown.select(F.lit(action or ACTION).alias("action"), "op", F.col("event_id").alias(LEGACY_ID), *attributes)
