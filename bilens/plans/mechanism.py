"""How each attribute could be written, and how it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Entity
from .lens import Lens, lenses

#: Fixed: from the least machinery to the most. What needs a trigger on the base table is
#: carried by the view's own trigger.
TIERS = ("none", "plain", "base_trigger", "instead_of")


def ideal(lens: Lens) -> str:
    """none: not written. plain: a column under another name. base_trigger: one row's own columns. instead_of: more."""
    if not lens.writes:
        return "none"
    if any(r.path for r in lens.sources) or len(lens.writes) > 1:
        return "instead_of"
    return "plain" if lens.combinator == "rename" else "base_trigger"


def emitted(tier: str) -> str:
    return "instead_of" if tier == "base_trigger" else tier


def report(entity: Entity) -> list[tuple[str, str, str]]:
    """(attribute, ideal, emitted), in the entity's order."""
    return [(a, ideal(lens), emitted(ideal(lens))) for a, lens in lenses(entity).items()]


def of_entity(entity: Entity) -> str:
    """The strongest tier emitted; any join makes the whole view one that cannot be updated plainly."""
    found = lenses(entity).values()
    tiers = [emitted(ideal(x)) for x in found]
    if any(r.path for x in found for r in x.sources):
        tiers.append("instead_of")
    return max(tiers, key=TIERS.index, default="none")


def writes(entity: Entity) -> str:
    """What carries writes: a declared choice, or what the mechanism asks for."""
    if entity.source.writes != "auto":
        return entity.source.writes
    return {"none": "none", "plain": "auto"}.get(of_entity(entity), "triggers")


def report_frame(spark: SparkSession, entity: Entity) -> DataFrame:
    return spark.createDataFrame(report(entity), "attribute string, ideal string, emitted string")
