"""What a declaration says, asked by name."""

from __future__ import annotations

from pyspark.sql.types import StructType

from ..functions.compile import alias_of
from ..model import LEGACY_ID, Entity, LegacyTable, spark_type
from ..operators.changes import DEFAULT_CHANNEL, channel
from ..operators.view import join_paths
from ..sources.tables import Load
from . import mappings as M
from . import mechanism
from .lens import key_of, lenses

__all__ = ["DEFAULT_CHANNEL", "channel", "key_of", "lenses"]


def bound(entity: Entity) -> bool:
    """Whether the entity is read from a legacy table at all."""
    return entity.source is not None


def table(entity: Entity) -> LegacyTable:
    return entity.source.table


def relation(entity: Entity) -> str:
    return entity.source.table.name


def primary_alias() -> str:
    """The alias that references without a path are under."""
    return alias_of(())


def mappings(entity: Entity) -> list[M.Mapping]:
    """Mappings that read columns: neither keys, constants nor unmapped attributes."""
    return [m for m in entity.source.mappings if not isinstance(m, (M.Key, M.Constant, M.Unmapped))]


def constants(entity: Entity) -> list[M.Constant]:
    return [m for m in entity.source.mappings if isinstance(m, M.Constant)]


def unmapped(entity: Entity) -> list[M.Unmapped]:
    return [m for m in entity.source.mappings if isinstance(m, M.Unmapped)]


def accounted_for(entity: Entity) -> set[str]:
    """Attributes with any mapping; the others must be private."""
    return {m.attribute for m in entity.source.mappings}


def writes(entity: Entity) -> str:
    return mechanism.writes(entity)


def on_update(entity: Entity) -> str:
    return entity.source.on_update


def interlocked(entity: Entity) -> bool:
    """Whether writes set a backfill's progress flag."""
    return entity.source.interlock is not None


def notifies(entity: Entity) -> bool:
    return entity.source.notify


def joins(entity: Entity) -> list[tuple[str, ...]]:
    """The paths that the view follows, those on the way first."""
    return join_paths(lenses(entity).values())


def join_aliases(entity: Entity) -> dict[tuple[str, ...], str]:
    return {p: alias_of(p) for p in joins(entity)}


def view_schema(entity: Entity, load: Load) -> StructType:
    """The types of the view, from the plan alone."""
    from ..operators.view import modern_view

    return modern_view(entity, load).schema


def declared_schema(entity: Entity) -> dict[str, str]:
    """The Spark types that the attributes are declared with."""
    return {LEGACY_ID: spark_type(next(f.type for f in table(entity).fields if f.name == key_of(entity).source.name)), **{a.name: spark_type(a.type) for a in entity.attributes}}
