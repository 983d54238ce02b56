"""What each phase sets up: ordered steps, applied once, undone in reverse."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..model import Entity, Phase
from ..operators.view import modern_view, reverse_view
from ..sources.tables import Load
from .verify import verify


@dataclass(frozen=True)
class Step:
    """One change: ``name`` tells it apart, so that steps two entities share are taken once."""

    name: str
    apply: Callable[[SparkSession], None]
    undo: Callable[[SparkSession], None]


def _database(name: str) -> Step:
    return Step(
        f"database {name}",
        lambda spark: spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`") and None,
        # RESTRICT: a database that still holds something stays.
        lambda spark: spark.sql(f"DROP DATABASE IF EXISTS `{name}` RESTRICT") and None,
    )


def _view(name: str, make: Callable[[], DataFrame]) -> Step:
    return Step(f"view {name}", lambda spark: make().createOrReplaceTempView(name), lambda spark: spark.catalog.dropTempView(name) and None)


def steps(entity: Entity, load: Load, modern: Callable[[], DataFrame] | None = None, database: str | None = None) -> list[Step]:
    """The phase's steps: the modern view while the legacy table is read, its reverse once the new one is."""
    verify(entity)
    out = [_database(database)] if database and database != "default" else []
    if entity.phase in (Phase.READ_FROM_LEGACY, Phase.DUAL_WRITE):
        out.append(_view(entity.name, lambda: modern_view(entity, load)))
    elif entity.phase is Phase.READ_FROM_NEW:
        if modern is None:
            raise ValueError(f"{entity.name} is read from its new table, so that table must be given")
        out.append(_view(entity.source.table.name, lambda: reverse_view(entity, modern())))
    return out


def plan(entities: Iterable[Entity], load: Load, modern: dict[str, Callable[[], DataFrame]] | None = None, database: str | None = None) -> list[Step]:
    """All entities' steps, each name once, in order."""
    by_name: dict[str, Step] = {}
    for e in entities:
        for s in steps(e, load, (modern or {}).get(e.name), database):
            by_name.setdefault(s.name, s)
    return list(by_name.values())


def apply(spark: SparkSession, todo: Iterable[Step]) -> list[str]:
    done = []
    for s in todo:
        s.apply(spark)
        done.append(s.name)
    return done


def undo(spark: SparkSession, done: Iterable[Step]) -> list[str]:
    """The exact reverse."""
    back = []
    for s in reversed(list(done)):
        s.undo(spark)
        back.append(s.name)
    return back


def fingerprint(todo: Iterable[Step]) -> str:
    """Changes when the steps do."""
    return hashlib.sha256("\n".join(s.name for s in todo).encode()).hexdigest()


#: Entities that a program declares, by name.
REGISTRY: dict[str, Entity] = {}


def declare(entity: Entity) -> Entity:
    """Register an entity, for reports over all of them."""
    REGISTRY[entity.name] = entity
    return entity


def declared() -> list[Entity]:
    return [REGISTRY[n] for n in sorted(REGISTRY) if REGISTRY[n].source is not None]
