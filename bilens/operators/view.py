"""The two views: the modern one over legacy tables, and the legacy one over the modern table."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.compile import Frame, alias_of, bare, compile, qualified, quoted
from ..functions.keys import uuid5_column
from ..model import LEGACY_ID, DeclarationError, Entity, spark_type, storage_type
from ..plans.lens import Lens, inverse_literal, key_of, lenses
from ..sources.tables import Load

#: Stored legacy columns beside a view's attributes carry this before their names.
STORED = "stored__"


def join_paths(chosen: Iterable[Lens]) -> list[tuple[str, ...]]:
    """Every path that some reference goes, with the paths on the way, short ones first."""
    paths = {r.path[: k + 1] for lens in chosen for r in lens.sources for k in range(len(r.path))}
    return sorted(paths, key=lambda p: (len(p), p))


def joined_source(entity: Entity, load: Load, chosen: Iterable[Lens], where: Column | None = None) -> DataFrame:
    """The legacy table, LEFT joined along the paths that ``chosen`` needs and no others.

    Leaving a join out keeps the rows as they are only if the way is to-one in the data
    as well; the fan-out check measures that.
    """
    table = entity.source.table
    df = load(table)
    if where is not None:
        df = df.filter(where)
    df = df.alias(alias_of(()))
    for path in join_paths(chosen):
        before, way = path[:-1], table.follow(path[:-1]).relationship(path[-1])
        target = table.follow(path)
        on = F.col(quoted(alias_of(before), way.source_field)) == F.col(quoted(alias_of(path), way.target_field))
        df = df.join(load(target).alias(alias_of(path)), on, "left")
    return df


def key_column(entity: Entity, frame: Frame) -> Column:
    """The derived key; the same text everywhere a key is made."""
    key = key_of(entity)
    legacy = compile(key.source, frame)
    if key.namespace:
        return uuid5_column(key.namespace, entity.source.table.name, legacy)
    return legacy.cast(spark_type(entity.attribute(key.attribute).type))


def attribute_column(entity: Entity, lens: Lens, frame: Frame) -> Column:
    if lens.combinator == "key":
        return key_column(entity, frame)
    column = compile(lens.forward, frame)
    declared = entity.attribute(lens.attribute).type
    plain = lens.combinator == "rename" and storage_type(declared) != "decimal"
    return column if plain else column.cast(spark_type(declared))


def modern_view(entity: Entity, load: Load, columns: Iterable[str] | None = None, now: Any = None, where: Column | None = None, stored: bool = False) -> DataFrame:
    """The entity as a projection of the legacy table: its attributes and ``__legacy_id``.

    With ``columns``, only those and only their joins. Integers keep their stored width
    where they are only renamed. ``stored`` adds the legacy row's own columns.
    """
    by_name = lenses(entity)
    missing = [a.name for a in entity.attributes if a.name not in by_name and not a.private]
    if missing:
        raise DeclarationError(f"{entity.name} has no source for {', '.join(missing)}")
    wanted = list(columns) if columns is not None else list(by_name)
    unknown = [c for c in wanted if c not in by_name and c != LEGACY_ID]
    if unknown:
        raise DeclarationError(f"{entity.name} has no mapped attribute {', '.join(unknown)}")
    frame = qualified(now, entity.source.table)
    chosen = [by_name[c] for c in wanted if c != LEGACY_ID]
    key = key_of(entity)
    first = [c for c in wanted if c == key.attribute]
    rest = [c for c in wanted if c not in (key.attribute, LEGACY_ID)]
    out = [attribute_column(entity, by_name[c], frame).alias(c) for c in first]
    if columns is None or LEGACY_ID in wanted:
        out.append(compile(key.source, frame).alias(LEGACY_ID))
    out += [attribute_column(entity, by_name[c], frame).alias(c) for c in rest]
    if stored:
        out += [F.col(quoted(alias_of(()), n)).alias(STORED + n) for n in entity.source.table.names()]
    return joined_source(entity, load, chosen, where).select(*out)


def find(entity: Entity, load: Load, attribute: str, value: Any, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows whose attribute equals ``value``; by the stored column where the lens is a proven bijection.

    A decode or negation hides its column from the scan's filters, so the value is taken
    back through the lens and compared there. Other lenses are filtered on the view.
    """
    lens = lenses(entity)[attribute]
    if lens.combinator == "key" and not key_of(entity).namespace:
        back = (E.simple_reference(lens.forward).name, value)
    else:
        back = inverse_literal(lens, value)
    if back is not None:
        return modern_view(entity, load, columns, where=F.col(quoted(back[0])) == F.lit(back[1]))
    wanted = list(columns) if columns is not None else None
    extra = [] if wanted is None or attribute in wanted else [attribute]
    found = modern_view(entity, load, None if wanted is None else wanted + extra).filter(F.col(quoted(attribute)) == F.lit(value))
    return found.drop(*extra)


def write_targets(entity: Entity, by_name: dict[str, Lens] | None = None) -> dict[str, tuple[str, E.Expr]]:
    """Legacy column -> (attribute, expression); the first write of a column wins, columns in order."""
    found: dict[str, tuple[str, E.Expr]] = {}
    for lens in (by_name or lenses(entity)).values():
        for column, value in lens.writes:
            found.setdefault(column, (lens.attribute, value))
    return dict(sorted(found.items()))


def reverse_view(entity: Entity, modern: DataFrame, legacy_id: str = "legacy_id", now: Any = None) -> DataFrame:
    """The legacy relation's shape over the new table, for readers that have not moved yet."""
    table = entity.source.table
    weak = [lens.attribute for lens in lenses(entity).values() if lens.invertible != "yes" and lens.kind != "structural"]
    if weak:
        raise DeclarationError(f"{entity.name} cannot be read back: {', '.join(weak)} lose what they read")
    if join_paths(lenses(entity).values()):
        raise DeclarationError(f"{entity.name} cannot be read back: it joins other tables")
    key = E.simple_reference(key_of(entity).source).name
    frame = bare(now=now, types=lambda r: entity.attribute(r.name).type)
    out = [F.col(quoted(legacy_id)).cast(spark_type(table.field(key).type)).alias(table.field(key).physical)]
    for column, (_, value) in write_targets(entity).items():
        if column != key:
            f = table.field(column)
            out.append(compile(value, frame).cast(spark_type(f.type)).alias(f.physical))
    return modern.select(*out)


def page(view: DataFrame, after: Any = None, size: int = 1000, key: str = LEGACY_ID) -> DataFrame:
    """The ``size`` rows of least key above ``after``: a page that the last one's greatest key leads to."""
    rows = view if after is None else view.filter(F.col(quoted(key)) > F.lit(after))
    return rows.orderBy(quoted(key)).limit(size)


def register(df: DataFrame, name: str) -> None:
    """Make a view readable by SQL under ``name``."""
    df.createOrReplaceTempView(name)


