"""Reading legacy tables under their declared names, and describing tables that exist."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DeclarationError, Field, LegacyTable, Relationship

Load = Callable[[LegacyTable], DataFrame]


class StaleDescription(DeclarationError):
    """The table no longer has what its description names."""


def named(df: DataFrame, table: LegacyTable) -> DataFrame:
    """Only the declared columns, by their declared names: a projection that reaches the scan."""
    missing = [f.physical for f in table.fields if f.physical not in df.columns]
    if missing:
        raise StaleDescription(f"{table.name} has no column {', '.join(missing)}; its description is stale")
    return df.select(*[F.col(f"`{f.physical}`").alias(f.name) for f in table.fields])


def loading(raw: Load) -> Load:
    """A load of declared columns; ``raw`` stays at hand, for what a table really has."""

    def load(table: LegacyTable) -> DataFrame:
        return named(raw(table), table)

    load.raw = raw
    return load


def as_stored(load: Load, table: LegacyTable) -> DataFrame:
    """The table with the columns that it has, declared or not, where ``load`` knows them."""
    raw = getattr(load, "raw", None)
    return raw(table) if raw else load(table).select(*[F.col(f"`{f.name}`").alias(f.physical) for f in table.fields])


def parquet(spark: SparkSession, folder: str, suffix: str = ".parquet") -> Load:
    """Tables as Parquet under a folder."""
    return loading(lambda table: spark.read.parquet(f"{folder}/{table.name}{suffix}"))


def frames(**by_name: DataFrame) -> Load:
    """Tables as given DataFrames, by relation name."""

    def raw(table: LegacyTable) -> DataFrame:
        if table.name not in by_name:
            raise DeclarationError(f"no DataFrame was given for {table.name}")
        return by_name[table.name]

    return loading(raw)


def catalog(spark: SparkSession) -> Load:
    """Tables and views of the session's catalog."""
    return loading(lambda table: spark.table(table.name))


def replacing(load: Load, table: LegacyTable, df: DataFrame) -> Load:
    """``load``, but ``df`` (declared names) for one table."""
    return lambda t: df if t.name == table.name else load(t)


_DECLARED = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint"}


def declared_type(spark_type: str) -> str | None:
    """The declared type of a Spark type; None for what can only be reached by a fragment."""
    name = _DECLARED.get(spark_type, spark_type)
    if re.match(r"decimal\(\d+,\s*\d+\)$|array<[a-z_]+>$", name) or name in {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string", "date", "timestamp", "timestamp_ntz", "binary"}:
        return name
    return None


def describe(df: DataFrame, name: str, primary_key: Iterable[str] = (), uniques: Iterable[Iterable[str]] = (), domains: dict[str, tuple] | None = None, foreign_keys: dict[str, tuple[LegacyTable, str]] | None = None) -> tuple[LegacyTable, list[str]]:
    """A description of an existing table, and the columns that it leaves out.

    Files carry no keys or domains, so those given here are declarations, to be
    measured by the checks. A foreign key becomes a to-one relationship named after its
    column without ``_id``, or after the other table. Unique sets over a column left out
    are dropped, and so is the primary key's own.
    """
    fields, left_out = [], []
    for f in df.schema.fields:
        kind = declared_type(f.dataType.simpleString())
        if kind is None:
            left_out.append(f.name)
            continue
        fields.append(Field(f.name, kind, f.nullable, one_of=tuple((domains or {})[f.name]) if f.name in (domains or {}) else None))
    have, key = {f.name for f in fields}, tuple(primary_key)
    sets = tuple(u for u in map(tuple, uniques) if set(u) <= have and u != key)
    ways = tuple(
        Relationship(c[:-3] if c.endswith("_id") and len(c) > 3 else target.name, target, c, there) for c, (target, there) in (foreign_keys or {}).items() if c in have
    )
    return LegacyTable(name, tuple(fields), key, sets, ways), left_out


def observed_domain(df: DataFrame, column: str, limit: int = 256) -> tuple | None:
    """The values that occur, if they are no more than ``limit``: observed, which is less than declared."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else tuple(sorted(r[0] for r in rows))


_CHECK = re.compile(r"\s*(?:CHECK\s*)?\(*\s*(\w+)\s*(?:=\s*ANY\s*\(+ARRAY\[(.*)\]\)*|IN\s*\((.*)\)|=\s*('(?:[^']|'')*'))\s*\)*\s*", re.IGNORECASE | re.DOTALL)
_QUOTED = re.compile(r"'((?:[^']|'')*)'(?:::[a-z ]+)?")


def check_domain(clause: str) -> tuple[str, tuple[str, ...]] | None:
    """Column and values of a check over one column that lists strings; None for anything more."""
    found = _CHECK.fullmatch(clause)
    if not found:
        return None
    body = next(x for x in found.groups()[1:] if x is not None)
    values = [v.replace("''", "'") for v in _QUOTED.findall(body)]
    rest = _QUOTED.sub("", body)
    return None if not values or rest.strip(" ,") else (found.group(1), tuple(values))


def render(table: LegacyTable) -> str:
    """Python text that declares the table."""
    ways = {r.name: f"Relationship({r.name!r}, {r.target.name.upper()}, {r.source_field!r}, {r.target_field!r}, {r.many!r})" for r in table.relationships}
    lines = [f"{table.name.upper()} = LegacyTable(", f"    {table.name!r},", "    ("]
    for f in table.fields:
        extra = f", one_of={f.one_of!r}" if f.one_of else ""
        extra += f", column={f.column!r}" if f.column else ""
        lines.append(f"        Field({f.name!r}, {f.type!r}, {f.nullable!r}{extra}),")
    lines += ["    ),", f"    primary_key={table.primary_key!r},", f"    uniques={table.uniques!r},"]
    lines += ["    relationships=(", *(f"        {w}," for w in ways.values()), "    ),"] if ways else []
    return "\n".join([*lines, ")"]) + "\n"
