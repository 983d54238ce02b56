"""The declared side of a mapping: legacy tables, entities, and what binds them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from enum import Enum
from typing import Any

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Integer ranges narrower than this are enumerated as value domains.
ENUMERABLE_SPAN = 256
LEGACY_ID = "__legacy_id"


class DeclarationError(ValueError):
    """A declaration that cannot mean anything; the message says what to write instead."""


class Phase(Enum):
    """How far the move from the legacy table has come."""

    READ_FROM_LEGACY = "read_from_legacy"
    DUAL_WRITE = "dual_write"
    READ_FROM_NEW = "read_from_new"
    DECOMMISSIONED = "decommissioned"


#: Declared type -> the name that storage is compared by; widths of integers do not matter.
_STORAGE = {
    "tinyint": "bigint", "smallint": "bigint", "int": "bigint", "integer": "bigint", "bigint": "bigint",
    "float": "double", "double": "double", "boolean": "boolean", "string": "string", "ci_string": "ci_string",
    "uuid": "uuid", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz",
    "binary": "binary", "json": "string",
}
_SPARK = {"ci_string": "string", "uuid": "string", "json": "string", "integer": "int"}


def storage_type(name: str) -> str:
    """What two types are compared by to see whether a cast is needed."""
    name = name.strip().lower()
    if name.startswith("decimal"):
        return "decimal"
    if name.startswith("array<"):
        return f"array<{storage_type(name[6:-1])}>"
    if name not in _STORAGE:
        raise DeclarationError(f"unknown type {name!r}; reach such a column through a fragment instead")
    return _STORAGE[name]


def spark_type(name: str) -> str:
    """The Spark type that holds values of a declared type."""
    storage_type(name)
    if name.startswith("array<"):
        return f"array<{spark_type(name[6:-1])}>"
    return _SPARK.get(name, name)


@dataclass(frozen=True)
class Field:
    """A typed column or attribute: its domain, when it has one, is the closed list of its values."""

    name: str
    type: str
    nullable: bool = True
    one_of: tuple | None = None
    minimum: int | None = None
    maximum: int | None = None
    #: Legacy: the column's real name. Entity: None.
    column: str | None = None
    default: Any = None
    has_default: bool = False
    trim: bool = True
    private: bool = False

    @property
    def physical(self) -> str:
        return self.column or self.name

    def domain(self) -> tuple | None:
        """All values but null, where they can be listed."""
        if self.one_of is not None:
            return tuple(self.one_of)
        if self.type == "boolean":
            return (True, False)
        if self.minimum is not None and self.maximum is not None and self.maximum - self.minimum < ENUMERABLE_SPAN:
            return tuple(range(self.minimum, self.maximum + 1))
        return None


@dataclass(frozen=True)
class Relationship:
    """A way from one legacy table to another; only to-one ways can be followed."""

    name: str
    target: "LegacyTable"
    source_field: str
    target_field: str
    many: bool = False


@dataclass(frozen=True)
class LegacyTable:
    """A typed, read-only description of a legacy relation."""

    name: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    relationships: tuple[Relationship, ...] = ()

    def __post_init__(self) -> None:
        if not self.name:
            raise DeclarationError("a legacy table needs the name of its relation")
        if not self.fields:
            raise DeclarationError(f"{self.name} has no columns; generate its description again")

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise DeclarationError(f"{self.name} has no column {name!r}; the description may be stale")

    def relationship(self, name: str) -> Relationship:
        for r in self.relationships:
            if r.name == name:
                return r
        raise DeclarationError(f"{self.name} has no relationship {name!r}")

    def follow(self, path: tuple[str, ...]) -> "LegacyTable":
        """The table at the end of a path of to-one relationships."""
        table = self
        for step in path:
            way = table.relationship(step)
            if way.many:
                raise DeclarationError(f"{table.name}.{step} is to-many: following it would fan rows out")
            table = way.target
        return table

    def with_relationships(self, *ways: Relationship) -> "LegacyTable":
        return replace(self, relationships=self.relationships + ways)


@dataclass(frozen=True)
class Source:
    """Binds an entity to a legacy table, with its mappings and options."""

    table: LegacyTable
    mappings: tuple
    writes: str = "auto"
    on_update: str = "full_row"
    notify: bool = False
    channel: str | None = None
    interlock: str | None = None

    def __post_init__(self) -> None:
        if self.writes not in ("auto", "triggers", "none"):
            raise DeclarationError("writes is auto, triggers or none")
        if self.on_update not in ("full_row", "changed_columns"):
            raise DeclarationError("on_update is full_row or changed_columns")


@dataclass(frozen=True)
class Entity:
    """The modern record: attributes in order, identities, and one source."""

    name: str
    attributes: tuple[Field, ...]
    source: Source | None = None
    phase: Phase = Phase.READ_FROM_LEGACY
    identities: tuple[tuple[str, ...], ...] = ()
    upserts: bool = False
    nulls_distinct: bool = True
    #: The part of the model that it belongs to, by which commands choose entities.
    domain: str | None = None

    def attribute(self, name: str) -> Field:
        for f in self.attributes:
            if f.name == name:
                return f
        raise DeclarationError(f"{self.name} has no attribute {name!r}")

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.attributes)
