"""The combinators: each says how an attribute comes from legacy columns, both ways at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.expr import Expr, Touch, expr, ref
from ..model import IDENTIFIER, DeclarationError

OTHERWISE = "otherwise"


def _origin(x: Any, slot: str) -> Expr:
    """A column name or an expression; SQL text has no place here."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, str) and IDENTIFIER.match(x):
        return ref(x)
    raise DeclarationError(f"{slot} takes a column's name or an expression, not SQL text {x!r}: use ref() for a column, call() for a function, fragment() for anything else")


@dataclass(frozen=True)
class Mapping:
    """What every combinator has."""

    attribute: str
    read_only: bool = field(default=False, kw_only=True)
    because: str | None = field(default=None, kw_only=True)


@dataclass(frozen=True)
class Map(Mapping):
    """A column as it is, cast where storage differs, or an expression that is only read."""

    source: Any = None
    zone: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "source", _origin(self.attribute if self.source is None else self.source, "source"))


@dataclass(frozen=True)
class Decode(Mapping):
    """A table of legacy values and modern ones; ``null_as`` is what a null legacy value means."""

    source: Any = None
    values: tuple[tuple[Any, Any], ...] = ()
    null_as: Any = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "source", _origin(self.attribute if self.source is None else self.source, "source"))
        pairs = self.values.items() if isinstance(self.values, dict) else self.values
        object.__setattr__(self, "values", tuple(sorted(pairs, key=lambda p: (str(type(p[0])), p[0]))))
        if not self.values:
            raise DeclarationError(f"{self.attribute}: a decode needs values")


@dataclass(frozen=True)
class Clause:
    """A state: when it holds in legacy columns, and what to write there for it."""

    value: Any
    when: Any
    set: tuple[tuple[str, Any], ...] = ()

    def __post_init__(self) -> None:
        pairs = self.set.items() if isinstance(self.set, dict) else self.set
        object.__setattr__(self, "set", tuple(pairs))


TOUCH = Touch("", "")


@dataclass(frozen=True)
class Collapse(Mapping):
    """Several columns read as one state, and a state written as several columns."""

    clauses: tuple[Clause, ...] = ()
    hit_policy: str = "first"

    def __post_init__(self) -> None:
        if self.hit_policy not in ("first", "unique"):
            raise DeclarationError("hit_policy is first or unique")
        if not self.clauses:
            raise DeclarationError(f"{self.attribute}: a collapse needs clauses")
        fallbacks = [i for i, c in enumerate(self.clauses) if c.when == OTHERWISE]
        if len(fallbacks) > 1 or fallbacks and fallbacks[0] != len(self.clauses) - 1:
            raise DeclarationError(f"{self.attribute}: otherwise comes once, and last")
        columns = [sorted(n for n, _ in c.set) for c in self.clauses if c.set]
        if any(c != columns[0] for c in columns) or columns and len(columns) != len(self.clauses):
            raise DeclarationError(f"{self.attribute}: every clause sets the same columns, else a write would store null")


@dataclass(frozen=True)
class Default(Mapping):
    """A value that stands for null."""

    source: Any = None
    default: Any = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "source", _origin(self.attribute if self.source is None else self.source, "source"))
        if self.default is None:
            raise DeclarationError(f"{self.attribute}: the default must be a value")


@dataclass(frozen=True)
class Concat(Mapping):
    """Columns joined by a separator."""

    sources: tuple[Any, ...] = ()
    separator: str = " "

    def __post_init__(self) -> None:
        object.__setattr__(self, "sources", tuple(_origin(s, "sources") for s in self.sources))
        if not self.sources or not self.separator:
            raise DeclarationError(f"{self.attribute}: a concat needs columns and a separator that can be found again")


@dataclass(frozen=True)
class Negate(Mapping):
    """The opposite of a boolean column."""

    source: Any = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "source", _origin(self.attribute if self.source is None else self.source, "source"))


@dataclass(frozen=True)
class Affine(Mapping):
    """column * multiply + add."""

    source: Any = None
    multiply: Any = 1
    add: Any = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "source", _origin(self.attribute if self.source is None else self.source, "source"))
        if self.multiply == 0:
            raise DeclarationError(f"{self.attribute}: multiplying by 0 loses the column")


@dataclass(frozen=True)
class Constant(Mapping):
    """One value for every row."""

    value: Any = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "value", expr(self.value))


@dataclass(frozen=True)
class Unmapped(Mapping):
    """No source: null, or the attribute's default; a reason is asked for."""

    as_: str = "null"

    def __post_init__(self) -> None:
        if self.as_ not in ("null", "default"):
            raise DeclarationError("an unmapped attribute is null or default")
        if not (self.because or "").strip():
            raise DeclarationError(f"{self.attribute}: say why it is unmapped, with because")


@dataclass(frozen=True)
class Key(Mapping):
    """The key: the legacy key as it is, or a version 5 UUID of it under ``namespace``."""

    attribute: str = "id"
    source: Any = "id"
    namespace: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "source", _origin(self.source, "source"))
