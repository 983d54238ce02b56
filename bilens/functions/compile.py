"""Expressions to Spark columns, given where references point."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DeclarationError, LegacyTable, spark_type, storage_type
from . import expr as E


class Frame:
    """Where references point, as quoted names: the legacy row, the row being written, or the row before it.

    ``types`` says what a reference is declared as, where that is known.
    """

    def __init__(self, lookup: Callable[[E.Ref], str], now: Any = None, old: Callable[[str], str] | None = None, stored: Callable[[str], str] | None = None, types: Callable[[E.Ref], str] | None = None) -> None:
        self.name, self._now, self.old, self.stored, self.types = lookup, now, old, stored, types

    def column(self, reference: E.Ref) -> Column:
        return F.col(self.name(reference))

    def now(self) -> Column:
        return F.current_timestamp() if self._now is None else F.lit(self._now).cast("timestamp")

    def today(self) -> Column:
        return F.current_date() if self._now is None else self.now().cast("date")


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def bare(names: dict[str, str] | None = None, now: Any = None, types: Callable[[E.Ref], str] | None = None) -> Frame:
    """References are columns of one table, renamed by ``names`` where it has them."""

    def lookup(r: E.Ref) -> str:
        if r.path:
            raise DeclarationError(f"{'.'.join((*r.path, r.name))} is behind a join, and this frame has one table")
        return quoted((names or {}).get(r.name, r.name))

    return Frame(lookup, now, types=types)


def alias_of(path: tuple[str, ...]) -> str:
    """The alias of a joined table: its whole path, so that two ways to one name stay apart."""
    return "__".join(("legacy", *path))


def qualified(now: Any = None, table: LegacyTable | None = None) -> Frame:
    """References are columns of aliased tables, by their path from ``table``."""
    return Frame(lambda r: quoted(alias_of(r.path), r.name), now, types=table and (lambda r: table.follow(r.path).field(r.name).type))


def literal(value: Any) -> Column:
    """The one place where values become columns; what no engine can hold is refused."""
    if isinstance(value, str) and "\0" in value:
        raise DeclarationError("a string with a NUL byte cannot be stored")
    if isinstance(value, Decimal) and not value.is_finite():
        raise DeclarationError("a decimal must be finite")
    if isinstance(value, float) and not math.isfinite(value):
        raise DeclarationError("a number must be finite")
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, datetime) and value.tzinfo is None:
        return F.to_timestamp_ntz(F.lit(value.isoformat(sep=" ")))
    if value is None or isinstance(value, (bool, int, float, str, bytes, Decimal, date, datetime)):
        return F.lit(value)
    raise DeclarationError(f"{type(value).__name__} values cannot be written as literals")


def naive_to_instant(c: Column, zone: str) -> Column:
    """Session-independent: the naive time is written with its zone and read as an instant."""
    return F.concat(c.cast("timestamp_ntz").cast("string"), F.lit(f" {zone}")).cast("timestamp")


def instant_to_naive(c: Column, zone: str) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit(zone), c.cast("timestamp_ntz"))


_BINARY = {
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "add": lambda a, b: a + b, "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b, "join": lambda a, b: F.concat(a, b), "coalesce": lambda a, b: F.coalesce(a, b),
}
_UNARY = {"not": lambda a: ~a, "neg": lambda a: -a, "is_null": lambda a: a.isNull(), "lower": F.lower, "upper": F.upper, "trim": F.btrim, "length": F.length, "abs": F.abs, "round": F.round, "ceil": F.ceil, "floor": F.floor}


_WHOLE = ("tinyint", "smallint", "int", "bigint")
_WHOLE_IF_ARGS_ARE = ("add", "sub", "mul", "div", "neg", "abs", "round", "ceil", "floor", "least", "greatest", "coalesce")


def is_whole(node: E.Expr, frame: Frame) -> bool | None:
    """Whether a value is a whole number, by what its references are declared as; None where that cannot be told."""
    match node:
        case E.Ref():
            return None if frame.types is None else storage_type(frame.types(node)) == "bigint"
        case E.Lit(value):
            return None if value is None else isinstance(value, int) and not isinstance(value, bool)
        case E.Cast(_, type_):
            return storage_type(type_) == "bigint"
        case E.Call("length", _):
            return True
        case E.Call(op, args) if op in _WHOLE_IF_ARGS_ARE:
            kinds = [is_whole(E.expr(a), frame) for a in args]
            return True if all(kinds) else False if False in kinds and op not in ("ceil", "floor") else None
    return None


def _divided(x: Column, y: Column, whole: bool | None) -> Column:
    """Of whole numbers the whole quotient, towards zero; null where the divisor is zero, or the quotient is beyond a bigint.

    Where ``whole`` is not known, the values' types decide as the query runs; the result is a
    double then, which is exact up to 2^53.
    """
    if whole is False:
        return F.try_divide(x, y)
    x_, y_ = x.cast("bigint"), y.cast("bigint")
    # The least bigint has no counterpart above zero.
    quotient = F.when(y_ == -1, F.try_subtract(F.lit(0).cast("bigint"), x_)).otherwise(F.call_function("div", x_, F.nullif(y_, F.lit(0).cast("bigint"))))
    if whole:
        return quotient
    return F.when(F.typeof(x).isin(*_WHOLE) & F.typeof(y).isin(*_WHOLE), quotient).otherwise(F.try_divide(x, y))


def compile(node: E.Expr, frame: Frame) -> Column:  # noqa: A001
    """A native column; nodes outside the language are refused by name."""
    go = lambda n: compile(E.expr(n), frame)
    match node:
        case E.Ref():
            return frame.column(node)
        case E.Lit(value):
            return literal(value)
        case E.Call("eq", (a, E.Lit(None))) | E.Call("eq", (E.Lit(None), a)):
            return go(a).isNull()
        case E.Call("ne", (a, E.Lit(None))) | E.Call("ne", (E.Lit(None), a)) | E.Call("not", (E.Call("is_null", (a,)),)):
            return go(a).isNotNull()
        case E.Call("eq", (a, b)):
            return go(a) == go(b)
        case E.Call("ne", (a, b)):
            return go(a) != go(b)
        case E.Call("div", (a, b)):
            kinds = [is_whole(E.expr(n), frame) for n in (a, b)]
            return _divided(go(a), go(b), True if all(kinds) else False if False in kinds else None)
        case E.Call("in", (a, *values)):
            return go(a).isin(*[go(v) for v in values])
        case E.Call("least" | "greatest" as op, args):
            return getattr(F, op)(*map(go, args))
        case E.Call("list", args):
            return F.array(*map(go, args))
        case E.Call("now", ()):
            return frame.now()
        case E.Call("today", ()):
            return frame.today()
        case E.Call(op, (a, b)) if op in _BINARY:
            return _BINARY[op](go(a), go(b))
        case E.Call(op, (a,)) if op in _UNARY:
            return _UNARY[op](go(a))
        case E.Cond(clauses, default):
            out = F
            for guard, value in clauses:
                out = out.when(go(guard).cast("boolean"), go(value))
            return out if default is None else out.otherwise(go(default))
        case E.Case(subject, pairs, default):
            x, out = go(subject), F
            for key, value in pairs:
                out = out.when(x == go(key), go(value))
            return (F.lit(None) if out is F else out) if default is None else (go(default) if out is F else out.otherwise(go(default)))
        case E.Cast(arg, type_):
            return go(arg).cast(spark_type(type_))
        case E.AtZone(arg, zone, to_naive):
            return instant_to_naive(go(arg), zone) if to_naive else naive_to_instant(go(arg), zone)
        case E.Fragment():
            return F.expr(_splice(node, frame))
        case E.Touch(attribute, column):
            if frame.old is None or frame.stored is None:
                return frame.now()
            changed = ~F.col(frame.old(attribute)).eqNullSafe(frame.column(E.Ref(attribute)))
            return F.when(changed, frame.now()).otherwise(F.col(frame.stored(column)).cast("timestamp"))
        case E.Exists():
            raise DeclarationError("exists is not printable here; write it as a fragment over a joined column")
        case E.Call(op, _):
            raise DeclarationError(f"{op!r} is not in the expression language; use a fragment")
    raise DeclarationError(f"{type(node).__name__} is not in the expression language")


def _splice(fragment: E.Fragment, frame: Frame) -> str:
    """SQL text with names and plain literals in its places, so that it stays inside the query's own plan."""

    def text(arg: E.Expr) -> str:
        match arg:
            case E.Ref():
                return frame.name(arg)
            case E.Fragment():
                return f"({_splice(arg, frame)})"
            case E.Lit(None):
                return "NULL"
            case E.Lit(bool() as v):
                return str(v).upper()
            case E.Lit(int() as v):
                return str(v)
            case E.Lit(str() as v) if "\0" not in v:
                return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        raise DeclarationError("a fragment's arguments are references, whole numbers, strings, booleans or fragments")

    parts = fragment.template.split("?")
    return parts[0] + "".join(text(a) + p for a, p in zip(fragment.args, parts[1:]))
