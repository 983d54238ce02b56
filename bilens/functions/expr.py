"""Expressions as data: a small closed language that proofs can read.

References are relative: ``ref("city", "address")`` is column ``city`` reached through
the relationship ``address``. Nothing here knows about Spark; ``compile`` does.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from ..model import DeclarationError


@dataclass(frozen=True)
class Expr:
    """Any node."""


@dataclass(frozen=True)
class Ref(Expr):
    name: str
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Call(Expr):
    op: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Case(Expr):
    """The first pair whose value equals the subject; ``default`` None gives null."""

    subject: Expr
    pairs: tuple[tuple[Any, Any], ...]
    default: Expr | None = None


@dataclass(frozen=True)
class Cond(Expr):
    """The first clause whose guard holds."""

    clauses: tuple[tuple[Expr, Expr], ...]
    default: Expr | None = None


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    type: str


@dataclass(frozen=True)
class AtZone(Expr):
    """Naive time as an instant in a zone, or an instant as that zone's naive time."""

    arg: Expr
    zone: str
    to_naive: bool = False


@dataclass(frozen=True)
class Fragment(Expr):
    """SQL text with ``?`` for each argument: the escape that proofs cannot see into."""

    template: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Touch(Expr):
    """The time of writing, when ``attribute`` changes; else what is stored in ``column``."""

    attribute: str
    column: str


@dataclass(frozen=True)
class Exists(Expr):
    path: tuple[str, ...]
    predicate: Expr


#: Fixed: the calls of the language and how many arguments they take (None: any number).
OPERATIONS = {
    "and": 2, "or": 2, "not": 1, "eq": 2, "ne": 2, "lt": 2, "le": 2, "gt": 2, "ge": 2,
    "add": 2, "sub": 2, "mul": 2, "div": 2, "neg": 1, "in": None, "join": 2, "coalesce": 2,
    "is_null": 1, "lower": 1, "upper": 1, "trim": 1, "length": 1, "abs": 1, "round": 1,
    "ceil": 1, "floor": 1, "least": None, "greatest": None, "now": 0, "today": 0, "list": None,
}


def expr(x: Any) -> Expr:
    """A node as it is, and anything else as a literal."""
    return x if isinstance(x, Expr) else Lit(x)


def ref(name: str, *path: str) -> Ref:
    return Ref(name, tuple(path))


def call(op: str, *args: Any) -> Call:
    if op not in OPERATIONS:
        hint = {"exists": "join the relation by a reference path", "concat": "use join", "like": "use a fragment"}.get(op, "use a fragment")
        raise DeclarationError(f"{op!r} is not in the expression language; {hint}")
    want = OPERATIONS[op]
    if want is not None and len(args) != want:
        raise DeclarationError(f"{op} takes {want} arguments, not {len(args)}")
    return Call(op, tuple(expr(a) for a in args))


def when(*clauses: tuple[Any, Any], default: Any = None) -> Cond:
    return Cond(tuple((expr(g), expr(v)) for g, v in clauses), None if default is None else expr(default))


def if_(guard: Any, then: Any, otherwise: Any = None) -> Expr:
    if guard is True:
        return expr(then)
    return when((guard, then), default=otherwise)


def fragment(template: str, *args: Any) -> Fragment:
    if template.count("?") != len(args):
        raise DeclarationError(f"the fragment has {template.count('?')} places for {len(args)} arguments")
    return Fragment(template, tuple(expr(a) for a in args))


def children(node: Expr) -> tuple[Expr, ...]:
    match node:
        case Call(_, args) | Fragment(_, args):
            return args
        case Case(subject, pairs, default):
            return (subject, *(expr(x) for pair in pairs for x in pair), *([default] if default is not None else []))
        case Cond(clauses, default):
            return (*(x for pair in clauses for x in pair), *([default] if default is not None else []))
        case Cast(arg, _) | AtZone(arg, _, _):
            return (arg,)
        case Exists(path, predicate):
            return (rewrite(predicate, lambda n: Ref(n.name, path + n.path) if isinstance(n, Ref) else n),)
    return ()


def walk(node: Expr) -> Iterator[Expr]:
    """Every node, parents first; references inside ``exists`` start at its relation."""
    yield node
    for child in children(node):
        yield from walk(child)


def refs(node: Expr) -> list[Ref]:
    """References in the order met, each once."""
    return list(dict.fromkeys(n for n in walk(node) if isinstance(n, Ref)))


def reduce(node: Expr, start: Any, f: Callable[[Any, Expr], Any]) -> Any:
    for n in walk(node):
        start = f(start, n)
    return start


def rewrite(node: Expr, f: Callable[[Expr], Expr]) -> Expr:
    """The tree with ``f`` applied to every node, leaves first."""
    go = lambda n: rewrite(n, f) if isinstance(n, Expr) else n
    match node:
        case Call(op, args):
            node = Call(op, tuple(map(go, args)))
        case Fragment(template, args):
            node = Fragment(template, tuple(map(go, args)))
        case Case(subject, pairs, default):
            node = Case(go(subject), tuple((go(a), go(b)) for a, b in pairs), go(default))
        case Cond(clauses, default):
            node = Cond(tuple((go(a), go(b)) for a, b in clauses), go(default))
        case Cast(arg, type_):
            node = Cast(go(arg), type_)
        case AtZone(arg, zone, to_naive):
            node = AtZone(go(arg), zone, to_naive)
        case Exists(path, predicate):
            node = Exists(path, go(predicate))
    return f(node)


def simple_reference(node: Expr) -> Ref | None:
    """The reference that the node is, if it is nothing more."""
    return node if isinstance(node, Ref) else None


def opaque(node: Expr) -> bool:
    return any(isinstance(n, Fragment) for n in walk(node))


_COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


class Undecidable(Exception):
    """The node's value does not follow from the values of its references alone."""


def evaluate(node: Expr, row: dict[Ref, Any]) -> Any:
    """The node's value under SQL's three-valued logic, None being null."""
    go = lambda n: evaluate(expr(n), row)
    match node:
        case Ref():
            if node not in row:
                raise Undecidable(node.name)
            return row[node]
        case Lit(value):
            return value
        case Call("and", (a, b)):
            x, y = go(a), go(b)
            return False if x is False or y is False else None if x is None or y is None else True
        case Call("or", (a, b)):
            x, y = go(a), go(b)
            return True if x is True or y is True else None if x is None or y is None else False
        case Call("not", (a,)):
            x = go(a)
            return None if x is None else not x
        case Call("is_null", (a,)):
            return go(a) is None
        case Call("eq" | "ne", (a, b)) if b == Lit(None) or a == Lit(None):
            x = go(a if b == Lit(None) else b) is None
            return x if node.op == "eq" else not x
        case Call("coalesce", (a, b)):
            x = go(a)
            return go(b) if x is None else x
        case Call("in", (a, *rest)):
            x = go(a)
            values = [go(v) for v in rest]
            return None if x is None else True if x in values else None if None in values else False
        case Call(op, (a, b)) if op in ("eq", "ne", "lt", "le", "gt", "ge"):
            x, y = go(a), go(b)
            if x is None or y is None:
                return None
            return _COMPARE[op](x, y)
        case Cond(clauses, default):
            for guard, value in clauses:
                if go(guard) is True:
                    return go(value)
            return None if default is None else go(default)
        case Case(subject, pairs, default):
            x = go(subject)
            for key, value in pairs:
                if x is not None and go(key) == x:
                    return go(value)
            return None if default is None else go(default)
    raise Undecidable(type(node).__name__)
