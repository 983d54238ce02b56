"""What must hold for a mapping to mean the same both ways: proven over finite domains, or measured."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import islice, product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.compile import compile, literal, qualified
from ..model import Entity, Field, LegacyTable, storage_type
from . import mappings as M
from .lens import Lens, lenses

#: Cells of an incomplete table that a message shows.
SHOWN = 3
#: Assignments that an enumeration looks at, at most; beyond it cases are searched for.
MOST_CELLS = 1 << 16
#: Steps of one search, at most; beyond it the table is measured.
MOST_STEPS = 20_000
#: Values of an atom's free columns that a step tries, at most; with more the atom may be anything.
FEW_VALUES = 512


@dataclass(frozen=True)
class Finding:
    """One obligation that fails, or that only data can decide; ``assertion`` returns its violations."""

    obligation: str
    attribute: str
    severity: str
    message: str
    assertion: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)


def _field(table: LegacyTable, r: E.Ref) -> Field:
    return table.follow(r.path).field(r.name)


def _where(condition: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    """A measurement; its condition is built when it is taken, so that proofs need no session."""

    def violations(df: DataFrame) -> DataFrame:
        return df.filter(condition())

    violations.condition = condition  # for those who measure many at once
    return violations


def _column(e: E.Expr) -> Column:
    return compile(e, qualified())


def _decode(lens: Lens, entity: Entity) -> Iterable[Finding]:
    m, a = lens.mapping, entity.attribute(lens.attribute)
    source = E.simple_reference(m.source)
    keys, values = [k for k, _ in m.values], [v for _, v in m.values]
    legacy = _field(entity.source.table, source) if source else None
    domain = legacy.domain() if legacy else None
    outside = lambda: ~_column(m.source).isin(*[literal(k) for k in keys])
    if domain is None:
        yield Finding("get_total", a.name, "warning", f"{a.name}: the legacy values are not declared, so only data can say that all are in the table", _where(outside))
    elif missing := [v for v in domain if v not in keys]:
        yield Finding("get_total", a.name, "error", f"{a.name}: no modern value for {', '.join(map(repr, missing))}", _where(outside))
    if legacy is not None and legacy.nullable and m.null_as is None and not a.nullable:
        yield Finding("get_null", a.name, "warning", f"{a.name} may not be null, and a null legacy value stays null", _where(lambda: _column(m.source).isNull()))
    if lens.writes:
        modern = a.domain()
        allowed = values + ([m.null_as] if m.null_as is not None else [])
        if modern is None:
            yield Finding("put_total", a.name, "error", f"{a.name}: its values are not listed, so some cannot be written back; declare one_of or bounds")
        elif missing := [v for v in modern if v not in allowed]:
            yield Finding("put_total", a.name, "error", f"{a.name}: no legacy value for {', '.join(map(repr, missing))}")
        twice = {v: [k for k, w in m.values if w == v] for v, n in Counter(values).items() if n > 1}
        if twice:
            table = "; ".join(f"{' and '.join(map(repr, ks))} both read as {v!r}, which writes {ks[0]!r}" for v, ks in twice.items())
            yield Finding("put_get", a.name, "error", f"{a.name} is not injective: {table}")
    wrong = [v for v in values if not _fits(v, a.type)]
    if wrong:
        yield Finding("type_agreement", a.name, "error", f"{a.name} is {a.type}, and the table gives {', '.join(map(repr, wrong))}")


def _fits(value: Any, kind: str) -> bool:
    storage = storage_type(kind)
    if value is None:
        return True
    if storage == "boolean":
        return isinstance(value, bool)
    if storage in ("bigint", "decimal", "double"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and not (storage == "bigint" and isinstance(value, float))
    return isinstance(value, str) if storage in ("string", "ci_string", "uuid") else True


def _atoms(guard: E.Expr) -> list[E.Expr]:
    match guard:
        case E.Call("and" | "or", (a, b)):
            return [*_atoms(a), *_atoms(b)]
        case E.Call("not", (a,)):
            return _atoms(a)
        case E.Lit():
            return []
    return [guard]


def _truth(guard: E.Expr, held: dict[E.Expr, bool | None]) -> bool | None:
    match guard:
        case E.Call("and", (a, b)):
            x, y = _truth(a, held), _truth(b, held)
            return False if x is False or y is False else None if None in (x, y) else True
        case E.Call("or", (a, b)):
            x, y = _truth(a, held), _truth(b, held)
            return True if x is True or y is True else None if None in (x, y) else False
        case E.Call("not", (a,)):
            x = _truth(a, held)
            return None if x is None else not x
        case E.Lit(value):
            return value
    return held[guard]


def _values(table: LegacyTable, r: E.Ref) -> list | None:
    """All values of a column, null among them where it can be, or None where they are not listed."""
    f = _field(table, r)
    domain = f.domain()
    return None if domain is None else [*domain, *([None] if f.nullable or r.path else [])]


def _states(table: LegacyTable, a: E.Expr) -> list[bool | None]:
    """The truths of an atom: unknown too, unless it is a null test or its columns are never null."""
    tests_null = isinstance(a, E.Call) and (a.op == "is_null" or a.op in ("eq", "ne") and E.Lit(None) in a.args)
    certain = tests_null or not any(_field(table, r).nullable or r.path for r in E.refs(a))
    return [True, False] if certain else [True, False, None]


def _cells(guards: list[E.Expr], table: LegacyTable) -> Iterable[tuple[str, list[bool | None]]] | None:
    """(description, each guard's truth) of every case, or None where cases cannot be listed.

    By the values of the columns where all are listed; otherwise by the truth of the
    guards' atoms, each true, false and, unless it is a null test or its columns are never
    null, unknown.
    """
    columns = list(dict.fromkeys(r for g in guards for r in E.refs(g)))
    if any(E.opaque(g) for g in guards):
        return None
    values = [_values(table, r) for r in columns]
    if None not in values:
        size = 1
        for v in values:
            size *= len(v)
        if size > MOST_CELLS:
            return None
        try:
            return [
                (", ".join(f"{r.name}={v!r}" for r, v in zip(columns, row)), [E.evaluate(g, dict(zip(columns, row))) for g in guards])
                for row in product(*values)
            ]
        except (E.Undecidable, TypeError):
            return None
    atoms = list(dict.fromkeys(a for g in guards for a in _atoms(g)))

    options = [_states(table, a) for a in atoms]
    size = 1
    for o in options:
        size *= len(o)
    if size > MOST_CELLS:
        return None
    return [
        (", ".join(f"{_said(a)}={'unknown' if v is None else str(v).lower()}" for a, v in zip(atoms, row)), [_truth(g, dict(zip(atoms, row))) for g in guards])
        for row in product(*options)
    ]


#: Truths that something may have, as a set of bits.
_BIT = {True: 1, False: 2, None: 4}
TRUE, NOT_TRUE, _ANY = 1, 6, 7
_MEMBERS = [[t for t, bit in _BIT.items() if bits & bit] for bits in range(8)]
_both = lambda p, q: False if False in (p, q) else None if None in (p, q) else True
_NOT = [sum({_BIT[None if p is None else not p] for p in _MEMBERS[x]}) for x in range(8)]
_AND = [[sum({_BIT[_both(p, q)] for p in _MEMBERS[x] for q in _MEMBERS[y]}) for y in range(8)] for x in range(8)]


class Search:
    """Cases of guards by search instead of by listing: what cannot become a case any more is not gone into.

    Variables are the guards' columns where all their values are listed, otherwise the atoms;
    a guard under some of them has a set of truths that it may still have.
    """

    def __init__(self, guards: list[E.Expr], table: LegacyTable) -> None:
        if any(E.opaque(g) for g in guards):
            raise E.Undecidable("a guard is a fragment")
        columns = list(dict.fromkeys(r for g in guards for r in E.refs(g)))
        listed = {r: _values(table, r) for r in columns}
        self.by_columns = all(v is not None for v in listed.values())
        self.domain: dict[E.Expr, list] = listed if self.by_columns else {a: _states(table, a) for g in guards for a in _atoms(g)}
        self.names: dict[E.Expr, list[E.Expr]] = {}
        self.steps = 0

    def _atom(self, atom: E.Expr, held: dict) -> int:
        if not self.by_columns:
            return sum(_BIT[v] for v in held[atom])
        refs = list(dict.fromkeys(E.refs(atom)))
        size = 1
        for r in refs:
            size *= len(held[r])
        if size > FEW_VALUES:
            return _ANY
        return sum({_BIT[E.evaluate(atom, dict(zip(refs, row)))] for row in product(*(held[r] for r in refs))})

    def may_be(self, guard: E.Expr, held: dict) -> int:
        match guard:
            case E.Call("and", (a, b)):
                x = self.may_be(a, held)
                return x if x == _BIT[False] else _AND[x][self.may_be(b, held)]
            case E.Call("or", (a, b)):
                x = self.may_be(a, held)
                return x if x == _BIT[True] else _NOT[_AND[_NOT[x]][_NOT[self.may_be(b, held)]]]
            case E.Call("not", (a,)):
                return _NOT[self.may_be(a, held)]
            case E.Lit(value):
                return _BIT[value]
        return self._atom(guard, held)

    def _split(self, guard: E.Expr, allowed: int) -> Iterable[tuple[E.Expr, int]]:
        """What ``guard`` in ``allowed`` says of its parts, where it says the same of each on its own."""
        match guard:
            case E.Call("not", (a,)):
                yield from self._split(a, _NOT[allowed])
            case E.Call("and", (a, b)) if allowed in (TRUE, TRUE | _BIT[None]):
                yield from (*self._split(a, allowed), *self._split(b, allowed))
            case E.Call("or", (a, b)) if allowed in (_BIT[False], NOT_TRUE):
                yield from (*self._split(a, allowed), *self._split(b, allowed))
            case _:
                yield guard, allowed

    def _cases(self, wanted: list[tuple[E.Expr, int]], held: dict) -> Iterable[dict]:
        self.steps += 1
        if self.steps > MOST_STEPS:
            raise E.Undecidable("too many cases")
        still = []
        for guard, allowed in wanted:
            may = self.may_be(guard, held)
            if not may & allowed:
                return
            if may & ~allowed:
                still.append((guard, allowed))
        if not still:
            yield held
            return
        # The guard that has the fewest variables left decides soonest.
        open_ = min(([n for n in self._names(g) if len(held[n]) > 1] for g, _ in still), key=len)
        for value in held[open_[0]]:
            yield from self._cases(still, held | {open_[0]: [value]})

    def _names(self, guard: E.Expr) -> list[E.Expr]:
        if guard not in self.names:
            self.names[guard] = list(dict.fromkeys([r for a in _atoms(guard) for r in E.refs(a)] if self.by_columns else _atoms(guard)))
        return self.names[guard]

    def find(self, wanted: list[tuple[E.Expr, int]], most: int = 1) -> list[str]:
        """Up to ``most`` cases in which each guard has one of the truths wanted, by the variables that were decided."""
        self.steps, held, rest = 0, dict(self.domain), []
        for guard, allowed in (part for g, t in wanted for part in self._split(g, t)):
            names = self._names(guard)
            if len(names) == 1 and _atoms(guard) == [guard]:  # it says what its variable may be
                fits = lambda v: _BIT[E.evaluate(guard, {names[0]: v}) if self.by_columns else v] & allowed  # noqa: B023, E731
                held[names[0]] = [v for v in held[names[0]] if fits(v)]
                if not held[names[0]]:
                    return []
            else:
                rest.append((guard, allowed))
        # One value of each variable that was narrowed down stands for the case.
        told = lambda n, v: f"{n.name}={v!r}" if self.by_columns else f"{_said(n)}={'unknown' if v is None else str(v).lower()}"
        return [", ".join(told(n, v[0]) for n, v in case.items() if len(v) == 1 or len(v) < len(self.domain[n])) for case in islice(self._cases(rest, held), most)]


def _said(e: E.Expr) -> str:
    match e:
        case E.Ref(name, path):
            return ".".join((*path, name))
        case E.Lit(v):
            return repr(v)
        case E.Call(op, args):
            return f"{op}({', '.join(map(_said, args))})"
    return type(e).__name__.lower()


@dataclass(frozen=True)
class Searched:
    """What a search says of a collapse: cases that no clause takes, clauses never reached, whether two can hold at once."""

    open: list[str]
    masked: list[int]
    overlap: bool


def _searched(guards: list[E.Expr], table: LegacyTable, fallback: bool, hit_policy: str) -> Searched | None:
    """None where guards say nothing that can be decided, or have too many cases even so."""
    try:
        search = Search(guards, table)
        open_ = [] if fallback else search.find([(g, NOT_TRUE) for g in guards], SHOWN)
        masked = [k for k, g in enumerate(guards) if search.find([(g, TRUE)]) and not search.find([(g, TRUE), *[(h, NOT_TRUE) for h in guards[:k]]])]
        overlap = hit_policy == "unique" and any(search.find([(g, TRUE), (h, TRUE)]) for k, g in enumerate(guards) for h in guards[:k])
    except (E.Undecidable, TypeError):
        return None
    return Searched(open_, masked, overlap)


def _collapse(lens: Lens, entity: Entity) -> Iterable[Finding]:
    m, a, table = lens.mapping, entity.attribute(lens.attribute), entity.source.table
    fallback = m.clauses[-1].when == M.OTHERWISE
    guarded = [c for c in m.clauses if c.when != M.OTHERWISE]
    guards = [E.expr(c.when) for c in guarded]
    hits = lambda: F.aggregate(F.array(*[F.coalesce(_column(g), F.lit(False)).cast("int") for g in guards] or [F.lit(0)]), F.lit(0), lambda s, x: s + x)
    none, many = (lambda: hits() == 0), (lambda: hits() > 1)
    cells = _cells(guards, table)
    searched = None if cells is not None else _searched(guards, table, fallback, m.hit_policy)
    if searched is not None:
        if searched.open:
            yield Finding("completeness", a.name, "error", f"{a.name} is null in cases such as {'; '.join(searched.open)}", _where(none))
        for k in searched.masked:
            yield Finding("masked_rule", a.name, "error", f"{a.name}: {guarded[k].value!r} is never reached, clauses before it take its cases")
    elif cells is None:
        yield Finding("guards", a.name, "warning", f"{a.name}: its guards cannot be enumerated; data must show that one holds", None if fallback else _where(none))
    else:
        cells = list(cells)
        if not fallback and (open_ := [name for name, truth in cells if True not in truth]):
            yield Finding("completeness", a.name, "error", f"{a.name} is null for {len(open_)} of {len(cells)} cases: {'; '.join(open_[:SHOWN])}", _where(none))
        for k, c in enumerate(guarded):
            mine = [truth for _, truth in cells if truth[k] is True]
            if mine and all(True in truth[:k] for truth in mine):
                yield Finding("masked_rule", a.name, "error", f"{a.name}: {c.value!r} is never reached, clauses before it take its cases")
    if m.hit_policy == "unique" and (searched.overlap if searched is not None else cells is None or any(truth.count(True) > 1 for _, truth in cells)):
        yield Finding("non_overlap", a.name, "warning", f"{a.name}: more than one clause may hold; data must show that none do", _where(many))
    domain = a.domain()
    reached = [c.value for c in m.clauses]
    if domain is not None and lens.writes and (missing := [v for v in domain if v not in reached]):
        yield Finding("surjectivity", a.name, "warning", f"{a.name}: no clause gives {', '.join(map(repr, missing))}, so it cannot be written")
    if lens.writes:
        twice = [v for v, n in Counter(reached).items() if n > 1]
        if twice:
            yield Finding("put_get", a.name, "error", f"{a.name}: {', '.join(map(repr, twice))} comes from more than one clause, so a write cannot tell which to store")


def _default(lens: Lens, entity: Entity) -> Iterable[Finding]:
    m = lens.mapping
    yield Finding("get_put_coalesce", lens.attribute, "warning", f"{lens.attribute}: a stored {m.default!r} would come back as null", _where(lambda: _column(m.source) == literal(m.default)))


def _concat(lens: Lens, entity: Entity) -> Iterable[Finding]:
    m = lens.mapping
    held = lambda: F.exists(F.array(*[_column(s).cast("string") for s in m.sources]), lambda c: F.instr(c, m.separator) > 0)
    yield Finding("get_put_concat", lens.attribute, "warning", f"{lens.attribute}: an operand that holds {m.separator!r} would be split elsewhere", _where(held))


def _redundant(lens: Lens, entity: Entity) -> str | None:
    m, a, table = lens.mapping, entity.attribute(lens.attribute), entity.source.table
    match m:
        case M.Decode() if all(k == v for k, v in m.values) and m.null_as is None:
            return "the decode maps each value to itself; use Map"
        case M.Affine() if m.multiply == 1 and m.add == 0:
            return "multiplying by 1 and adding 0 changes nothing; use Map"
        case M.Concat() if len(m.sources) == 1:
            return "one column needs no concat; use Map"
        case M.Map() if m.zone and E.simple_reference(m.source) and _field(table, m.source).type == "timestamp" and storage_type(a.type) == "timestamp":
            return "both sides are instants already; the zone says nothing"
    return None


def check(entity: Entity) -> list[Finding]:
    """All findings, attribute by attribute, then those of the mapping as a whole."""
    found: list[Finding] = []
    rules = {M.Decode: _decode, M.Collapse: _collapse, M.Default: _default, M.Concat: _concat}
    by_name = lenses(entity)
    for lens in by_name.values():
        if type(lens.mapping) in rules:
            found += rules[type(lens.mapping)](lens, entity)
        if isinstance(lens.mapping, M.Affine) and lens.writes and lens.invertible == "semi":
            found.append(Finding("affine_exact", lens.attribute, "warning", f"{lens.attribute}: dividing back by {lens.mapping.multiply} may not give the stored number"))
        if reason := _redundant(lens, entity):
            found.append(Finding("redundancy", lens.attribute, "error", f"{lens.attribute}: {reason}"))
    writers: dict[str, list[str]] = {}
    for lens in by_name.values():
        for column, _ in lens.writes:
            writers.setdefault(column, []).append(lens.attribute)
    for column, attributes in sorted(writers.items()):
        if len(attributes) > 1:
            found.append(Finding("linearity", attributes[1], "error", f"{column} is written by {' and '.join(attributes)}; only one may"))
    return found


def errors(entity: Entity) -> list[Finding]:
    return [f for f in check(entity) if f.severity == "error"]


def assertions(entity: Entity) -> list[Finding]:
    return [f for f in check(entity) if f.assertion is not None]
