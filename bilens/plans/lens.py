"""What a mapping means both ways: the one structure that everything else reads."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

from ..functions import expr as E
from ..model import DeclarationError, Entity, Field, LegacyTable, storage_type
from . import mappings as M


@dataclass(frozen=True)
class Lens:
    """``forward`` over legacy columns; ``writes`` over attributes, one for each legacy column."""

    attribute: str
    combinator: str
    forward: E.Expr
    writes: tuple[tuple[str, E.Expr], ...] = ()
    invertible: str = "yes"
    kind: str = "transformation"
    because: str | None = None
    mapping: M.Mapping | None = None
    read_only: bool = False

    @property
    def sources(self) -> list[E.Ref]:
        return E.refs(self.forward)

    @property
    def opaque(self) -> bool:
        return E.opaque(self.forward)


def _legacy_field(table: LegacyTable, r: E.Ref) -> Field:
    return table.follow(r.path).field(r.name)


#: Casts that lose nothing: from -> to.
_WIDENINGS = {("bigint", "decimal"), ("bigint", "string"), ("boolean", "string"), ("date", "timestamp_ntz"), ("uuid", "string"), ("string", "uuid"), ("string", "ci_string"), ("ci_string", "string")}


def _map(m: M.Map, a: Field, table: LegacyTable) -> Lens:
    source = E.simple_reference(m.source)
    if source is None:
        if m.zone:
            raise DeclarationError(f"{a.name}: a zone belongs to a plain column, not to an expression")
        return Lens(a.name, "expression", m.source, (), "no", "masked")
    legacy = _legacy_field(table, source)
    if m.zone:
        to_naive = legacy.type == "timestamp"
        return Lens(a.name, "zone", E.AtZone(source, m.zone, to_naive), ((source.name, E.AtZone(E.ref(a.name), m.zone, not to_naive)),))
    have, want = storage_type(legacy.type), storage_type(a.type)
    if have == want and legacy.type.replace("integer", "int") == a.type.replace("integer", "int") or have == want and have != "decimal":
        return Lens(a.name, "rename", source, ((source.name, E.ref(a.name)),), "yes", "identity")
    exact = (have, want) in _WIDENINGS
    return Lens(a.name, "cast", E.Cast(source, a.type), ((source.name, E.Cast(E.ref(a.name), legacy.type)),), "yes" if exact else "semi")


def _decode(m: M.Decode, a: Field, table: LegacyTable) -> Lens:
    source = E.simple_reference(m.source)
    forward: E.Expr = E.Case(m.source, m.values)
    if m.null_as is not None:
        forward = E.if_(E.call("is_null", m.source), m.null_as, forward)
    if source is None:
        return Lens(a.name, "decode", forward, (), "no", "masked")
    back: dict[Any, Any] = {}
    for legacy, modern in m.values:
        back.setdefault(modern, legacy)
    if m.null_as is not None:
        back.setdefault(m.null_as, None)
    pairs = tuple((k, v) for k, v in sorted(back.items(), key=lambda p: (str(type(p[0])), p[0])))
    return Lens(a.name, "decode", forward, ((source.name, E.Case(E.ref(a.name), pairs)),))


def _collapse(m: M.Collapse, a: Field, table: LegacyTable) -> Lens:
    fallback = m.clauses[-1] if m.clauses[-1].when == M.OTHERWISE else None
    guarded = [c for c in m.clauses if c is not fallback]
    value = E.Cond(tuple((E.expr(c.when), E.expr(c.value)) for c in guarded), E.expr(fallback.value) if fallback else None)
    forward = value if guarded else E.expr(fallback.value)
    touched = False
    writes = []
    for column in [n for n, _ in m.clauses[0].set]:
        def stored(c: M.Clause) -> E.Expr:
            nonlocal touched
            x = dict(c.set)[column]
            if isinstance(x, E.Touch):
                touched = True
                return E.Touch(a.name, column)
            return E.expr(x)

        pairs = tuple((c.value, stored(c)) for c in guarded)
        default = stored(fallback) if fallback else None
        legacy_type = table.field(column).type
        writes.append((column, E.Cast(E.Case(E.ref(a.name), pairs, default), legacy_type)))
    if not writes:
        return Lens(a.name, "collapse", forward, (), "no", "masked")
    return Lens(a.name, "collapse", forward, tuple(writes), "semi" if touched else "yes")


def _default(m: M.Default, a: Field, table: LegacyTable) -> Lens:
    source = E.simple_reference(m.source)
    forward = E.call("coalesce", m.source, m.default)
    if source is None:
        return Lens(a.name, "coalesce", forward, (), "no", "masked")
    # Null back for the default: otherwise the value itself, also when it is null.
    back = E.when((E.call("eq", E.ref(a.name), m.default), E.Cast(E.Lit(None), table.follow(source.path).field(source.name).type)), default=E.ref(a.name))
    return Lens(a.name, "coalesce", forward, ((source.name, back),), "semi")


def _concat(m: M.Concat, a: Field, table: LegacyTable) -> Lens:
    forward = None
    for s in m.sources:
        part = E.call("coalesce", s, "")
        forward = part if forward is None else E.call("join", E.call("join", forward, m.separator), part)
    plain = [E.simple_reference(s) for s in m.sources]
    if None in plain:
        return Lens(a.name, "concat", forward, (), "no", "masked")
    writes = tuple((s.name, E.fragment("split_part(?, ?, ?)", E.ref(a.name), m.separator, i + 1)) for i, s in enumerate(plain))
    return Lens(a.name, "concat", forward, writes, "semi")


def _negate(m: M.Negate, a: Field, table: LegacyTable) -> Lens:
    source = E.simple_reference(m.source)
    writes = ((source.name, E.call("not", E.ref(a.name))),) if source else ()
    return Lens(a.name, "negate", E.call("not", m.source), writes, "yes" if source else "no", "transformation" if source else "masked")


def _affine(m: M.Affine, a: Field, table: LegacyTable) -> Lens:
    source = E.simple_reference(m.source)
    forward = E.Cast(E.call("add", E.call("mul", m.source, m.multiply), m.add), a.type)
    if source is None:
        return Lens(a.name, "affine", forward, (), "no", "masked")
    legacy = _legacy_field(table, source)
    whole = storage_type(legacy.type) == "bigint" and storage_type(a.type) == "bigint"
    exact = whole and m.multiply in (1, -1) or storage_type(legacy.type) == "decimal" and storage_type(a.type) == "decimal" and m.multiply in (1, -1, 10, 100, 1000)
    back = E.Cast(E.call("div", E.call("sub", E.ref(a.name), m.add), m.multiply), legacy.type)
    return Lens(a.name, "affine", forward, ((source.name, back),), "yes" if exact else "semi")


def _unmapped(m: M.Unmapped, a: Field, table: LegacyTable) -> Lens:
    if m.as_ == "null":
        return Lens(a.name, "unmapped", E.Cast(E.Lit(None), a.type), (), "no", "structural")
    if not a.has_default or callable(a.default):
        raise DeclarationError(f"{a.name}: unmapped as default needs a default that is a value")
    return Lens(a.name, "unmapped", E.Lit(a.default), (), "no", "structural")


def lens_of(mapping: M.Mapping, entity: Entity) -> Lens:
    """The lens of one mapping; read-only mappings lose their writes, and say why."""
    table, a = entity.source.table, entity.attribute(mapping.attribute)
    match mapping:
        case M.Key():
            lens = Lens(a.name, "key", mapping.source, (), "no", "structural")
        case M.Constant():
            if E.refs(mapping.value):
                raise DeclarationError(f"{a.name}: a constant reads no columns; use Map")
            lens = Lens(a.name, "constant", mapping.value, (), "no", "structural")
        case M.Unmapped():
            lens = _unmapped(mapping, a, table)
        case _:
            make = {M.Map: _map, M.Decode: _decode, M.Collapse: _collapse, M.Default: _default, M.Concat: _concat, M.Negate: _negate, M.Affine: _affine}
            lens = make[type(mapping)](mapping, a, table)
    lens = replace(lens, mapping=mapping, because=mapping.because)
    if mapping.read_only and lens.kind != "structural":
        lens = replace(lens, writes=(), invertible="no", kind="masked", read_only=True)
    return lens


def lenses(entity: Entity) -> dict[str, Lens]:
    """By attribute, in the entity's order; what has no mapping is absent."""
    if entity.source is None:
        raise DeclarationError(f"{entity.name} is bound to no legacy table")
    seen: dict[str, Lens] = {}
    for mapping in entity.source.mappings:
        if mapping.attribute in seen:
            raise DeclarationError(f"{mapping.attribute} is mapped twice")
        seen[mapping.attribute] = lens_of(mapping, entity)
    return {a.name: seen[a.name] for a in entity.attributes if a.name in seen}


def key_of(entity: Entity) -> M.Key:
    keys = [m for m in entity.source.mappings if isinstance(m, M.Key)]
    if len(keys) != 1:
        raise DeclarationError(f"{entity.name} needs exactly one key, and has {len(keys)}")
    return keys[0]


def classify(lens: Lens) -> tuple[str, str]:
    return lens.kind, lens.invertible


def inverse_literal(lens: Lens, value: Any) -> tuple[str, Any] | None:
    """The legacy column and value that an attribute's value stands for, for lenses proven to be bijections."""
    m = lens.mapping
    if lens.invertible != "yes" or len(lens.writes) != 1:
        return None
    column = lens.writes[0][0]
    match m:
        case M.Decode():
            back = [k for k, v in m.values if v == value]
            return (column, back[0]) if len(back) == 1 and m.null_as is None else None
        case M.Negate() if isinstance(value, bool):
            return column, not value
        case M.Affine() if not isinstance(value, float):
            x = (Decimal(value) - Decimal(str(m.add))) / Decimal(str(m.multiply))
            return (column, int(x)) if x == int(x) else (column, x)
        case M.Map() if lens.combinator == "rename":
            return column, value
    return None
