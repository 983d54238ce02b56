"""Refusals, in order, before anything is built."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import expr as E
from ..model import DeclarationError, Entity, LegacyTable, Phase, storage_type
from . import mappings as M
from . import mechanism, obligations
from .lens import key_of, lenses


class Refused(DeclarationError):
    """A verifier's refusal; ``verifier`` names it."""

    def __init__(self, verifier: str, message: str) -> None:
        super().__init__(f"{verifier}: {message}")
        self.verifier = verifier


def _references(entity: Entity):
    for lens in lenses(entity).values():
        for r in lens.sources:
            yield lens, r


def legacy_table(entity: Entity) -> str | None:
    if entity.source is None or not isinstance(entity.source.table, LegacyTable):
        return f"{entity.name} is bound to no legacy table"
    for m in entity.source.mappings:
        origins = m.sources if isinstance(m, M.Concat) else [getattr(m, "source", None)]
        if isinstance(m, M.Collapse):
            origins = [c.when for c in m.clauses if isinstance(c.when, E.Expr)]
            for c in m.clauses:
                for column, _ in c.set:
                    entity.source.table.field(column)
        for o in origins:
            for r in E.refs(o) if isinstance(o, E.Expr) else []:
                entity.source.table.follow(r.path).field(r.name)
    return None


def complete_mapping(entity: Entity) -> str | None:
    mapped = {m.attribute for m in entity.source.mappings}
    missing = [a.name for a in entity.attributes if not a.private and a.name not in mapped]
    return f"{', '.join(missing)} have no source; map them, or say why they are unmapped" if missing else None


def not_redundant(entity: Entity) -> str | None:
    found = [f for f in obligations.check(entity) if f.obligation == "redundancy"]
    return found[0].message if found else None


def timestamp_zones(entity: Entity) -> str | None:
    for m in entity.source.mappings:
        if isinstance(m, M.Map) and not m.zone and (r := E.simple_reference(m.source)):
            kinds = {storage_type(entity.source.table.follow(r.path).field(r.name).type), storage_type(entity.attribute(m.attribute).type)}
            if kinds == {"timestamp", "timestamp_ntz"}:
                return f"{m.attribute}: a naive time is an instant only in some zone, and a bare cast takes the session's; give zone="
    return None


def derived_writability(entity: Entity) -> str | None:
    for lens in lenses(entity).values():
        if lens.kind == "structural":
            continue
        reason = (lens.because or "").strip()
        if not lens.writes and not lens.mapping.read_only:
            return f"{lens.attribute} cannot be written back; mark it read_only=True and say why"
        if lens.mapping.read_only and not reason:
            return f"{lens.attribute} is read-only without a reason; say why with because"
        if reason and not lens.mapping.read_only:
            return f"{lens.attribute} has a reason for being read-only and is not"
    return None


def joined_writes(entity: Entity) -> str | None:
    for lens in lenses(entity).values():
        if lens.writes and any(r.path for r in lens.sources):
            return f"{lens.attribute} would write to another table through a join; make it read-only"
    return None


def proofs(entity: Entity) -> str | None:
    found = obligations.errors(entity)
    return f"[{found[0].obligation}] {found[0].message}" if found else None


def no_upserts(entity: Entity) -> str | None:
    if entity.upserts and mechanism.writes(entity) == "triggers":
        return f"{entity.name} upserts, and a view that triggers write cannot; plain columns alone can be upserted"
    return None


def reverse_mappable(entity: Entity) -> str | None:
    if entity.phase is not Phase.READ_FROM_NEW:
        return None
    for lens in lenses(entity).values():
        if any(r.path for r in lens.sources):
            return f"{lens.attribute} comes through a join, and the new table cannot be read back as the old one"
        if lens.kind != "structural" and lens.invertible != "yes":
            return f"{lens.attribute} loses what it reads, so the old column cannot be shown"
    return None


def identities_backed(entity: Entity) -> str | None:
    table, by_name = entity.source.table, lenses(entity)
    backed = [set(u) for u in (*table.uniques, table.primary_key) if u]
    for identity in entity.identities:
        columns = set()
        for a in identity:
            lens = by_name.get(a)
            if lens is None or lens.combinator not in ("rename", "cast", "zone", "key") or len(lens.sources) != 1 or lens.sources[0].path:
                return f"identity {identity}: {a} is not a plain column"
            columns.add(lens.sources[0].name)
        if not any(u <= columns for u in backed):
            return f"identity {identity} is backed by no unique set of {table.name}"
    return None


def phase_transition(entity: Entity) -> str | None:
    key_of(entity)
    if entity.phase in (Phase.DUAL_WRITE, Phase.READ_FROM_NEW):
        for m in entity.source.mappings:
            if m.read_only and not (m.because or "").strip():
                return f"{m.attribute} has no reason for being read-only, and phase {entity.phase.value} writes"
    return None


ORDER: tuple[Callable[[Entity], str | None], ...] = (
    legacy_table, complete_mapping, not_redundant, timestamp_zones, derived_writability, joined_writes,
    proofs, no_upserts, reverse_mappable, identities_backed, phase_transition,
)


def verify(entity: Entity) -> Entity:
    """The entity, or the first refusal."""
    for rule in ORDER:
        try:
            message = rule(entity)
        except DeclarationError as e:
            message = str(e)
        if message:
            raise Refused(rule.__name__, message)
    return entity


def refusals(entity: Entity) -> list[tuple[str, str]]:
    """Every verifier's refusal, for reports."""
    out = []
    for rule in ORDER:
        try:
            message = rule(entity)
        except DeclarationError as e:
            message = str(e)
        if message:
            out.append((rule.__name__, message))
    return out
