"""Proofs about guards by search, beside those by enumeration."""

import random
import time

import pytest

from bilens import catalog as C
from bilens.functions import expr as E
from bilens.model import Entity, Field, LegacyTable, Phase, Source
from bilens.plans import mappings as M
from bilens.plans import obligations


def flags(n, nullable=False):
    return LegacyTable("t", (Field("id", "bigint", False), *(Field(f"f{i}", "bigint", nullable) for i in range(n))), ("id",))


def collapse(table, guards, policy="first", otherwise=False):
    clauses = [M.Clause(f"v{k}", g, {}) for k, g in enumerate(guards)] + ([M.Clause("rest", M.OTHERWISE, {})] if otherwise else [])
    attribute = Field("v", "string", one_of=tuple(c.value for c in clauses))
    return Entity("e", (Field("id", "bigint", False), attribute), Source(table, (M.Key("id", "id"), M.Collapse("v", clauses=tuple(clauses), hit_policy=policy, read_only=True, because="read"))), Phase.READ_FROM_LEGACY)


def told(entity):
    return sorted((f.obligation, f.attribute, f.severity) for f in obligations.check(entity))


atom = lambda i: E.call("gt", E.ref(f"f{i}"), 0)
no = lambda g: E.call("not", g)


def both(op, *guards):
    out = guards[0]
    for g in guards[1:]:
        out = E.call(op, out, g)
    return out


@pytest.mark.parametrize("entity", C.ENTITIES + [C.NARROW, C.GAPPED], ids=lambda e: e.name)
def test_a_search_finds_what_an_enumeration_finds(entity, monkeypatch):
    listed = told(entity)
    monkeypatch.setattr(obligations, "MOST_CELLS", 0)
    assert told(entity) == listed


@pytest.mark.parametrize("seed", range(60))
def test_on_random_guards_too(seed, monkeypatch):
    rng = random.Random(seed)

    def guard(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            i = rng.randrange(4)
            return rng.choice([atom(i), E.call("is_null", E.ref(f"f{i}")), E.call("eq", E.ref(f"f{i}"), rng.randrange(3))])
        return no(guard(depth - 1)) if kind < 0.5 else E.call(rng.choice(["and", "or"]), guard(depth - 1), guard(depth - 1))

    table = flags(4, nullable=rng.random() < 0.5)
    if rng.random() < 0.5:
        table = LegacyTable("t", (table.fields[0], *(Field(f.name, "bigint", f.nullable, minimum=0, maximum=2) for f in table.fields[1:])), ("id",))
    entity = collapse(table, [guard(2) for _ in range(rng.randint(1, 4))], rng.choice(["first", "unique"]), rng.random() < 0.3)
    listed = told(entity)
    monkeypatch.setattr(obligations, "MOST_CELLS", 0)
    assert told(entity) == listed


def test_forty_atoms_in_a_second():
    n = 40
    chain = [both("and", *[no(atom(j)) for j in range(i)], atom(i)) for i in range(n)]
    began = time.perf_counter()
    # Each clause takes what the ones before left; without the last case one is open, with it none.
    found = {f.obligation: f for f in obligations.check(collapse(flags(n), chain, "unique"))}
    assert "completeness" in found and "masked_rule" not in found and "non_overlap" not in found
    assert all(f"gt(f{i}, 0)=false" in found["completeness"].message for i in range(n))
    closed = [*chain, both("and", *[no(atom(j)) for j in range(n)])]
    assert not told(collapse(flags(n), closed, "unique"))
    # Where a column can be null, three cases are shown.
    open_ = next(f for f in obligations.check(collapse(flags(n, nullable=True), closed)) if f.obligation == "completeness")
    assert open_.message.count("unknown") >= 1 and open_.message.count("; ") == obligations.SHOWN - 1
    masked = [*chain[:3], both("and", atom(0), atom(39)), atom(5), *map(atom, range(6, n))]
    assert [f.obligation for f in obligations.check(collapse(flags(n), masked, otherwise=True))] == ["masked_rule"]
    assert time.perf_counter() - began < 4  # four mappings


def test_wide_domains_are_searched_by_their_columns():
    table = LegacyTable("t", (Field("id", "bigint", False), *(Field(f"f{i}", "int", False, minimum=0, maximum=200) for i in range(6))), ("id",))
    guards = [E.call("lt", E.ref(f"f{i}"), 100) for i in range(6)]
    found = {f.obligation: f.message for f in obligations.check(collapse(table, guards, "unique"))}
    assert set(found) == {"completeness", "non_overlap"} and "f0=100" in found["completeness"]
    assert not told(collapse(table, [*guards, both("and", *[E.call("ge", E.ref(f"f{i}"), 100) for i in range(6)])]))


def test_what_cannot_be_decided_is_left_to_the_data(monkeypatch):
    monkeypatch.setattr(obligations, "MOST_CELLS", 0)
    monkeypatch.setattr(obligations, "MOST_STEPS", 1)
    assert told(collapse(flags(3), [atom(0), both("and", no(atom(0)), atom(1))])) == [("guards", "v", "warning")]
