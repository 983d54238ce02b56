"""Repairs of conversations against a plain search over whole edit strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from bilens.llm import conversations

TURNS = "conv_id bigint, turn bigint, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def faults_of(turns):
    """(role, text, first fault) of turns in order."""
    seen, out = set(), []
    for role, text in turns:
        words = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "sound"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(turns):
    """(cost, edits) by keeping the best whole edit string of each state; strings are compared as they are."""
    held = {0: (0, "")}

    def grow(held):
        for _ in range(2):
            for state, (cost, edits) in list(held.items()):
                to = NEXT[state, "a" if state == 2 else "u"]
                held[to] = min(held.get(to, (10**9, "")), (cost + 5, edits + "I"))
        return held

    for role, _, fault in turns:
        found, late = defaultdict(list), 5 if fault == "truncated" else 0
        for state, (cost, edits) in grow(dict(held)).items():
            found[state].append((cost + 2, edits + "D"))
            if fault in ("sound", "truncated"):
                found[NEXT[state, "a" if state == 2 else "u"]].append((cost + 1 + late, edits + "R"))
                if (state, role[:1]) in NEXT:
                    found[NEXT[state, role[:1]]].append((cost + late, edits + "K"))
        held = {s: min(ways) for s, ways in found.items()}
    return min(way for state, way in grow(dict(held)).items() if state in (0, 3))


def apply(turns, edits):
    out, rows, state = [], iter(turns), 0
    for e in edits:
        role, text = ("", "") if e == "I" else next(rows)[:2]
        if e == "D":
            continue
        initial = role[:1] if e == "K" else "a" if state == 2 else "u"
        out.append((role if e == "K" else "assistant" if initial == "a" else "user", text))
        state = NEXT[state, initial]
    assert next(rows, None) is None and state in (0, 3)
    return out


def brute(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept[conv]
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, turns in kept.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        numbers = {t for t, _, _ in turns if t is not None}
        judged = faults_of([t[1:] for t in turns])
        cost, audit = cheapest(judged)
        said = "\n".join(f"{r}:{t}" for r, t in apply(judged, audit))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, *[sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return out


def sample(n=300, seed=4):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "and then", "", " \n", "Fine. \t", "漢字。", "ok.\nx", "a" * 5000 + "."]
    rows = []
    for conv in range(n):
        number = rng.randint(-2, 3)
        for i in range(rng.choice([1, 2, 3, 4, 6, 9])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.5 else "system" if i == 0 else "ua"[i % 2] + "ser"
            rows.append((conv, number, rng.choice([role] * 9 + ["tool", None, "", "USER"]), rng.choice([*said, None, f"t{rng.random()}."])))
            number += rng.choice([1, 1, 1, 1, 3])
    rows += [(None, i, "user" if i % 2 else "assistant", f"line {i % 40}.") for i in range(400)]
    rows += [(9000, None, "user", "first."), (9000, None, "assistant", "second."), (9000, 5, "user", "third."), (9001, None, "user", "only."), (9001, None, "user", "only.")]
    rows += [(9002, 1, "user", "same."), (9002, 1, "assistant", "same."), (9002, 1, "user", "same."), (9003, -(1 << 63), "user", "far."), (9003, (1 << 63) - 1, "assistant", "far.")]
    rng.shuffle(rows)
    return rows


def test_damaged_conversations(spark):
    rows = sample()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS fault", "1 AS pos", "'y' AS signature", "2 AS copy", "'z' AS audit").repartition(5)
    got = {r["conv_id"]: tuple(r) for r in conversations.repair_damaged(df).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert got.keys() == want.keys()
    for conv, row in want.items():
        if conv == 9003:  # more gaps than a bigint holds: the largest
            row = (conv, min(row[1], (1 << 63) - 1), *row[2:])
        assert got[conv] == row
    assert conversations.repair_damaged(spark.createDataFrame([], TURNS)).count() == 0


def test_repaired_turns(spark):
    rows = [r for r in sample(60, 9) if r[0] is not None and r[0] < 9000]
    repair = conversations.Repair(spark.createDataFrame(rows, TURNS))
    found = defaultdict(list)
    for r in sorted(repair.turns().collect(), key=lambda r: (r["conv_id"], r["place"])):
        found[r["conv_id"]].append((r["role"], r["text"]))
        assert r["place"] == len(found[r["conv_id"]])
    by = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by[conv].append((" " if role is None else role, " " if text is None else text))
    for conv, turns in by.items():
        judged = faults_of(turns)
        assert found[conv] == apply(judged, cheapest(judged)[1])


@pytest.mark.parametrize("seed", range(4))
def test_a_shared_prefix_is_computed_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("AEIMBDGP") for _ in range(rng.randint(0, 9))) for _ in range(400)} | {"A", "AA", ""} | {"EI" * 3000, "EI" * 3000 + "E"})
    trie = conversations.Trie()
    for word in words:
        turns = [("suao"[(ord(c) - 65) // 4], f"{i}", conversations.FAULTS[(ord(c) - 65) % 4]) for i, c in enumerate(word)]
        assert trie.answer(word) == cheapest(turns)
    assert trie.layers == len({w[:i] for w in words for i in range(1, len(w) + 1)})
