"""Repairing the structure of conversations by the cheapest edits.

What an edit costs depends on a turn's role initial and fault alone, so a conversation is
a string of symbols, its signature. Distinct signatures are sorted; walking them in order
is walking their prefix trie depth first, with the layers of one path at a time. A layer
holds, for each state of the grammar, the least cost and which of the states' edits come
first in order; it is computed once for each shared prefix, and answers are read off where
a signature ends. Layers that differ in a constant cost are one shape, so nearly every
step is looked up.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import lean, ship, stored

WORD = r"[^\x20\x09-\x0D]"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
#: A turn's symbol is the letter of 4 * (its initial) + (its first fault).
INITIALS, FAULTS = "suao", ("sound", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; what may follow, and where it leads.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Characters of role and text that order turns of one number; beyond, a hash does.
TIED = 64

Shape = tuple[tuple[int, int] | None, ...]  # of each state: cost above the layer's least, and place among the states' edits
START: Shape = ((0, 0), None, None, None)


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(state, inserts) with up to two turns inserted; three are never better than one."""
    for n in range(3):
        yield state, n
        state = 3 if state == 2 else 2


@lru_cache(maxsize=None)
def advance(shape: Shape, symbol: str) -> tuple[Shape, int, tuple[tuple[int, str] | None, ...]]:
    """The layer after one more turn: its shape, what its least cost rises by, and for each state (state before, edits).

    Edits end in what happens to the turn, so no two states' edits so far start with one another and
    their order stays what it is.
    """
    initial, fault = INITIALS[(ord(symbol) - 65) // 4], FAULTS[(ord(symbol) - 65) % 4]
    late = TRUNCATED if fault == "truncated" else 0
    best: list[tuple[int, int, str, int] | None] = [None] * 4
    for before, held in enumerate(shape):
        if held is None:
            continue
        for state, inserts in _inserted(before):
            ways = [(DELETE, "D", state)]
            if fault not in ("blank", "duplicate"):
                ways.append((REROLE + late, "R", 3 if state == 2 else 2))
                if initial in AFTER[state]:
                    ways.append((KEEP + late, "K", AFTER[state][initial]))
            for cost, edit, to in ways:
                way = (held[0] + inserts * INSERT + cost, held[1], "I" * inserts + edit, before)
                if best[to] is None or way < best[to]:
                    best[to] = way
    least = min(way[0] for way in best if way)
    places = {at: i for i, at in enumerate(sorted((way[1], way[2]) for way in best if way))}
    return tuple(way and (way[0] - least, places[way[1], way[2]]) for way in best), least, tuple(way and (way[3], way[2]) for way in best)


@lru_cache(maxsize=None)
def finish(shape: Shape) -> tuple[int, int, str]:
    """(cost above the layer's least, state, inserts at the end) of the best end."""
    ways = [(held[0] + n * INSERT, held[1], "I" * n, before) for before, held in enumerate(shape) if held for state, n in _inserted(before) if state in ENDS]
    cost, _, edits, state = min(ways)
    return cost, state, edits


class Trie:
    """One path of the prefix trie of sorted signatures, with the layer of each prefix."""

    def __init__(self) -> None:
        self.path = ""
        self.shapes: list[Shape] = [START]
        self.costs = array("q", [0])
        self.layers = 0

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; layers of the prefix that it shares with the last one are not computed again."""
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most:  # by doubling, then back to halves
            step = 1
            while self.path[shared : shared + step] == signature[shared : shared + step] and shared + step <= most:
                shared += step
                step *= 2
            if step == 1:
                break
        del self.shapes[shared + 1 :], self.costs[shared + 1 :]
        for symbol in signature[shared:]:
            shape, more, _ = advance(self.shapes[-1], symbol)
            self.shapes.append(shape)
            self.costs.append(self.costs[-1] + more)
            self.layers += 1
        self.path = signature
        cost, state, edits = finish(self.shapes[-1])
        parts = [edits]
        for depth in range(len(signature), 0, -1):
            state, edits = advance(self.shapes[depth - 1], signature[depth - 1])[2][state]
            parts.append(edits)
        return self.costs[-1] + cost, "".join(reversed(parts))


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after faults that a checksum of ``conv_id:turn`` places; nulls count as one space there."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    hurt = plain(turns).withColumn("fault", fault).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return hurt.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def plain(turns: DataFrame) -> DataFrame:
    """The columns used, a null role or text as one space."""
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def ordered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, a number that rises along each conversation: by turn, nulls first, then role and text.

    Numbers are given out by ranges of (conversation, turn, ...), so a conversation of any
    length is spread over tasks; the upper bits name the range.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *[F.substring(c, 1, TIED) for c in ("role", "text")], F.xxhash64("role", "text")]
    return stored(plain(turns).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id()), "turns")


def _joined(key: str, part: str) -> Column:
    """Strings ``part`` of a group, in the order of ``key``, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, part))), lambda x: x[part]), "")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature) of each conversation of ``rows``, as ``ordered`` returns them.

    A turn's first fault counts: blank, duplicate (the role and text occur earlier), truncated
    (its last character that is not blank ends no sentence). The parts of a signature are
    joined where their range lies, then joined once more, so what meets is a letter a turn.
    """
    key = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("second"), "role", "text").alias("k2")]
    first = rows.select("conv_id", "pos", *key).groupBy("conv_id", "k1", "k2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(WORD), 1).when(F.col("is_first").isNull(), 2).when(F.col("text").rlike(CUT_OFF), 3).otherwise(0)
    symbols = rows.join(first, "pos", "left").select("conv_id", "pos", F.shiftright("pos", 33).alias("range"), F.char(65 + 4 * kind + fault).alias("symbol"))
    return symbols.groupBy("conv_id", "range").agg(_joined("pos", "symbol").alias("part")).groupBy("conv_id").agg(_joined("range", "part").alias("signature"))


def solve(signatures_: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of each distinct signature."""
    ship(signatures_.sparkSession)
    whole = signatures_.select("signature").distinct()
    dealt = whole.repartitionByRange(F.substring("signature", 1, 256)).sortWithinPartitions("signature")

    def run(batches):
        trie = Trie()
        for batch in batches:
            out = []
            for signature in batch.column("signature").to_pylist():
                kinds = [divmod(ord(c) - 65, 4) for c in signature]
                counts = [sum(f == n for _, f in kinds) for n in (1, 2, 3)]
                illegal = sum(INITIALS[a] + INITIALS[b] not in LEGAL for (a, _), (b, _) in zip(kinds, kinds[1:]))
                out.append((signature, *counts, illegal, *trie.answer(signature)))
            names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            kinds_ = [pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kinds_[i]) for i in range(7)], names=names)

    return dealt.mapInArrow(lean(run), "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the edits of ``audit`` leave of ``rows``, one after the other."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        yield edit, role, text
        state = AFTER[state]["a" if state == 2 else "s" if state == 0 and role[0] == "s" else "u"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str, str]]]]:
    """(conversation, its turns after the edits), from rows that a row with the audit precedes; a conversation is never held whole."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text"))))
    head = next(rows, None)
    ahead: list = [head]

    def mine() -> Iterator[tuple[str, str]]:
        for row in rows:
            if row[1] < 0:
                ahead[0] = row
                return
            yield row[2], row[3]
        ahead[0] = None

    while ahead[0] is not None:
        conv, _, _, audit = ahead[0]
        turns = mine()
        yield conv, edited(audit, turns)
        for _ in turns:  # whatever was not asked for
            pass


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its turns, sorted; one task reads a conversation as a stream, for a hash is sequential."""
    heads = audits.select("conv_id", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return heads.unionByName(rows.select("conv_id", "pos", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")


class Repair:
    """The cheapest repair of each conversation of ``turns`` (conv_id, turn, role, text; other columns are left out).

    A repaired conversation's role initials are ``(s?(ua)+)?``. Keep costs 0, Rerole (to user
    or assistant) 1, Delete 2, Insert (an empty turn) 5; blank and duplicate turns must go,
    and a truncated one that stays costs 5 more. Of edits that cost the same, those whose
    initials come first. Null roles and texts are one space, so a null text is blank; a null
    conversation is one conversation; null turns come first, equal turns in the order of
    role and text. An initial other than s, u, a never stays. No rows: no conversations.
    """

    def __init__(self, turns: DataFrame) -> None:
        self.rows = ordered(turns)
        signed = signatures(self.rows)
        self.solved = stored(signed, "signatures")
        #: (conv_id, signature, blank, duplicate, truncated, illegal, cost, audit)
        self.audits = stored(self.solved.join(solve(self.solved), "signature"), "audits")

    def turns(self) -> DataFrame:
        """(conv_id, place, edit, role, text): the repaired turns, numbered from 1; edit is K, R or I."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        names = ["conv_id", "place", "edit", "role", "text"]

        def run(batches):
            for conv, turns in _stream(batches):
                held = []
                for place, (edit, role, text) in enumerate(turns, 1):
                    held.append((conv, place, edit, role, text))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in held], schema=of)
                        held = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in held], schema=of)

        of = _arrow(self.rows, ["conv_id"], [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        return _with_audits(self.rows, self.audits).mapInArrow(lean(run), f"conv_id {kind}, place bigint, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of the repaired turns as ``role:text``, joined by newlines."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        of = _arrow(self.rows, ["conv_id"], [("repaired_sha256", pa.string())])

        def run(batches):
            held = []
            for conv, turns in _stream(batches):
                digest = hashlib.sha256()
                for at, (_, role, text) in enumerate(turns):
                    digest.update(f"{chr(10) if at else ''}{role}:{text}".encode())
                held.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                if len(held) == 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=of)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=of)

        return _with_audits(self.rows, self.audits).mapInArrow(lean(run), f"conv_id {kind}, repaired_sha256 string")


def _arrow(df: DataFrame, columns: list[str], more: list[tuple[str, pa.DataType]]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*(to_arrow_schema(df.select(columns).schema)), *[pa.field(*x) for x in more]])


def repair_damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``turns``.

    ``turns`` is damaged first (see ``damage``), then repaired (see ``Repair``). ``gaps`` is
    the turn numbers missing between the least and the greatest, nulls left out. A
    conversation without rows after the damage has zeros and the hash of an empty string.
    """
    hurt = damage(turns)
    repair = Repair(hurt)
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.countDistinct("turn")
    gaps = repair.rows.groupBy("conv_id").agg(F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1)).cast("bigint").alias("gaps"))
    conversations = turns.select("conv_id").distinct()
    for part in (gaps, repair.audits.drop("signature"), repair.digests()):
        part = part.withColumnRenamed("conv_id", "part_id")
        conversations = conversations.join(part, conversations["conv_id"].eqNullSafe(part["part_id"]), "left").drop("part_id")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return conversations.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


REPAIR_SQL = r"""
WITH RECURSIVE named AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), summed AS (
  -- CRC-32: each byte is added to the remainder, which then gives up eight bits.
  SELECT * EXCLUDE k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           flatten(list_transform(range(1, len(k) + 1), lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) % 20 AS fault FROM named
), hurt AS (
  SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM summed WHERE fault <> 0
), placed AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt
), judged AS (
  SELECT *, role[1] AS initial, coalesce(lag(role[1]) OVER (PARTITION BY c ORDER BY n) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'sound' END AS first_fault FROM placed
), inserts(state, mid, edits, cost) AS (
  VALUES (0, 0, '', 0), (0, 2, 'I', 5), (0, 3, 'II', 10), (1, 1, '', 0), (1, 2, 'I', 5), (1, 3, 'II', 10),
         (2, 2, '', 0), (2, 3, 'I', 5), (2, 2, 'II', 10), (3, 3, '', 0), (3, 2, 'I', 5), (3, 3, 'II', 10)
), edits(mid, initial, edit, state, cost) AS (
  VALUES (0, '', 'D', 0, 2), (1, '', 'D', 1, 2), (2, '', 'D', 2, 2), (3, '', 'D', 3, 2),
         (0, '', 'R', 2, 1), (1, '', 'R', 2, 1), (2, '', 'R', 3, 1), (3, '', 'R', 2, 1),
         (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0), (3, 'u', 'K', 2, 0)
), dp AS (
  SELECT DISTINCT c, 0::BIGINT AS n, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM hurt
  UNION ALL
  SELECT j.c, j.n, e.state, min({'cost': dp.best.cost + i.cost + e.cost + CASE WHEN e.edit <> 'D' AND j.first_fault = 'truncated' THEN 5 ELSE 0 END,
                                 'audit': dp.best.audit || i.edits || e.edit})
  FROM dp JOIN judged j ON j.c = dp.c AND j.n = dp.n + 1 JOIN inserts i ON i.state = dp.state JOIN edits e ON e.mid = i.mid
  WHERE (e.initial = '' OR e.initial = j.initial) AND (e.edit = 'D' OR j.first_fault NOT IN ('blank', 'duplicate'))
  GROUP BY j.c, j.n, e.state
), last AS (
  SELECT c, max(n) AS n, count(*) FILTER (first_fault = 'blank') AS blank, count(*) FILTER (first_fault = 'duplicate') AS duplicate,
         count(*) FILTER (first_fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM judged GROUP BY c
), answer AS (
  SELECT last.c, any_value(last) AS l, min({'cost': dp.best.cost + i.cost, 'audit': dp.best.audit || i.edits}) AS best
  FROM last JOIN dp ON dp.c = last.c AND dp.n = last.n JOIN inserts i ON i.state = dp.state AND i.mid IN (0, 3) GROUP BY last.c
), marks AS (
  SELECT c, unnest(range(1, len(best.audit) + 1)) AS spot, best.audit AS audit FROM answer
), chosen AS (
  SELECT m.c, m.spot, m.audit[m.spot] AS edit, len(replace(m.audit[1:m.spot], 'I', '')) AS n FROM marks m
), stayed AS (
  SELECT ch.c, ch.spot, ch.edit, j.role, j.text, sum(CASE WHEN ch.edit = 'K' AND j.initial = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY ch.c ORDER BY ch.spot) AS place
  FROM chosen ch LEFT JOIN judged j ON j.c = ch.c AND j.n = ch.n AND ch.edit <> 'I' WHERE ch.edit <> 'D'
), told AS (
  SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY spot) AS said
  FROM stayed GROUP BY c
)
SELECT conv_id, coalesce(l.gaps, 0)::BIGINT AS gaps, coalesce(l.blank, 0)::BIGINT AS blank, coalesce(l.duplicate, 0)::BIGINT AS duplicate,
       coalesce(l.truncated, 0)::BIGINT AS truncated, coalesce(l.illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM named) v LEFT JOIN answer ON answer.c = v.c LEFT JOIN told ON told.c = v.c
"""
