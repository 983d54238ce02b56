"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder."""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, ship

#: Fixed: how the vocabulary's published pre-tokeniser cuts a text.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Closed pre-tokens whose tokens the transducer remembers, in each of two generations, and their longest.
CACHE_ENTRIES = 250_000
CACHED_CHARS = 48
#: Bytes worked on at once besides the lookahead.
STEP_BYTES = 256
_PIECES = 50_000
_BATCH_BYTES = 16 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, inverted.

    Printable Latin-1 bytes stand for themselves, the rest for letters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which what comes next cannot change a token.

    Take a text and a longer one, and apply the merges in order to both. They agree
    left of a common token boundary, at first the shorter text's end. A merge (u, v)
    moves that boundary only if it joins u on its left with v on its right, and then by
    len(u). Right of the boundary is then a token that starts with the u of the merge
    that moved it last; so v must have that u on its left spine. The longest such chain
    of later and later merges, in bytes, bounds how far the boundary can move.
    """
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        before, spine = 0, v
        while spine is not None:
            before = max(before, reach.get(spine, 0))
            spine = left.get(spine)
        moved = len(u) + before
        reach[u] = max(reach.get(u, 0), moved)
        left.setdefault(u + v, u)
        most = max(most, moved)
    return most


class Transducer:
    """Bytes with boundaries in, tokens out, with memory for the lookahead and one step only.

    ``feed`` takes bytes of the open pre-token and gives the tokens that nothing to come can
    change: those that end ``lookahead`` bytes before what is held. ``close`` is a boundary,
    which no merge crosses, so all that is held becomes stable and is emitted.
    """

    def __init__(self, model: Bpe) -> None:
        self.model, self.held = model, b""

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), STEP_BYTES):
            self.held += data[at : at + STEP_BYTES]
            if len(self.held) < STEP_BYTES + self.model.lookahead:
                continue
            stable, end = len(self.held) - self.model.lookahead, 0
            for token in self.model.merge(self.held):
                if end + self.model.size[token] > stable:
                    break
                end += self.model.size[token]
                yield token
            self.held = self.held[end:]

    def close(self) -> Iterator[int]:
        held, self.held = self.held, b""
        yield from self.model.merge(held)

    def run(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """The tokens of a stream of closed pre-tokens, as little-endian 32-bit numbers."""
        return map(self.model.closed.__getitem__, pieces)


class _Closed(dict):
    """Closed pre-token -> what the transducer emits for it; short ones are remembered, those in use longest."""

    def __init__(self, model: Bpe) -> None:
        super().__init__()
        self.machine, self.older = Transducer(model), {}

    def __missing__(self, piece: str) -> bytes:
        codes = self.older.get(piece)
        if codes is None:
            codes = array("I", self.machine.feed(piece.encode()))
            codes.extend(self.machine.close())
            codes = codes.tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = codes
        return codes


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.lookahead = sufficient_lookahead(merges)
        self.start = [vocab[bytes([b])] for b in range(256)]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = {i: len(t) for i, t in self.bytes.items()}
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.pattern = regex.compile(PRETOKENS)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.closed = _Closed(self)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a bounded string: the first merge in the list goes first, leftmost first."""
        tokens = [self.start[b] for b in data]
        if len(tokens) <= 64:
            rank, none = self.rank.get, len(self.made)
            ranks = [rank(p, none) for p in zip(tokens, tokens[1:])]
            while ranks and (least := min(ranks)) < none:
                k = ranks.index(least)
                tokens[k : k + 2] = [self.made[least]]
                del ranks[k]
                if k < len(ranks):
                    ranks[k] = rank((tokens[k], tokens[k + 1]), none)
                if k:
                    ranks[k - 1] = rank((tokens[k - 1], tokens[k]), none)
            return tokens
        after = [*range(1, len(tokens)), -1]
        before = [-1, *range(len(tokens) - 1)]
        rank = self.rank
        heap = [(rank[p], k, *p) for k, p in enumerate(zip(tokens, tokens[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            order, k, a, b = heapq.heappop(heap)
            n = after[k]
            if tokens[k] != a or n < 0 or tokens[n] != b:
                continue
            tokens[k], tokens[n] = self.made[order], -1
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0 and (p := (tokens[x], tokens[after[x]])) in rank:
                    heapq.heappush(heap, (rank[p], x, *p))
        return [t for t in tokens if t >= 0]

    def encode(self, text: str) -> bytes:
        """Tokens of a whole text as little-endian 32-bit numbers."""
        out, machine = [], Transducer(self)
        for k, part in enumerate(self.split.split(text) if self.split and any(s in text for s in self.special) else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif len(part) <= 1 << 20:
                out.append(b"".join(machine.run(self.pattern.findall(part))))
            else:
                found = self.pattern.finditer(part)
                while piece := b"".join(machine.run([m.group() for m in islice(found, _PIECES)])):
                    out.append(piece)
        return b"".join(out)

    def decode(self, codes: bytes) -> str:
        """Text of tokens; bytes that are not UTF-8 become the replacement character."""
        return "".join(decode_stream(np.frombuffer(codes, "<u4"), self.table))


def decode_stream(tokens: np.ndarray, table: list[bytes], step: int = 1 << 16) -> Iterator[str]:
    """Text piece by piece; the state between pieces is a character's bytes so far."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(tokens), step):
        yield machine.decode(b"".join(map(table.__getitem__, tokens[at : at + step].tolist())))
    yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _batches(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str], size) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= _BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): each row's whole text as tokens.

    ``ids`` are little-endian unsigned 32-bit numbers. Null and empty texts have none. The
    vocabulary file, given by its path, is read once by each worker. Special tokens'
    strings in a text become those tokens, as the published library has it. Repeated
    rows and null ids come out as they went in, further columns are ignored.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        rows = ((i, model.encode(t.as_py() or "")) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        yield from _batches(((i, len(c) // 4, c) for i, c in rows), [pa.int64(), pa.int64(), pa.binary()], ["doc_id", "n_tokens", "ids"], lambda r: len(r[2]))

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lean(run), "doc_id bigint, n_tokens bigint, ids binary")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` (doc_id, n_tokens, ids) with ``decoded``, the tokens' text; null ids give an empty text."""
    ship(coded.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        rows = ((i, n, c.as_py(), model.decode(c.as_py() or b"")) for b in batches for i, n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        yield from _batches(rows, [pa.int64(), pa.int64(), pa.binary(), pa.string()], ["doc_id", "n_tokens", "ids", "decoded"], lambda r: 2 * len(r[2] or b""))

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(lean(run), "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def encode_checked(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): as ``encode``, and whether the tokens decode to the text (null as empty)."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        texts = ((i, t.as_py() or "") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        rows = ((i, len(c) // 4, c, model.decode(c) == t) for i, t in texts for c in [model.encode(t)])
        yield from _batches(rows, [pa.int64(), pa.int64(), pa.binary(), pa.bool_()], ["doc_id", "n_tokens", "ids", "round_trip"], lambda r: len(r[2]))

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lean(run), "doc_id bigint, n_tokens bigint, ids binary, round_trip boolean")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): each row's tokens, and the text that these decode to, in one pass."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        coded = ((i, model.encode(t.as_py() or "")) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        rows = ((i, len(c) // 4, c, model.decode(c)) for i, c in coded)
        yield from _batches(rows, [pa.int64(), pa.int64(), pa.binary(), pa.string()], ["doc_id", "n_tokens", "ids", "decoded"], lambda r: 2 * len(r[2]))

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lean(run), "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's tokens and of their text."""
    return encode_decode(docs, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
