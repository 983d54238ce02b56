"""Super-k-mers: consecutive windows that share a minimiser, packed as one string.

A window is ``span`` consecutive units (words or bytes). Its minimiser is the least
hash among the ``gram``-unit pieces inside it, so equal windows have equal
minimisers and meet in the same bucket; a run of windows with one minimiser travels
as the one string that covers them. Each map task first merges equal strings.

A document is known by two numbers, its id and a hash of its text (see ``keyed``), so
that rows which repeat an id, or have none, are told apart and equal rows are not.

A string that a third of all documents share must not bring all its places to one
task. So of a string with more than HOT_PLACES places in what a map task holds, two
places travel with the string, and the others by themselves, dealt evenly, under a
128-bit hash of the string; the string's bucket then says, under that hash, which of
its windows are repeats, and a join tells the places, a join whose hot keys Spark splits.

A minimiser that a large share of all different windows have must not bring them to one
task either: buckets that would be too large are found beforehand, and their windows are
dealt by their two least pieces, which equal windows share as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import lean, parallelism, stored

#: Text of one bucket on average, in bytes.
BUCKET_BYTES = 4 << 20
#: Text of a bucket from which on its windows are dealt by two pieces instead of one.
CROWDED_BYTES = 64 << 20
#: Text that plans the layout, in bytes, and its least share of all: it moves work, not results.
PLANNING_BYTES, PLANNING_SHARE = 48 << 20, 1024
#: Windows in one string at most; longer runs are cut, which does not move any window's bucket.
LONGEST_RUN = 1024
#: Buckets for each partition of the shuffle at least; one bucket is worked on at a time.
BUCKETS_PER_PARTITION = 4
#: Units scanned together; longer documents are scanned in overlapping pieces.
SCAN_BYTES = 1 << 20
#: Packed bytes held before buckets are written out.
FLUSH_BYTES = 24 << 20
#: Places of one string in one flush beyond which they travel apart from it.
HOT_PLACES = 256

_M1, _M2, _R = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Units hashed together; the tables of powers are this long, but for a longer single piece.
HASH_UNITS = 1 << 18
_FORWARD, _BACK = _powers(_R, HASH_UNITS + 1), _powers(pow(_R, -1, 2**64), HASH_UNITS + 1)


def piece_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces of a sequence of bytes or 64-bit values, from running sums modulo 2**64.

    Pieces come in order of their starts and ends and may overlap. Memory is that of
    HASH_UNITS values or the longest piece.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + HASH_UNITS, side="right")))
        some = values[low : int(ends[to - 1])]
        some = some.astype(np.uint64) + np.uint64(1) if some.dtype == np.uint8 else some
        n = len(some)
        forward, back = (_FORWARD, _BACK) if n <= HASH_UNITS else (_powers(_R, n + 1), _powers(pow(_R, -1, 2**64), n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(some * forward[:n], out=sums[1:])
        first = starts[at:to] - low
        out[at:to] = mix64((sums[ends[at:to] - low] - sums[first]) * back[first])
        at = to
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def two_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the second least different value of each ``width`` consecutive ones; all bits set where there is no second."""
    none = np.uint64(2**64 - 1)

    def join(a, b, c, d):
        low, high = np.minimum(a, c), np.maximum(a, c)
        return low, np.minimum(np.where(high == low, none, high), np.minimum(b, d))

    have, least, second = 1, values, np.full(len(values), none)
    while have * 2 <= width:
        least, second = join(least[:-have], second[:-have], least[have:], second[have:])
        have *= 2
    rest = width - have
    if rest:
        n = len(least) - rest
        least, second = join(least[:n], second[:n], least[rest:], second[rest:])
    return least, second


@dataclass(frozen=True)
class Layout:
    """How windows are dealt: the number of buckets, and those whose windows go by two pieces."""

    buckets: int
    crowded: np.ndarray

    def bucket(self, value: np.ndarray) -> np.ndarray:
        return (mix64(value ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.buckets)).astype(np.int32)

    def values(self, pieces: np.ndarray, width: int) -> np.ndarray:
        """What each window of ``width`` pieces is dealt by."""
        least = sliding_min(pieces, width)
        if not len(self.crowded):
            return least
        full = np.isin(self.bucket(least), self.crowded)
        if full.any():
            both, second = two_least(pieces, width)
            least = np.where(full, mix64(both + mix64(second)), least)
        return least


def plan_layout(source: DataFrame, weigh: Callable[[list[bytes], Layout], np.ndarray], crowded: int = CROWDED_BYTES) -> Layout:
    """Buckets from the bytes of all texts, and the crowded ones from the texts of least hash.

    ``weigh`` gives the bytes that some texts would bring to each bucket. Only crowded
    buckets reach the driver: no more than all bytes over ``crowded``.
    """
    spark = source.sparkSession
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parallelism(spark) * BUCKETS_PER_PARTITION, total // BUCKET_BYTES)
    if total <= crowded:
        return Layout(buckets, np.zeros(0, np.int32))
    one_in = int(min(PLANNING_SHARE, max(1, total // PLANNING_BYTES)))
    plain = Layout(buckets, np.zeros(0, np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += weigh([x.as_py().encode() for x in batch.column(0)], plain)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "bytes"])

    chosen = source.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("k1", "k2"), F.lit(one_in)) == 0)).select("text")
    weighed = chosen.mapInArrow(lean(run), "bucket int, bytes bigint").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    full = [r["bucket"] for r in weighed.filter(F.col("bytes") * one_in > crowded).select("bucket").collect()]
    return Layout(buckets, np.array(sorted(full), np.int32))


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """k1 and k2: a row's id (a hash of its text where it has none) and a hash of its text."""
    id_, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    return [F.coalesce(id_, F.xxhash64(F.lit("without id"), text)).alias("k1"), F.xxhash64(text).alias("k2")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): each row with its two numbers."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *row_keys(id_col, text_col))


def runs(values: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and values of runs of neighbouring valid places with one value."""
    places = np.flatnonzero(valid)
    if not len(places):
        return places, places, values[:0]
    v = values[places]
    first = np.ones(len(places), bool)
    first[1:] = (places[1:] != places[:-1] + 1) | (v[1:] != v[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(places)))
    starts, v = places[at], v[at]
    if counts.max() > LONGEST_RUN:
        parts = -(-counts // LONGEST_RUN)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, v = np.repeat(starts, parts) + step * LONGEST_RUN, np.repeat(v, parts)
        counts = np.minimum(np.repeat(counts, parts) - step * LONGEST_RUN, LONGEST_RUN)
    return starts, counts, v


def _planes(values: np.ndarray) -> bytes:
    """Differences of whole numbers, byte planes apart, which compress well."""
    return np.diff(values.astype("<i8"), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: memoryview, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<i8").ravel())


class Packer:
    """Collects (bucket, string, document, place) and writes a blob for each bucket."""

    def __init__(self, layout: Layout, hot: int = HOT_PLACES) -> None:
        self.layout, self.buckets, self.hot, self.size = layout, layout.buckets, hot, 0
        self.strings: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.zip = zstandard.ZstdCompressor(level=6)

    def add(self, values: np.ndarray, strings: list[bytes], docs: np.ndarray, marks: np.ndarray, places: np.ndarray) -> None:
        self.strings += strings
        self.parts.append((self.layout.bucket(values), docs, marks, places))
        self.size += sum(map(len, strings)) + 64 * len(strings)

    def full(self) -> bool:
        return self.size >= FLUSH_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.strings:
            return
        buckets, docs, marks, places = (np.concatenate(x) for x in zip(*self.parts))
        strings, self.strings, self.parts, self.size = self.strings, [], [], 0
        order = np.argsort(buckets, kind="stable")
        cuts = np.flatnonzero(np.diff(buckets[order])) + 1
        keys, blobs = [], []
        for part in np.split(order, cuts):
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(strings[i], len(known)) for i in part.tolist()], np.int64)
            much = np.flatnonzero(np.bincount(ids) > max(2, self.hot))
            mine_docs, mine_marks, mine_places = docs[part], marks[part], places[part]
            if len(much):
                names, apart = list(known), np.zeros(len(ids), bool)
                for s in much.tolist():
                    own = np.flatnonzero(ids == s)
                    own = own[np.argsort(mine_docs[own], kind="stable")][2:]
                    apart[own] = True
                    key, blob = self._apart(names[s], mine_docs[own], mine_marks[own], mine_places[own])
                    keys.append(key)
                    blobs.append(blob)
                ids, mine_docs, mine_marks, mine_places = (x[~apart] for x in (ids, mine_docs, mine_marks, mine_places))
            body = [
                np.array([len(known), len(ids), len(much)], "<i8").tobytes(),
                _planes(np.fromiter(map(len, known), np.int64, len(known))),
                _planes(ids),
                _planes(mine_docs),
                _planes(mine_places),
                _planes(much),
                mine_marks.astype("<i8").tobytes(),
                b"".join(known),
            ]
            keys.append(int(buckets[part[0]]))
            blobs.append(self.zip.compress(b"".join(body)))
        for at in range(0, len(keys), 64):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 64], pa.int32()), pa.array(blobs[at : at + 64], pa.binary())], names=["bucket", "blob"])

    def _apart(self, string: bytes, docs: np.ndarray, marks: np.ndarray, places: np.ndarray) -> tuple[int, bytes]:
        """Places without their string, for a bucket that only their documents choose."""
        spread = int(mix64(docs[:1].astype(np.uint64) + np.uint64(len(docs)))[0] % np.uint64(self.buckets))
        body = [*(x.to_bytes(8, "little", signed=True) for x in string_hash(string)), len(docs).to_bytes(8, "little"), _planes(docs), _planes(places), marks.astype("<i8").tobytes()]
        return self.buckets + spread, self.zip.compress(b"".join(body))


def string_hash(string: bytes) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    digest = xxhash.xxh3_128_digest(string)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


PACKED_SCHEMA = "bucket int, blob binary"


def unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings; for each place the string's number, the document's two numbers and the place; numbers of strings with places apart."""
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n, m, k = np.frombuffer(data[:24], "<i8").tolist()
    at, columns = 24, []
    for size in (n, m, m, m, k):
        columns.append(_unplanes(data[at : at + 8 * size], size))
        at += 8 * size
    marks = np.frombuffer(data[at : at + 8 * m], "<i8")
    body, ends = bytes(data[at + 8 * m :]), np.cumsum(columns[0]).tolist()
    _, ids, docs, places, hot = columns
    return [body[a:b] for a, b in zip([0, *ends], ends)], ids, docs, marks, places, hot


def gather(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of a bucket and all places, over its blobs; numbers of strings with places apart."""
    known: dict[bytes, int] = {}
    parts = []
    for blob in blobs:
        strings, ids, docs, marks, places, hot = unpack(blob)
        mine = np.array([known.setdefault(s, len(known)) for s in strings], np.int64)
        parts.append((mine[ids], docs, marks, places, mine[hot]))
    ids, docs, marks, places, hot = (np.concatenate(x) for x in zip(*parts))
    return list(known), ids, docs, marks, places, np.unique(hot)


#: A range: the document's two numbers, start, length. A place apart: these, start, and its string's
#: hash. A verdict: the string's hash, start and length of a run of repeats, for documents above
#: ``above``, or for all where that is null.
FOUND_SCHEMA = "k1 bigint, k2 bigint, start bigint, length bigint, h1 bigint, h2 bigint, above bigint"
_FOUND = ["k1", "k2", "start", "length", "h1", "h2", "above"]


def _found(n: int, **columns) -> Iterator[pa.RecordBatch]:
    for at in range(0, n, 100_000):
        end = min(n, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(columns[c][at:end], pa.int64()) if c in columns else pa.nulls(end - at, pa.int64()) for c in _FOUND], names=_FOUND)


def verdicts(strings: list[bytes], hot: np.ndarray, runs_of: Callable[[int], Iterator[tuple[int, int, int | None]]]) -> dict[str, list]:
    """The runs (start, length, above) of each string with places apart, under its hash."""
    out: dict[str, list] = {c: [] for c in ("h1", "h2", "start", "length", "above")}
    for s in hot.tolist():
        h1, h2 = string_hash(strings[s])
        for run in runs_of(s):
            for c, x in zip(out, (h1, h2, *run)):
                out[c].append(x)
    return out


def by_bucket(buckets: int, work: Callable[[list[bytes]], Iterator[dict]]):
    """A mapInArrow function for partitions sorted by bucket: one bucket's blobs at a time."""

    def places(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for blob in blobs:
            data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
            h1, h2 = (int.from_bytes(data[k : k + 8], "little", signed=True) for k in (0, 8))
            n = int.from_bytes(data[16:24], "little")
            docs, starts = _unplanes(data[24 : 24 + 8 * n], n), _unplanes(data[24 + 8 * n : 24 + 16 * n], n)
            marks = np.frombuffer(data[24 + 16 * n :], "<i8")
            yield from _found(n, k1=docs, k2=marks, start=starts, h1=np.full(n, h1), h2=np.full(n, h2))

    def of(key: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if key >= buckets:
            yield from places(blobs)
            return
        for columns in work(blobs):
            yield from _found(len(columns["start"]), **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != current and blobs:
                    yield from of(current, blobs)
                    blobs = []
                current = key
                blobs.append(blob.as_py())
        if blobs:
            yield from of(current, blobs)

    return run


def ranges(packed_rows: DataFrame, buckets: int, work: Callable[[list[bytes]], Iterator[dict]], label: str) -> DataFrame:
    """(k1, k2, start, length) from packed rows: each bucket's work, and the places that travelled apart."""
    dealt = packed_rows.repartition(parallelism(packed_rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(lean(by_bucket(buckets, work)), FOUND_SCHEMA), label)
    apart = found.filter("h1 IS NOT NULL AND length IS NULL").select("k1", "k2", F.col("start").alias("place"), "h1", "h2")
    said = found.filter("h1 IS NOT NULL AND length IS NOT NULL").select("h1", "h2", "start", "length", "above")
    told = apart.join(said, ["h1", "h2"]).filter("above IS NULL OR k1 > above").select("k1", "k2", (F.col("place") + F.col("start")).alias("start"), "length")
    return found.filter("h1 IS NULL").select("k1", "k2", "start", "length").unionByName(told)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n units some range covers; ranges are clipped to n."""
    out = np.zeros(n, bool)
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate((starts + lengths)[order])
    # Ranges that meet are one: a new one starts beyond all that came before.
    first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    for a, b in zip(begin[first].tolist(), end[np.append(first[1:] - 1, len(end) - 1)].tolist()):
        out[a:b] = True
    return out
