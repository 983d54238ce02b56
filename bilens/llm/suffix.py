"""Repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .storage import lean, ship
from .substring import with_ranges

MATCH_BYTES = 400
#: Bytes of a minimiser piece.
GRAM_BYTES = 16
#: Modulus of the difference cover.
PERIOD = 16
#: Suffixes sorted together at most, unless one bucket alone has more.
BLOCK_SUFFIXES = 1 << 19


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo ``period`` is one of two of them (greedy)."""
    cover = [0]
    met = {0}
    while len(met) < period:
        gain = {c: {(c - d) % period for d in cover} | {(d - c) % period for d in cover} for c in range(period) if c not in cover}
        best = max(gain, key=lambda c: (len(gain[c] - met), -c))
        cover.append(best)
        met |= gain[best]
    return sorted(cover)


COVER = difference_cover(PERIOD)


def _shifts(period: int, cover: list[int]) -> np.ndarray:
    """For residues (i, j), a shift that takes both into the cover."""
    out = np.zeros((period, period), np.int64)
    for i in range(period):
        for j in range(period):
            out[i, j] = next(s for s in range(period) if (i + s) % period in cover and (j + s) % period in cover)
    return out


SHIFTS = _shifts(PERIOD, COVER)


class CoverSample:
    """Ranks of the cover's suffixes by their first ``depth`` bytes, and comparisons by them.

    Two suffixes are compared on their first PERIOD bytes, then by the ranks of two
    sample suffixes the same shift further on, then on the last bytes of the match; so
    a tie of any length costs one look-up, and memory is that of the sample.
    """

    def __init__(self, text: bytes, match: int) -> None:
        self.match = match
        self.depth = (match - PERIOD + 1) // PERIOD * PERIOD
        self.tail = list(range(self.depth, match - 7, 8))
        if match % 8 or not self.tail or self.tail[-1] != match - 8:
            self.tail.append(match - 8)
        buf = np.frombuffer(text + bytes(match + 2 * PERIOD), np.uint8)
        self.word = np.ndarray(len(buf) - 7, ">u8", buf, 0, (1,)).astype("<u8")
        n = len(text)
        at = np.flatnonzero(np.resize(np.isin(np.arange(PERIOD), COVER), n)) if n else np.zeros(0, np.int64)
        ranks = np.zeros(n + match + 2 * PERIOD, np.int64)
        first, second = self.word[at], self.word[at + 8]
        order = np.lexsort((second, first))
        new = np.ones(len(order), np.int64)
        new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        ranks[at[order]] = np.cumsum(new)
        have = PERIOD
        while have < self.depth:
            step = min(have, self.depth - have)
            pair = ranks[at] * (n + 2) + ranks[at + step]
            order = np.argsort(pair)
            new = np.ones(len(order), np.int64)
            new[1:] = np.diff(pair[order]) != 0
            ranks[at[order]] = np.cumsum(new)
            have += step
        self.ranks = ranks

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair: the order of the ``match`` bytes at i and at j."""
        out = np.zeros(len(i), np.int8)
        open_ = np.arange(len(i))

        def settle(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal open_
            out[open_] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            open_ = open_[a == b]

        for k in range(0, PERIOD, 8):
            settle(self.word[i[open_] + k], self.word[j[open_] + k])
        shift = SHIFTS[i[open_] % PERIOD, j[open_] % PERIOD]
        settle(self.ranks[i[open_] + shift], self.ranks[j[open_] + shift])
        for k in self.tail:
            settle(self.word[i[open_] + k], self.word[j[open_] + k])
        return out


def equal_classes(sample: CoverSample, suffixes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For each suffix, the number of its class of equal matches within its bucket.

    Three-way quicksort of all buckets at once: each round compares the members of each
    part with the part's middle one, and splits it into less, equal and greater.
    """
    n = len(suffixes)
    classes = np.full(n, -1, np.int64)
    order = np.argsort(bucket, kind="stable")
    part = np.cumsum(np.append(0, np.diff(bucket[order]) != 0)) if n else order
    made = 0
    while len(order):
        first = np.flatnonzero(np.append(True, np.diff(part) != 0))
        size = np.diff(np.append(first, len(order)))
        pivot = order[np.repeat(first + size // 2, size)]
        sign = sample.compare(suffixes[order], suffixes[pivot])
        same = sign == 0
        group = np.cumsum(np.append(0, np.diff(part[same]) != 0))
        classes[order[same]] = made + group
        made += int(group[-1]) + 1
        rest, key = order[~same], (part[~same] * 2 + (sign[~same] > 0))
        if not len(rest):
            break
        again = np.argsort(key, kind="stable")
        order, key = rest[again], key[again]
        part = np.cumsum(np.append(0, np.diff(key) != 0))
    return classes


def _grams(text: bytes, gram: int) -> np.ndarray:
    buf = np.frombuffer(text, np.uint8)
    word = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))
    n = len(buf) - gram + 1
    out = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    out += word[gram - 8 : gram - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return packed.mix64(out)


def _scan(flat: list[bytes], docs: list[int], marks: list[int], bases: list[int], packer: packed.Packer, match: int, gram: int) -> None:
    text = b"".join(flat)
    n = np.fromiter(map(len, flat), np.int64, len(flat))
    first = np.cumsum(n) - n
    least = packer.layout.values(_grams(text, gram), match - gram + 1)
    last = np.repeat(first + n - match, n)[: len(least)]
    begin, length, value = packed.runs(least, np.arange(len(least)) <= last)
    if len(begin):
        piece = np.searchsorted(first, begin, side="right") - 1
        ends = (begin + length + match - 1).tolist()
        packer.add(value, [text[i:j] for i, j in zip(begin.tolist(), ends)], np.array(docs)[piece], np.array(marks)[piece], np.array(bases)[piece] + begin - first[piece])


def _pack(layout: packed.Layout, match: int, gram: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packed.Packer(layout, hot)
        held: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            for text, doc, mark in zip(batch.column("text"), batch.column("k1").to_pylist(), batch.column("k2").to_pylist()):
                data = (text.as_py() or "").encode()
                if len(data) < match:
                    continue
                for base in range(0, len(data) - match + 1, packed.SCAN_BYTES):
                    piece = data[base : base + packed.SCAN_BYTES + match - 1]
                    for kept, item in zip(held, (piece, doc, mark, base)):
                        kept.append(item)
                    size += len(piece)
                    if size >= packed.SCAN_BYTES:
                        _scan(*held, packer, match, gram)
                        held, size = ([], [], [], []), 0
                    if packer.full():
                        yield from packer.flush()
        if size:
            _scan(*held, packer, match, gram)
        yield from packer.flush()

    return run


def _blocks(strings: np.ndarray, minimiser: np.ndarray, windows: np.ndarray) -> Iterator[np.ndarray]:
    """The strings, all of a minimiser together, in parts of BLOCK_SUFFIXES windows or one minimiser."""
    strings = strings[np.argsort(minimiser[strings], kind="stable")]
    if not len(strings):
        return
    key = minimiser[strings]
    total = np.cumsum(windows[strings])
    ends = np.flatnonzero(np.append(np.diff(key) != 0, True)) + 1
    begin = done = 0
    for previous, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        if previous > begin and total[end - 1] - done > BLOCK_SUFFIXES:
            yield strings[begin:previous]
            begin, done = previous, int(total[previous - 1])
    yield strings[begin:]


def _hits(text: bytes, starts: np.ndarray, sizes: np.ndarray, least: np.ndarray, gram: int) -> np.ndarray:
    """Where in the joined strings each string's own minimiser occurs."""
    grams = _grams(text, gram)
    owner = np.repeat(np.arange(len(starts)), sizes)[: len(grams)]
    return (grams == least[owner]) & (np.arange(len(grams)) <= (starts + sizes - gram)[owner])


def _repeats(match: int, gram: int):
    """For a bucket: the byte ranges that repeated windows cover."""

    def flags(strings: list[bytes], count: np.ndarray) -> np.ndarray:
        """For each window of each string, in order: does it start anywhere else?"""
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        windows = size - match + 1
        offset = np.cumsum(windows) - windows
        flagged = np.repeat(count > 1, windows)
        text = b"".join(strings)
        start = np.cumsum(size) - size
        grams = _grams(text, gram)
        owner_of_gram = np.repeat(np.arange(len(strings)), size)[: len(grams)]
        # The last pieces of a string run into the next one.
        across = (np.cumsum(size)[:, None] - np.arange(1, gram)).ravel()
        grams[across[across < len(grams)]] = np.uint64(2**64 - 1)
        least = np.minimum.reduceat(grams, start)
        # Only strings whose minimiser occurs twice can hold a window that another place has too.
        _, inverse, times = np.unique(least, return_inverse=True, return_counts=True)
        own = np.add.reduceat(grams == least[owner_of_gram], start, dtype=np.int64)
        todo = np.flatnonzero((times[inverse] > 1) | (own > 1))
        for chosen in _blocks(todo, inverse, windows):
            some = [strings[s] for s in chosen.tolist()]
            block = b"".join(some)
            at = np.cumsum(size[chosen]) - size[chosen]
            mine = np.repeat(np.arange(len(chosen)), windows[chosen])
            within = np.arange(len(mine)) - (np.cumsum(windows[chosen]) - windows[chosen])[mine]
            suffix = at[mine] + within
            # A suffix bucket: the minimiser and how far into the match it first occurs.
            hit = np.flatnonzero(_hits(block, at, size[chosen], least[chosen], gram))
            ahead = hit[np.searchsorted(hit, suffix)] - suffix
            bucket = packed.mix64(least[chosen][mine] ^ packed.mix64(ahead.astype(np.uint64)))
            order = np.argsort(bucket)
            sorted_ = bucket[order]
            equal = sorted_[1:] == sorted_[:-1]
            shared = np.zeros(len(order), bool)
            shared[1:] |= equal
            shared[:-1] |= equal
            pick = order[shared]
            if not len(pick):
                continue
            classes = equal_classes(CoverSample(block, match), suffix[pick], bucket[pick].view(np.int64))
            weight = np.bincount(classes, weights=count[chosen][mine[pick]]) > 1
            rows = offset[chosen][mine[pick]] + within[pick]
            flagged[rows] |= weight[classes]
        return flagged

    def work(blobs: list[bytes]) -> Iterator[dict]:
        strings, ids, docs, marks, places, hot = packed.gather(blobs)
        count = np.bincount(ids, minlength=len(strings))
        windows = np.fromiter(map(len, strings), np.int64, len(strings)) - match + 1
        offset = np.cumsum(windows) - windows
        flagged = flags(strings, count)
        begins = flagged.copy()
        begins[1:] &= ~flagged[:-1]
        begins[offset] = flagged[offset]
        stops = flagged.copy()
        stops[:-1] &= ~flagged[1:]
        stops[offset + windows - 1] = flagged[offset + windows - 1]
        on, off = np.flatnonzero(begins), np.flatnonzero(stops)
        owner = np.searchsorted(offset, on, side="right") - 1
        # Each place of a string gets the string's runs.
        runs_of = np.bincount(owner, minlength=len(strings))
        first_run = np.cumsum(runs_of) - runs_of
        per_place = runs_of[ids]
        place = np.repeat(np.arange(len(ids)), per_place)
        run = first_run[ids[place]] + np.arange(len(place)) - (np.cumsum(per_place) - per_place)[place]
        yield {"k1": docs[place], "k2": marks[place], "start": places[place] + on[run] - offset[ids[place]], "length": off[run] - on[run] + match}

        def runs_of_string(s: int) -> Iterator[tuple[int, int, None]]:
            for k in range(first_run[s], first_run[s] + runs_of[s]):
                yield int(on[k] - offset[s]), int(off[k] - on[k] + match), None

        yield packed.verdicts(strings, hot, runs_of_string)

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = ([], [], [], [], [])
        for text, ranges in zip(batch.column(1), batch.column(2)):
            data = kept = (text.as_py() or "").encode()
            removed = spans = 0
            if len(ranges.values or ()):
                pairs = ranges.values
                gone = packed.covered(len(data), pairs.field(0).to_numpy(), pairs.field(1).to_numpy())
                removed, spans = int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            for column, item in zip(made, (len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(item)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, kind) for x, kind in zip(made, kinds))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH_BYTES, gram: int = GRAM_BYTES, hot: int = packed.HOT_PLACES, crowded: int = packed.CROWDED_BYTES) -> DataFrame:
    """(k1, k2, start, length): byte ranges to cut, which may overlap, of documents as ``packed.keyed`` names them."""
    if match < gram + PERIOD or gram < 8 or match < 3 * PERIOD:
        raise ValueError("match must be at least 48 bytes and longer than the minimiser by 16")
    ship(docs.sparkSession)
    source = packed.keyed(docs, id_col, text_col)

    def weigh(texts: list[bytes], layout: packed.Layout) -> np.ndarray:
        out = np.zeros(layout.buckets, np.int64)
        for text in texts:
            for at in range(0, len(text) - match + 1, packed.SCAN_BYTES):
                least = packed.sliding_min(_grams(text[at : at + packed.SCAN_BYTES + match - 1], gram), match - gram + 1)
                out += np.bincount(layout.bucket(least), minlength=layout.buckets)
        return out

    layout = packed.plan_layout(source, weigh, crowded)
    rows = source.mapInArrow(lean(_pack(layout, match, gram, hot)), packed.PACKED_SCHEMA)
    return packed.ranges(rows, layout.buckets, _repeats(match, gram), "bytes")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH_BYTES, hot: int = packed.HOT_PLACES, crowded: int = packed.CROWDED_BYTES) -> DataFrame:
    """Cut each byte that a string of ``match`` bytes which also starts elsewhere covers.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining
    bytes). Texts are whole UTF-8 byte strings, null is empty; matches never cross
    documents, may overlap, may lie in one document, and are judged on the input, so
    every copy goes. Every row is a document of its own, whether its id repeats or is
    null, and loses what its own text repeats. Further columns are ignored; no rows give
    no rows.

    Windows meet by minimiser in packed strings. In a bucket, suffixes that share a
    minimiser at one distance form the suffix buckets, sorted a block at a time, and
    ranks of a difference cover, computed before, settle long ties.
    """
    ranges = repeated_ranges(docs, id_col, text_col, match, hot=hot, crowded=crowded)
    return with_ranges(docs, ranges, id_col, text_col).mapInArrow(
        lean(_cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), win AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d)
), twice AS (
  SELECT k FROM win GROUP BY k HAVING count(*) > 1
), hit AS (
  SELECT doc_id, i FROM win SEMI JOIN twice USING (k)
), marked AS (
  SELECT doc_id, i, CASE WHEN i > lag(i, 1, -1000) OVER w + 400 THEN 1 ELSE 0 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, g
), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) = 1 AS last FROM spans
), kept AS (
  SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS t
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
