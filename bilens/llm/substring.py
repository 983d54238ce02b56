"""Repeated word windows: all but the first document's copy are cut out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .storage import lean, ship

WINDOW_WORDS = 13
#: Words of a minimiser; single words and pairs can be too common to spread windows.
GRAM_WORDS = 3
_SPACE, _LINE = 32, 10


def _word_hashes(flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text with one separator between words."""
    buf = np.frombuffer(flat, np.uint8)
    ends = np.append(np.flatnonzero((buf == _SPACE) | (buf == _LINE)), len(buf))
    starts = np.concatenate(([0], ends[:-1] + 1))
    return starts, ends, packed.piece_hashes(buf, starts, ends)


def _pieces(words: list[bytes], span: int, most: int) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, max(1, len(words) - span + 1), most):
        yield at, words[at : at + most + span - 1]


def _scan(flat: list[bytes], counts: list[int], docs: list[int], marks: list[int], bases: list[int], packer: packed.Packer, span: int, gram: int) -> None:
    """Pack the windows of some pieces: texts with single spaces, word counts, documents (two numbers), first words."""
    text = b"\n".join(flat)
    starts, ends, hashes = _word_hashes(text)
    n = np.array(counts)
    first = np.cumsum(n) - n
    grams = packed.piece_hashes(hashes, np.arange(len(hashes) - gram + 1), np.arange(gram, len(hashes) + 1))
    least = packer.layout.values(grams, span - gram + 1)
    last = np.repeat(first + n - span, n)[: len(least)]
    begin, length, value = packed.runs(least, np.arange(len(least)) <= last)
    if len(begin):
        piece = np.searchsorted(first, begin, side="right") - 1
        a, b = starts[begin].tolist(), ends[begin + length + span - 2].tolist()
        packer.add(value, [text[i:j] for i, j in zip(a, b)], np.array(docs)[piece], np.array(marks)[piece], np.array(bases)[piece] + begin - first[piece])


def _pack(layout: packed.Layout, span: int, gram: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = packed.Packer(layout, hot)
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for batch in batches:
            for doc, text, mark in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("k2").to_pylist()):
                words = (text.as_py() or "").encode().split()
                if doc is None or len(words) < span:
                    continue
                for base, some in _pieces(words, span, packed.SCAN_BYTES // 16):
                    joined = b" ".join(some)
                    for kept, item in zip(held, (joined, len(some), doc, mark, base)):
                        kept.append(item)
                    size += len(joined)
                    if size >= packed.SCAN_BYTES:
                        _scan(*held, packer, span, gram)
                        held, size = ([], [], [], [], []), 0
                    if packer.full():
                        yield from packer.flush()
        if size:
            _scan(*held, packer, span, gram)
        yield from packer.flush()

    return run


def _later_copies(span: int):
    """For a bucket: the runs of words whose windows also start in a smaller document."""

    def work(blobs: list[bytes]) -> Iterator[dict]:
        strings, ids, docs, marks, places, hot = packed.gather(blobs)
        text = b"\n".join(strings)
        starts, ends, hashes = _word_hashes(text)
        words = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
        windows = words - span + 1
        first_word, offset = np.cumsum(words) - words, np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(strings)), windows)
        begin = np.arange(len(owner)) - offset[owner] + first_word[owner]
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, ids, docs)
        # Sort windows by hash; only those that have an equal can be repeats, and bytes decide.
        keys = packed.piece_hashes(hashes, begin, begin + span)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twin = np.zeros(len(order), bool)
        twin[1:] |= same
        twin[:-1] |= same
        repeats = order[twin]
        of_window = least[owner]
        if len(repeats):
            names: dict[bytes, int] = {}
            a, b = starts[begin[repeats]].tolist(), ends[begin[repeats] + span - 1].tolist()
            name = np.array([names.setdefault(text[i:j], len(names)) for i, j in zip(a, b)])
            smallest = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(smallest, name, of_window[repeats])
            of_window[repeats] = smallest[name]
        low, high = np.minimum.reduceat(of_window, offset), np.maximum.reduceat(of_window, offset)
        whole = docs > high[ids]
        yield {"k1": docs[whole], "k2": marks[whole], "start": places[whole], "length": windows[ids[whole]] + span - 1}
        some = np.flatnonzero(~whole & (docs > low[ids]))
        out: tuple[list, ...] = ([], [], [], [])
        for k in some.tolist():
            s, d = ids[k], docs[k]
            cut = np.diff((of_window[offset[s] : offset[s] + windows[s]] < d).astype(np.int8), prepend=0, append=0)
            on, off = np.flatnonzero(cut == 1), np.flatnonzero(cut == -1)
            out[0].extend([d] * len(on))
            out[1].extend([marks[k]] * len(on))
            out[2].extend((places[k] + on).tolist())
            out[3].extend((off - on + span - 1).tolist())
        yield dict(zip(("k1", "k2", "start", "length"), out))

        def runs_of(s: int) -> Iterator[tuple[int, int, int]]:
            """Runs of windows whose least document is one; it is a repeat in all greater ones."""
            mine = of_window[offset[s] : offset[s] + windows[s]]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            for k, n in zip(first.tolist(), np.diff(np.append(first, len(mine))).tolist()):
                yield k, n + span - 1, int(mine[k])

        yield packed.verdicts(strings, hot, runs_of)

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = ([], [], [], [])
        for text, ranges in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode().split()
            removed = 0
            if len(ranges.values or ()):
                pairs = ranges.values
                gone = packed.covered(len(words), pairs.field(0).to_numpy(), pairs.field(1).to_numpy())
                removed = int(gone.sum())
                kept = b" ".join(compress(words, (~gone).tolist()))
            else:
                kept = b" ".join(words)
            for column, item in zip(made, (len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode())):
                column.append(item)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string()), pa.array(made[3], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def _weigh(span: int, gram: int):
    """Bytes that some texts bring to each bucket."""

    def run(texts: list[bytes], layout: packed.Layout) -> np.ndarray:
        out = np.zeros(layout.buckets, np.int64)
        for text in texts:
            words = text.split()
            for _, some in _pieces(words, span, packed.SCAN_BYTES // 16) if len(words) >= span else ():
                _, _, hashes = _word_hashes(b" ".join(some))
                grams = packed.piece_hashes(hashes, np.arange(len(hashes) - gram + 1), np.arange(gram, len(hashes) + 1))
                size = sum(map(len, some)) // max(1, len(some)) + 1
                out += size * np.bincount(layout.bucket(packed.sliding_min(grams, span - gram + 1)), minlength=layout.buckets)
        return out

    return run


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = WINDOW_WORDS, gram: int = GRAM_WORDS, hot: int = packed.HOT_PLACES, crowded: int = packed.CROWDED_BYTES) -> DataFrame:
    """(k1, k2, start, length): runs of words to cut, which may overlap, of documents as ``packed.keyed`` names them."""
    ship(docs.sparkSession)
    source = packed.keyed(docs, id_col, text_col)
    gram = min(gram, span)
    layout = packed.plan_layout(source, _weigh(span, gram), crowded)
    rows = source.mapInArrow(lean(_pack(layout, span, gram, hot)), packed.PACKED_SCHEMA)
    return packed.ranges(rows, layout.buckets, _later_copies(span), "words")


def with_ranges(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, ranges) for each row of ``docs``; the ranges are the side that is held."""
    grouped = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "length")).alias("ranges"))
    return packed.keyed(docs, id_col, text_col).join(grouped.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", "ranges")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = WINDOW_WORDS, hot: int = packed.HOT_PLACES, crowded: int = packed.CROWDED_BYTES) -> DataFrame:
    """Cut each word that a window which also starts in a document of smaller id covers.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by
    one space). Words are runs of bytes other than ASCII white space, taken unchanged
    from the whole text; a null or empty text has none. Windows never cross documents
    and are judged on the input. Texts shorter than a window lose nothing. A row with a
    null id has no smaller and no greater id: it is neither searched nor cut. Rows that
    repeat an id do not cut each other, and each loses what its own text repeats.
    Further columns are ignored; no rows give no rows.
    """
    ranges = repeated_ranges(docs, id_col, text_col, span, hot=hot, crowded=crowded)
    return with_ranges(docs, ranges, id_col, text_col).mapInArrow(lean(_cut), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)
), firsts AS (
  SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE m < doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(w, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
