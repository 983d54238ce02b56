"""Quality rules: plain text rules, and tokeniser fertility against bands per language."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, lean, ship, stored

MIN_WORDS = 50
#: Percent of words inside repeated three-word windows above which a text fails.
MAX_REPEATED = 50
SYMBOLS = b"#*$%&|<>"
#: Tokens measured together for entropy, so that long texts compare with short ones.
ENTROPY_BLOCK = 128
CACHE_ENTRIES = 150_000

#: Rejection bands: quartiles widened by WHISKER times their distance, and by what short
#: texts stray: this over the root of their number of tokens.
WHISKER = 1.5
STRAY = {"chars_per_token": 6.0, "byte_share": 0.5, "token_entropy": 0.55}
#: Byte fallback is often zero throughout, so its band has a least width.
LEAST_BYTES = 0.02
#: Histogram steps of the measures; quartiles are exact to a step.
STEP = {"chars_per_token": 0.01, "byte_share": 0.001, "token_entropy": 0.002}
#: Groups with fewer distinct measured texts have no bands.
LEAST_GROUP = 30
#: Groups whose bands are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 10_000


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in ``width``-word windows that the text has twice or more, first ones included."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    key, base = ids[: n - width + 1], len(known)
    for k in range(1, width):
        if key.max() >= (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[k : n - width + 1 + k]
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twin = np.zeros(len(key), bool)
    twin[1:] |= same
    twin[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    at = order[twin]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_counts(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    data = text.encode()
    words = data.split()
    spaces = len(data) - sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return words, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


class Fertility:
    """Tokens of a public vocabulary with byte fallback, word by word."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        owner = self

        class Codes(dict):
            def __missing__(self, word: bytes) -> bytes:
                codes = np.array(owner.model.encode(word.decode()), "<u4").tobytes()
                if len(word) <= 64:
                    if len(self) >= CACHE_ENTRIES:
                        self.clear()
                    self[word] = codes
                return codes

        self.codes = Codes()

    def measure(self, words: list[bytes], word_chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of byte tokens, token entropy from 0 to 1."""
        ids = np.frombuffer(b"".join(map(self.codes.__getitem__, words)), "<u4")
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0
        return n, word_chars / n, float(self.fallback[ids].mean()), block_entropy(ids)


def block_entropy(ids: np.ndarray, block: int = ENTROPY_BLOCK) -> float:
    """Mean entropy of blocks of tokens over its largest value; the last block ends with the text."""
    n = len(ids)
    size = min(n, block)
    if size < 2:
        return 0.0
    rows = [ids[: n // size * size].reshape(-1, size)]
    if n % size:
        rows.append(ids[-size:].reshape(1, size))
    table = np.sort(np.concatenate(rows), axis=1)
    new = np.ones(table.shape, bool)
    new[:, 1:] = table[:, 1:] != table[:, :-1]
    counts = np.diff(np.append(np.flatnonzero(new.ravel()), table.size))
    return float(1 - (counts * np.log2(counts)).sum() / table.size / np.log2(size))


def script_of(text: str) -> str:
    """The script that most letters of a text are in, by their names; ``none`` without letters."""
    found: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[unicodedata.name(c, "NONE").split()[0]] += n
    return max(found, key=lambda k: (found[k], k)).lower() if found else "none"


@lru_cache(maxsize=1)
def _fertility(path: str) -> Fertility:
    return Fertility(path)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


MEASURES = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "band_group string, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, text_hash1 bigint, text_hash2 bigint"
)


def text_hashes(text: str, lang: str) -> list[Column]:
    """128 bits of a text and its language as two bigints, text_hash1 and text_hash2."""
    return [F.xxhash64(F.lit(k), F.coalesce(F.col(lang), F.lit("\0")), F.col(text)).alias(f"text_hash{k}") for k in (1, 2)]


def measures(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row of counts and fertility measures for each row of ``docs``, with hashes of its text and language.

    Null and empty texts have no words and no tokens, and all their measures are zero.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    source = source.select("*", *text_hashes("text", "lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fertility(path)
        for batch in batches:
            made: list[tuple] = []
            for text, lang in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                words, *counts = base_counts(text)
                group = f"lang:{lang}" if lang is not None else f"script:{script_of(text)}"
                made.append((len(words), *counts, group, *model.measure(words, counts[0])))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.float64()] * 3
            columns = zip(*made) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds)), batch.column(3), batch.column(4)], names=[x.split()[0] for x in MEASURES.split(", ")]
            )

    return source.mapInArrow(lean(run), MEASURES)


def bands(measured: DataFrame, group: str = "band_group") -> DataFrame:
    """(band_group, total, <measure>_low, <measure>_high): one row per group.

    From the distinct texts that pass the base rules: copies of one text count once, or
    many of them would draw the quartiles together. Measures are counted in steps, so that
    a group needs no more room than it has steps, however many texts it holds.
    """
    distinct = measured.filter(~F.col("base_failed")).groupBy(group, "text_hash1", "text_hash2").agg(*[F.min(c).alias(c) for c in STEP])
    bins = [F.struct(F.lit(name).alias("measure"), F.round(F.col(name) / step).cast("bigint").alias("bin")) for name, step in STEP.items()]
    counted = cut(distinct.select(group, F.inline(F.array(*bins))).groupBy(group, "measure", "bin").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(group, "measure")
    running = counted.select(group, "measure", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))
    low = F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin")))
    high = F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin")))
    quartiles = running.groupBy(group, "measure").agg(low.alias("q1"), high.alias("q3"), F.max("total").alias("total"))
    limits = [F.max("total").alias("total")]
    for name, step in STEP.items():
        q1, q3 = (F.max(F.when(F.col("measure") == name, F.col(c))) * F.lit(step) for c in ("q1", "q3"))
        limits += [(q1 - F.lit(WHISKER) * (q3 - q1)).alias(f"{name}_low"), (q3 + F.lit(WHISKER) * (q3 - q1)).alias(f"{name}_high")]
    return quartiles.groupBy(group).agg(*limits)


def settled(limits: DataFrame) -> DataFrame:
    """The bands of the groups large enough to have some."""
    return limits.filter(F.col("total") >= LEAST_GROUP).drop("total")


def rules(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, measures and verdict of each row of ``docs``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated three-word
    windows. Of the others, a text is kept if it lies within the bands of its language
    (its main script, where ``lang`` is null or missing): characters per token on both
    sides, the share of byte-fallback tokens above, token entropy below. Bands are
    widened for short texts, whose measures stray, and computed over all distinct texts given that pass the base rules. In groups
    of fewer than LEAST_GROUP such texts, which the measures of other languages say nothing about, all of them are kept. Null texts have no words and fail.
    Repeated rows and null ids come out as they went in. No rows: no rows.
    """
    measured = measures(docs, path, id_col, text_col, lang_col).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    )
    measured = stored(measured, "quality")
    limits = cut(settled(bands(measured)))
    # Languages are few and hold most rows each, so dealing rows by language is avoided where that is checked.
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    judged = measured.join(limits, "band_group", "left")
    limit = F.col
    stray = lambda c: F.lit(STRAY[c]) / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
    below = lambda c: F.col(c) < limit(f"{c}_low") - stray(c)
    above = lambda c: F.col(c) > limit(f"{c}_high") + stray(c)
    bad = (
        below("chars_per_token")
        | above("chars_per_token")
        | (F.col("byte_share") > limit("byte_share_high") + stray("byte_share") + LEAST_BYTES)
        | below("token_entropy")
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).alias("kept"),
        "band_group", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "text_hash1", "text_hash2",
    )
