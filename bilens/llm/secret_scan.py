"""Secret scans: known forms, and random strings that a vocabulary cannot compress."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, ship

#: Fixed forms of secrets, in the order of their kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Runs that may be random: of the letters that keys are written in. Plain words come as long as the shorter
#: ones, so under PLAIN_LENGTH a run must have a digit or a capital within a word.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PLAIN_LENGTH = 20
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
#: Known digests and identifiers: hexadecimal digests, UUIDs, plain numbers, times.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_+/=-]+|(?:sha|md)[0-9]+-[A-Za-z0-9+/=]+"
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2,6}Z?)"
)
#: Runs of letters and separators: paths and identifiers, if their parts read as words.
LETTERS = re.compile(r"[A-Za-z/_=+-]+")
SEPARATORS = re.compile(r"[/_=+-]+")
#: Parts of fewer letters on average are a list of letters, not a key.
PART_LETTERS = 3
#: Characters per token below which a run counts as random.
MAX_CHARS_PER_TOKEN = 2.2


@lru_cache(maxsize=1)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed forms, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def is_random(run: str, encoding, most: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Whether a run has few characters per token and is no known digest or identifier; one of letters only is judged by its parts too."""
    if KNOWN.fullmatch(run) or len(run) < PLAIN_LENGTH and not MIXED.search(run):
        return False
    if len(run) / len(encoding.encode_ordinary(run)) >= most:
        return False
    if not LETTERS.fullmatch(run):
        return True
    parts = [x for x in SEPARATORS.split(run) if x]
    letters = sum(map(len, parts))
    return letters >= PART_LETTERS * len(parts) and letters / sum(len(encoding.encode_ordinary(x)) for x in parts) < most


def random_spans(text: str, base: list[tuple[int, int, int]], encoding, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Runs outside ``base`` with few characters per token, known digests and identifiers left out."""
    busy: list[list[int]] = []
    for a, _, b in sorted(base):
        if busy and a <= busy[-1][1]:
            busy[-1][1] = max(busy[-1][1], b)
        else:
            busy.append([a, b])
    out, k = [], 0
    # Both lists are in order, so one walk finds what overlaps.
    for m in CANDIDATE.finditer(text):
        while k < len(busy) and busy[k][1] <= m.start():
            k += 1
        if (k == len(busy) or busy[k][0] >= m.end()) and is_random(m.group(), encoding, most):
            out.append((m.start(), 3, m.end()))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def scan(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of each row of ``docs``.

    Spans are kind:start:end in code points of the whole text, the end exclusive, by
    start and then kind, joined by commas; ``base_sha256`` is the digest of those of the
    fixed forms alone. Null and empty texts have none. Repeated rows and null ids come
    out as they went in; further columns are ignored. No rows: no rows.
    """
    ship(docs.sparkSession)
    own_path, own_pattern = vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own_path, pattern or own_pattern
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            made: list[tuple] = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base, encoding)
                kinds = [k for _, k, _ in base]
                made.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = zip(*made) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=[x.split()[0] for x in schema.split(", ")]
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lean(run), schema)
