"""SimHash fingerprints and near-duplicate components by multi-index hashing."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines, packed
from .components import connected_components
from .storage import cut, lean, ship, stored

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Table entries above which a segment value is searched by whole-code balls instead.
DENSE_BUCKET = 64
_BLOCK = 1 << 15

#: Near-duplicates by similarity: words of a shingle, and the least Jaccard similarity of two texts' shingles.
SIMILAR_WORDS, MIN_SIMILARITY = 5, 0.8
#: Segments of the longer fingerprint and their bits. At a similarity of 0.8 a bit differs with probability
#: 0.15, so a segment agrees up to one bit with probability 0.13, and some segment does with 0.92; at 0.9, with 0.999.
SEGMENTS, SEGMENT_BITS = 18, 22
#: Bits of 64 further ones that may differ: 10 are to be expected at a similarity of 0.8, and 32 of unlike texts.
CODE_BITS = 20
#: Numbers of wanted texts that are broadcast at most, in bytes.
BROADCAST_BYTES = 32 << 20


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 (seed 42) of each word shingle of the whole text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash as a signed integer; 0 for a text without words."""
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), _BLOCK):
        block = values[at : at + _BLOCK]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): one row for each row of ``docs``, its fingerprint as a bigint."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    return source.mapInArrow(lean(run), "id bigint, fp bigint")


def fingerprint_links(codes: DataFrame, dense: int = DENSE_BUCKET) -> DataFrame:
    """(a, b): links that join every two distinct codes within distance 2 into one component.

    ``codes`` has a distinct bigint column ``fp``. Multi-index hashing with two
    32-bit segments: two codes within distance 2 differ by at most one bit in the
    high segment, or agree in the low one. So each code is in two tables, under its
    segment values, and probes the high table with its value's Hamming ball of
    radius 1 and the low table with its own value; matches are verified on all 64
    bits. Of two codes that differ in a high bit, the one where it is 0 probes.

    A segment value held by more than ``dense`` codes is left out of that join,
    since its candidates would grow with the square of the bucket. The codes that
    meet there are linked exactly by whole-code balls instead: two codes are within
    distance 2 if and only if some code lies within 1 of both, and at most 65
    codes lie within 1 of a code, so those groups are bounded.
    """
    high, low = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L)"
    table = codes.select("fp", F.expr(f"explode(array({high}, {low} | 4294967296L)) AS key"))
    ball = (
        f"filter(transform(sequence(0, 31), i -> IF(({high} & shiftleft(1L, i)) = 0, {high} | shiftleft(1L, i), NULL)), k -> k IS NOT NULL)"
    )
    probes = codes.select("fp", F.expr(f"explode(concat(array({high}, {low} | 4294967296L), {ball})) AS key"))
    full = cut(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > dense).select("key"))
    crowded = not full.isEmpty()
    fetch = table.join(full, "key", "left_anti") if crowded else table
    links = (
        probes.withColumnRenamed("fp", "a")
        .join(fetch.withColumnRenamed("fp", "b"), "key")
        .filter("bit_count(a ^ b) BETWEEN 1 AND 2")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    if crowded:
        meeting = table.join(full, "key", "left_semi").select("fp").unionByName(probes.join(full, "key", "left_semi").select("fp")).distinct()
        points = meeting.select("fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) AS point"))
        links = links.unionByName(
            points.groupBy("point")
            .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("around"))
            .filter("size(around) > 1")
            .select("a", F.explode("around").alias("b"))
            .filter("a <> b")
        )
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space, and
    shingles of fewer words than ``width`` are the whole sequence. Null, empty and
    blank texts have fingerprint 0 and are linked like any other. ``component_id`` is
    the smallest id reachable over links of distance 2 or less; null ids are never the
    smallest unless all of a component's ids are null. Repeated rows and ids come out
    as often as they went in; further columns are ignored. No rows: no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    codes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    labels = connected_components(fingerprint_links(codes.select("fp")))
    joined = labels.join(codes, labels["node"] == codes["fp"]).select("node", "label", "least")
    found = joined.join(joined.groupBy("label").agg(F.min("least").alias("component")), "label").select(F.col("node").alias("fp"), "component")
    # Stored, so that both sides of the last join are dealt anew and a code of many copies can be split.
    of_code = stored(codes.join(found, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "components")
    return prints.join(of_code, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def long_fingerprint(hashes: np.ndarray, segments: int = SEGMENTS, bits: int = SEGMENT_BITS) -> tuple[int, list[int]]:
    """A 64-bit SimHash of distinct shingle hashes, and the segments of a longer one, each with its number above its bits."""
    words = 1 + -(-segments * bits // 64)
    salts = packed.mix64(np.arange(1, words + 1, dtype=np.uint64))
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        block = packed.mix64(hashes[at : at + 4096, None] ^ salts[None, :])
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    on = 2 * counts > len(hashes)
    parts = on[64 : 64 + segments * bits].reshape(segments, bits) @ (1 << np.arange(bits))
    return int(np.packbits(on[:64], bitorder="little").view("<i8")[0]), [(k << bits) | int(x) for k, x in enumerate(parts)]


def distinct_shingles(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _segment_links(nodes: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): nodes (node, code, size, segments) that agree in a segment up to one bit and in their codes up to CODE_BITS; and crowded rows.

    Each node is in a table for each segment and probes it with the ball of radius 1; of
    two values that differ in a bit, the one where it is 0 probes. A value that more than
    ``dense`` nodes have would bring pairs that grow with its square: there all meet the
    least node, and the rows (triple, form, fp, size, holder) of the value are handed on,
    for ``_crowd_links`` to compare the others.
    """
    ball = f"filter(transform(sequence(0, {SEGMENT_BITS - 1}), i -> IF((s & shiftleft(1L, i)) = 0, s | shiftleft(1L, i), NULL)), k -> k IS NOT NULL)"
    table = nodes.select("node", "code", "size", F.explode("segments").alias("key"))
    probes = nodes.select("node", "code", "size", F.expr(f"explode(flatten(transform(segments, s -> concat(array(s), {ball})))) AS key"))
    full = cut(table.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "code")).alias("lead")).filter(F.col("n") > dense).select("key", "lead"))
    crowded = not full.isEmpty()
    fetch = table.join(full.select("key"), "key", "left_anti") if crowded else table
    near = f"bit_count(code_a ^ code_b) <= {CODE_BITS} AND a <> b"
    side = lambda df, s: df.select("key", F.col("node").alias(s), F.col("code").alias(f"code_{s}"))
    links = side(probes, "a").join(side(fetch, "b"), "key").filter(near).select("a", "b")
    others = nodes.select("node", "code", "size", F.expr(f"explode(flatten(transform(segments, s -> {ball}))) AS key"))
    held = table.withColumn("holder", F.lit(True)).unionByName(others.withColumn("holder", F.lit(False))).join(full, "key")
    if crowded:
        led = held.select(F.col("node").alias("a"), F.col("code").alias("code_a"), F.col("lead.node").alias("b"), F.col("lead.code").alias("code_b"))
        links = links.unionByName(led.filter(near).select("a", "b"))
    crowd = held.select(F.col("key").alias("triple"), F.col("node").alias("form"), F.col("code").alias("fp"), "size", "holder")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), crowd


def _open_pairs(table: pa.Table, labels: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of rows sorted by key and size, one of them at least a holder of the key, that are not of one label."""
    holder = table.column("holder").to_numpy(zero_copy_only=False)
    keys, codes, sizes, parts = (table.column(c).to_numpy() for c in ("key", "fp", "size", "part"))
    for x, y, gap in lines._candidates(keys, codes, sizes, parts, least, CODE_BITS):
        good = (holder[x] | holder[y]) & (labels[x] != labels[y])
        yield x[good], y[good], gap[good]


OPEN = "triple bigint, form bigint, fp bigint, size int, holder boolean, label bigint"


def _crowd_links(crowd: DataFrame, least: float, sets_of: Callable[[DataFrame], DataFrame], block: int = lines.BLOCK, full_block: int = lines.TEXT_BLOCK) -> DataFrame:
    """(a, b): links that join all similar nodes that meet under a crowded value, of rows (triple, form, fp, size, holder, label).

    Those of one label are joined already. Of a value with many rows, each two blocks
    meet. Rows with something left to compare get their shingles and are compared where
    they meet, so that no pairs are written down.
    """
    names = [x.split()[0] for x in OPEN.split(", ")]

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in lines._whole_keys(batches, 1 << 18):
            has = np.zeros(table.num_rows, bool)
            for x, y, _ in _open_pairs(table, table.column("label").to_numpy(), least):
                has[x] = has[y] = True
            if has.any():
                yield from table.select(names).filter(pa.array(has)).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in lines._whole_keys(batches, 1 << 13):
            sets = [np.frombuffer(v.as_py(), np.uint64) for v in table.column("shingles")]
            forms = table.column("form").to_numpy()
            names_, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
            root, some, n, made = np.arange(len(names_)), [], 0, []

            def judge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.fromiter((_alike(sets[i], sets[j], least) for i, j in zip(x.tolist(), y.tolist())), bool, len(x))

            for more in itertools.chain(_open_pairs(table, label, least), (None,)):
                if more is not None:
                    some.append(more)
                    n += len(more[0])
                if n and (more is None or n >= lines.PENDING):
                    root, links = lines.joined(*(np.concatenate(c) for c in zip(*some)), label, root, judge)
                    made += links
                    some, n = [], 0
            if made:
                x, y = (forms[list(c)] for c in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = lines._sorted(lines.in_blocks(crowd, block, 1 << 62))
    still = stored(rows.mapInArrow(lean(left), OPEN).distinct(), "open")
    sets = sets_of(still.select(F.col("form").alias("node")).distinct()).withColumnRenamed("node", "form")
    # A shingle is eight bytes.
    dealt = lines._sorted(lines.in_blocks(still, full_block, lines.BLOCK_CHARS // 8).join(sets, "form"))
    return dealt.mapInArrow(lean(link), "a bigint, b bigint")


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WORDS, least: float = MIN_SIMILARITY, dense: int = DENSE_BUCKET) -> DataFrame:
    """(k1, k2): one document of each near-duplicate group, under the numbers that ``packed.keyed`` gives it.

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or
    more are linked, if some segment of their longer SimHash agrees up to one bit and
    CODE_BITS of 64 further bits differ at most, however many share the segment; every
    link is verified on the shingles themselves. Texts with equal sets, texts without a
    word among them, are one. Of each connected group the document of smallest id stays,
    rows without an id last, then that of least text hash. No rows: no rows.
    """
    ship(docs.sparkSession)
    source = packed.keyed(docs, id_col, text_col)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_shingles(t.as_py(), width) for t in batch.column("text")]
            made = [long_fingerprint(x) for x in found]
            nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            columns = [pa.array(nodes), pa.array([c for c, _ in made], pa.int64()), pa.array([*map(len, found)], pa.int32()), pa.array([x for _, x in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "k1", "k2")), *columns], names=["id", "k1", "k2", "node", "code", "size", "segments"])

    rows = source.mapInArrow(lean(prints), "id bigint, k1 bigint, k2 bigint, node bigint, code bigint, size int, segments array<bigint>")
    lead = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "k2", "k1")).alias("lead")
    nodes = stored(rows.groupBy("node").agg(lead, *(F.first(c).alias(c) for c in ("code", "size", "segments"))), "nodes")
    pairs, crowd = _segment_links(nodes, dense)
    pairs, crowd = cut(pairs), stored(crowd, "crowd")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_shingles(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = cut(wanted.join(nodes, "node").select("node", "lead.k1", "lead.k2"))
        if wanted.count() * 24 <= BROADCAST_BYTES:
            wanted = F.broadcast(wanted)
        # Equal rows have equal shingles; one of them is enough.
        return stored(source.join(wanted, ["k1", "k2"]).select("node", "text").mapInArrow(lean(shingles), "node bigint, shingles binary").dropDuplicates(["node"]), "shingles")

    sets = sets_of(wanted)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                good.append(_alike(*(np.frombuffer(v.as_py(), np.uint64) for v in (x, y)), least))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    linked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(lean(verify), "a bigint, b bigint")
    labels = connected_components(cut(linked))
    if not crowd.isEmpty():
        known = crowd.join(labels.withColumnRenamed("node", "form"), "form", "left").withColumn("label", F.coalesce("label", "form"))
        more = cut(_crowd_links(known, least, sets_of))
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    grouped = nodes.select("node", "lead").join(labels, "node", "left")
    return grouped.groupBy(F.coalesce("label", "node").alias("group")).agg(F.min("lead").alias("lead")).select("lead.k1", "lead.k2")
