"""Near-duplicates of embeddings by an inverted multi-index.

Unit vectors are turned at random and cut in halves, each with a codebook of its own; a
vector's home is the cell of the product grid that its two nearest codewords name. A
multi-sequence traversal visits cells from the likeliest on and stops when a vector at the
least cosine allowed lies in what was visited with the target probability: a difference of
known length points, after the random turn, in any direction alike, so the chance that it
crosses the border to another codeword is a normal tail of the border's distance. Of the
cells visited, a vector is sent to those after its home, so two vectors meet once. Where
they meet, full cosines decide.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import lean, ship, stored

LEAST = 0.98
#: Probability that the traversal reaches the home of a vector at the least cosine.
TARGET = 0.999
#: Vectors of a cell of the grid on average, and codewords of a half at most.
CELL, CODEWORDS = 128, 1024
#: Vectors that codebooks are fitted on, those of least hash: so many, and so many bytes, at most. Every vector is indexed.
SAMPLE, SAMPLE_BYTES = 1 << 14, 1 << 26
#: Vectors of a cell that are compared in one task, and their bytes; larger cells are compared in blocks of so many.
BLOCK, BLOCK_BYTES = 4096, 1 << 24
#: Dimensions below which borders are tested exactly, since a difference has few directions to point in.
FEW = 16
#: Crowded cells that are broadcast at most; beyond, their number of blocks is joined by a shuffle.
CROWDED = 100_000
SEED = 11

#: Upper tail of the normal distribution at 0, 0.001, ... 9.
_AT = np.linspace(0, 9, 9001)
_TAIL = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in _AT.tolist()])


def units(values: np.ndarray) -> np.ndarray:
    """Rows brought to length 1, whatever their size."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def turned(vectors: np.ndarray, width: int) -> np.ndarray:
    """``vectors``, filled up to ``width`` (a power of two), after a random turn: signs and Hadamard transforms, twice."""
    out = np.zeros((len(vectors), width))
    out[:, : vectors.shape[1]] = vectors
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (2, width))
    for sign in signs:
        out *= sign
        step = 1
        while step < width:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(out), width)
            step *= 2
        out /= math.sqrt(width)
    return out


def codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means, from points drawn with a fixed seed; a codeword that gets no point stays where it is."""
    words = points[np.random.default_rng(SEED).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        nearest = np.argmin(gaps(points, words), axis=1)
        many = np.bincount(nearest, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, points)
        words[many > 0] = sums[many > 0] / many[many > 0, None]
    return words


def gaps(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of points from codewords."""
    return (points * points).sum(axis=1)[:, None] - 2 * points @ words.T + (words * words).sum(axis=1)[None, :]


def multi_sequence(first: np.ndarray, second: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Pairs (i, j) by falling first[i] * second[j], until the products left out sum to at most 1 - ``enough``.

    Both arrays fall; pairs come from a heap that holds only the border of what was visited.
    """
    left = float(first.sum() * second.sum())
    heap, seen, out = [(-float(first[0] * second[0]), 0, 0)], {(0, 0)}, []
    while heap and (left > 1 - enough or not out):
        chance, i, j = heapq.heappop(heap)
        left += chance
        out.append((i, j))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(first) and b < len(second) and (a, b) not in seen and first[a] * second[b] > 0:
                seen.add((a, b))
                heapq.heappush(heap, (-float(first[a] * second[b]), a, b))
    return out


class Grid:
    """Two codebooks over the halves of turned unit vectors."""

    def __init__(self, sample: np.ndarray, words: int, least: float, target: float) -> None:
        self.width = sample.shape[1]
        self.half = self.width // 2
        self.books = [codebook(part, words) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.reach = math.sqrt(max(0.0, 2 - 2 * least))
        self.target = target

    def chances(self, points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codewords of each point by falling chance that a near-duplicate is theirs, and the chances; the first is the point's own."""
        squared = gaps(points, words)
        own = np.argmin(squared, axis=1)
        apart = np.sqrt(np.maximum(gaps(words, words), 0))[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            border = (squared - squared[np.arange(len(points)), own, None]) / (2 * apart)
        border[apart == 0] = 0
        if self.width < FEW:
            chance = (border <= self.reach).astype(float)
        else:
            chance = np.interp(border * math.sqrt(self.width) / max(self.reach, 1e-12), _AT, _TAIL, right=0.0)
        chance[np.arange(len(points)), own] = 2.0  # before all others
        order = np.argsort(-chance, axis=1, kind="stable")
        chance = np.take_along_axis(chance, order, axis=1)
        chance[:, 0] = 1.0
        return order, chance

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home) of turned unit vectors: the home of each, and the later cells that its traversal visits."""
        (order1, chance1), (order2, chance2) = (self.chances(part, words) for part, words in zip((points[:, : self.half], points[:, self.half :]), self.books))
        many = len(self.books[1])
        home = order1[:, 0].astype(np.int64) * many + order2[:, 0]
        rows, found = [np.arange(len(points))], [home]
        for r in np.flatnonzero(chance1.sum(axis=1) * chance2.sum(axis=1) > 2 - self.target).tolist():
            visited = np.array(multi_sequence(chance1[r], chance2[r], self.target))
            cells = order1[r][visited[:, 0]].astype(np.int64) * many + order2[r][visited[:, 1]]
            cells = cells[cells > home[r]]
            rows.append(np.full(len(cells), r))
            found.append(cells)
        first = len(points)
        rows, found = np.concatenate(rows), np.concatenate(found)
        return rows, found, np.arange(len(rows)) < first


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def links(units_: np.ndarray, weight: np.ndarray, meetings: list[tuple[np.ndarray, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the weight of the rows that it links to, and the first row that links reach from it.

    ``meetings`` are pairs of row lists to compare; of a list with itself, each pair counts once.
    """
    n = len(units_)
    total, root = np.zeros(n), np.arange(n)
    for a, b in meetings:
        for at in range(0, len(a), 256):
            mine = a[at : at + 256]
            hit = units_[mine] @ units_[b].T >= least
            if a is b:
                hit &= np.arange(len(b))[None, :] > np.arange(at, at + len(mine))[:, None]
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            total[mine] += hit @ weight[b]
            total[b] += weight[mine] @ hit
            for r in some.tolist():
                roots = np.unique(root[b[hit[r]]])
                roots = np.unique(np.append(roots, root[mine[r]]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
    return total.astype(np.int64), root


def is_sound(vector: str) -> Column:
    """Neither null, empty nor zero, and every component finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def near_links(vectors: DataFrame, least: float = LEAST, target: float = TARGET) -> DataFrame:
    """(node, links, root): what each node of ``vectors`` (node, label, v, many) links to.

    ``vectors`` are sound, distinct within their label, and stand for ``many`` rows each.
    Nodes link if label and length are equal and their cosine is ``least`` or more. A node
    with a link has one row or more: ``links`` sums to the rows that it links to, and links
    lead to ``root``, another node or itself. A cell of over BLOCK vectors is compared block
    by block, so nothing is left out and no task holds more than two blocks; no pair is
    written down.
    """
    spark = vectors.sparkSession
    ship(spark)
    shape = vectors.agg(F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    dims, n = shape["dims"] or 1, shape["n"]
    width = 1 << max(1, (dims - 1).bit_length())
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    place = F.pmod(F.xxhash64("v", "label"), F.lit(1 << 40))
    near = vectors.filter(place < int((1 << 40) * min(1.0, 1.2 * most / max(1, n) + 1e-9)))
    drawn = near.orderBy(place, "node").limit(most).select("v").toArrow().column("v").to_pylist()
    sample = np.zeros((max(1, len(drawn)), dims))
    for i, v in enumerate(drawn):
        sample[i, : len(v)] = units(np.array([v], np.float64))[0]
    grid = Grid(turned(sample, width), max(1, min(math.ceil(math.sqrt(n / CELL)), len(sample) // 8, CODEWORDS)), least, target)
    kind = vectors.schema["label"].dataType.simpleString()
    value = vectors.schema["v"].dataType.simpleString()

    def deal(batches):
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                rows, cells, home = grid.cells(turned(units(_matrix(part.column("v"), d)), width))
                part = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), d), pa.int32()), pa.array(cells, pa.int64()), pa.array(home)], names=[*part.schema.names, "dims", "cell", "home"])

    dealt = vectors.select("node", "label", "v", "many").mapInArrow(lean(deal), f"node bigint, label {kind}, v {value}, many bigint, dims int, cell bigint, home boolean")
    dealt = stored(dealt, "grid")
    key = ["label", "dims", "cell"]
    block = F.greatest(F.lit(256), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dims")))))
    crowded = dealt.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
    crowded = stored(crowded, "crowded")
    many = crowded.count()
    if many:
        dealt = dealt.join(F.broadcast(crowded) if many <= CROWDED else crowded, key, "left")
    else:
        dealt = dealt.withColumn("blocks", F.lit(None).cast("int"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def compare(table: pa.Table) -> pa.Table:
        node, weight, home, own, low, high = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("node", "many", "home", "own", "low", "high"))
        vectors_ = units(_matrix(table.column("v"), table.column("dims")[0].as_py()))
        if low[0] == high[0]:
            at_home, guests = np.flatnonzero(home), np.flatnonzero(~home)
            meetings = [(at_home, at_home), (at_home, guests)]
        else:
            (h0, g0), (h1, g1) = ((np.flatnonzero(home & (own == side)), np.flatnonzero(~home & (own == side))) for side in (low[0], high[0]))
            meetings = [(h0, np.concatenate((h1, g1))), (h1, g0)]
        total, root = links(vectors_, weight.astype(np.float64), meetings, least)
        found = np.flatnonzero(total)
        return pa.table([pa.array(node[found], pa.int64()), pa.array(total[found]), pa.array(node[root[found]], pa.int64())], names=["node", "links", "root"])

    return dealt.drop("other", "blocks").groupBy(*key, "low", "high").applyInArrow(compare, "node bigint, links bigint, root bigint")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table``.

    Rows link if their labels are equal and not null, their vectors of one length, and the
    cosine ``least`` or more in double precision. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id that links reach, itself included, and
    ``kept`` says whether it is the row's own. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, nor do rows without a label. Rows
    without an id link like others but are never the smallest; without any id in their
    component they are kept. Rows that repeat an id are different rows. Equal vectors of a
    label are one class, compared once and counted as often as they occur. No rows: no rows.
    """
    of = table.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if of in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("v"))
    sound = is_sound("v") & F.col("label").isNotNull()
    keys = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit("second"), "label", "v").alias("k2")]
    classes = rows.filter(sound).groupBy("label", "v").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least_id"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), *keys, "*"), "classes")
    found = stored(near_links(classes, least, target), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found, "node", "root")
    members = classes.select("node", "k1", "k2", "many", "least_id").join(counts, "node", "left").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = members.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = members.join(smallest, "label").select("k1", "k2", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.filter(sound).select("vec_id", *keys).join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


LINKS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), s AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reached AS (
  SELECT a, b FROM l UNION SELECT reached.a, l.b FROM reached JOIN l ON reached.b = l.a
), c AS (
  SELECT a AS r, min(vec_id) AS least FROM reached JOIN v ON v.r = reached.b GROUP BY a
), n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, c.least) AS component_id,
       vec_id IS NOT DISTINCT FROM least(vec_id, c.least) AS kept
FROM v LEFT JOIN c ON v.r = c.r LEFT JOIN n ON v.r = n.r
"""
