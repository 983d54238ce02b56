"""Nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are parted into shells of like length; in a shell, one more component brings
each to the shell's largest length, so that the largest inner product is the least
distance; queries are brought to that length too, which changes no order. A projection of PROJECTED dimensions keeps distances up to chance: the squared
projected length over the squared length is chi-square. A kd-tree over a sample of all
projected vectors cuts each shell into tiles, the units of work, and every vector goes to
its tile once. A query first searches the tiles that promise the greatest products. Those
found there say in which other tiles the stopping test is open: those whose
nearest point in projection is nearer than CONFIDENCE allows for a vector as near as the
worst found. The query is sent to these only, and searches each by a kd-tree of its own,
nearest leaves first, until the test holds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, lean, ship, stored

NEAREST = 20
#: Projected dimensions; even, so that the chi-square distribution has a closed form.
PROJECTED = 16
#: Chance that a vector as near as the worst one found would have been met by now.
CONFIDENCE = 0.93
LEAF = 64
#: Leaves taken from a tree at a time.
STEP_LEAVES = 4
#: Vectors of a tile on average, and queries searched in it together at most.
TILE_VECTORS = 1 << 14
TILE_QUERIES = 1 << 12
#: Vectors in the tiles that a query searches first, at least.
HOME_VECTORS = 1 << 10
#: Projected vectors that the global tree is built on, at most: those of least hash. Every vector is indexed.
SAMPLE = 1 << 17
#: Sampled vectors in a tile at least, which bounds the number of tiles.
SAMPLED_TILE = 32
#: A shell's least length over its largest; what is shorter than the last shell joins it.
SHELL, SHELLS = 0.9, 32
SEED = 7


def chi_square(x: float, m: int) -> float:
    """Distribution function of chi-square with an even number of degrees."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < p else (low, middle)
    return high


def projection(dims: int, seed: int = SEED) -> np.ndarray:
    """Entries of the 2-stable (normal) distribution: a squared projected length over the squared length is chi-square."""
    return np.random.default_rng(seed).standard_normal((dims, PROJECTED))


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The leaves of a kd-tree: numbers of points, split at the median of the widest side."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            leaves.append(part)
            continue
        some = points[part]
        axis = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
        half = len(part) // 2
        order = np.argpartition(some[:, axis], half)
        todo += [part[order[:half]], part[order[half:]]]
    return leaves


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on."""
    total = np.zeros(a.shape[:-1])
    for k in range(a.shape[-1]):
        total += a[..., k] * b[..., k]
    return total


def search(
    vectors: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, worst: np.ndarray, norm: float, k: int = NEAREST, confidence: float = CONFIDENCE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best of ``vectors`` found for each query, and how many it was compared with.

    ``vectors`` are distinct and ``ids`` has the ids of each; none is longer than
    ``norm``. ``worst`` is the product that a result must reach, for each query, as far as
    is known (minus infinity where it is not).
    """
    n, dims = vectors.shape
    lift = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    base = projection(dims + 1)
    places = np.column_stack((vectors, lift)) @ base
    leaves = kd_leaves(places)
    size = max(map(len, leaves))
    table = np.full((len(leaves), size), n)
    low, high = (np.empty((len(leaves), PROJECTED)) for _ in range(2))
    for i, part in enumerate(leaves):
        table[i, : len(part)] = part
        low[i], high[i] = places[part].min(axis=0), places[part].max(axis=0)
    padded, far = np.vstack((vectors, np.zeros(dims))), np.vstack((places, np.full(PROJECTED, np.inf)))
    limit = chi_square_quantile(confidence, PROJECTED)
    keep = k + 1
    found: tuple[list, list, list] = ([], [], [])
    compared = np.zeros(len(queries), np.int64)
    for at in range(0, len(queries), 128):
        mine = queries[at : at + 128]
        known = worst[at : at + 128]
        # Per unit of product: how much the squared distance falls, when the query has the length ``norm``.
        gain = 2 * norm / np.sqrt((mine * mine).sum(axis=1))
        spot = np.column_stack((mine * gain[:, None] / 2, np.zeros(len(mine)))) @ base
        bound = box_distances(spot, low, high)
        order = np.argsort(bound, axis=1, kind="stable")
        best = np.full((len(mine), keep), -np.inf)
        which = np.full((len(mine), keep), n)
        active = np.arange(len(mine))
        for step in range(0, len(leaves), STEP_LEAVES):
            # Squared distance of the worst result; nothing further in projection than ``open_`` is likely to be nearer.
            open_ = limit * np.maximum(2 * norm * norm - gain[active] * np.maximum(best[active, -1], known[active]), 0)
            going = bound[active, order[active, step]] <= open_
            active, open_ = active[going], open_[going]
            if not len(active):
                break
            rows = table[order[active, step : step + STEP_LEAVES]].reshape(len(active), -1)
            gap = far[rows] - spot[active, None, :]
            near = np.einsum("apd,apd->ap", gap, gap) <= open_[:, None]
            # Only what the test leaves open is compared in full.
            a, b = np.nonzero(near)
            score = np.full(rows.shape, -np.inf)
            score[a, b] = np.einsum("pd,pd->p", padded[rows[a, b]], mine[active[a]])
            compared[at + active] += near.sum(axis=1)
            score, rows = np.concatenate((best[active], score), axis=1), np.concatenate((which[active], np.where(near, rows, n)), axis=1)
            top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            score, rows = np.take_along_axis(score, top, axis=1), np.take_along_axis(rows, top, axis=1)
            sort = np.argsort(-score, axis=1)
            best[active], which[active] = np.take_along_axis(score, sort, axis=1), np.take_along_axis(rows, sort, axis=1)
        true = exact_products(padded[which], mine[:, None, :])
        for i in range(len(mine)):
            own = int(query_ids[at + i])
            held = [(-true[i, j], int(x)) for j in range(keep) if which[i, j] < n for x in ids[which[i, j]] if x != own]
            held.sort()
            for s, x in held[:k]:
                for column, item in zip(found, (own, x, -s)):
                    column.append(item)
    return np.array(found[0], np.int64), np.array(found[1], np.int64), np.array(found[2], np.float64), compared


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[:, d] - points[:, d : d + 1], points[:, d : d + 1] - high[:, d]), 0)
        out += gap * gap
    return out


class Tree:
    """A kd-tree over sampled projections of one shell, whose leaves are tiles."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        #: (axis, cut, below, above) of inner nodes; a leaf is its tile's number less the number of all tiles.
        self.nodes: list[list] = []
        self.tiles = 0
        self.root = self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        widths = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if len(points) <= leaf or not widths.max() > 0:
            self.tiles += 1
            return -self.tiles
        axis = int(np.argmax(widths))
        half = float(np.median(points[:, axis]))
        if not (points[:, axis] > half).any():
            half = float(np.nextafter(half, -np.inf))
        above, at = points[:, axis] > half, len(self.nodes)
        self.nodes.append([axis, half, 0, 0])
        self.nodes[at][2], self.nodes[at][3] = self._grow(points[~above], leaf), self._grow(points[above], leaf)
        return at

    def tile(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, half, below, above = self.nodes[node]
            up = points[rows, axis] > half
            todo += [(below, rows[~up]), (above, rows[up])]
        return out


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def nearest(table: DataFrame, queries: DataFrame | None = None, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found nearest of each query, by inner product.

    Queries are the rows of ``queries``, or those of ``table`` whose id is divisible by
    ``every``; candidates are all rows of ``table`` but those with the query's id. Score
    is the inner product in double precision; ties go to the smaller id. Rows whose id or
    vector is null, and vectors that are empty, zero, or hold null or non-finite
    components take no part; vectors are compared with those of their own length only.
    Rows that repeat an id and vector count once; of one vector only the k + 1 smallest
    ids can be among any k results, so no more are kept. No query: no rows.

    ``compared`` says with how many distinct vectors the query was compared in full.
    """
    ship(table.sparkSession)
    sound = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vector_col, lambda c: c != 0)

    def ready(rows: DataFrame) -> DataFrame:
        return (
            rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
            .select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .withColumn("dims", F.size("v"))
            .withColumn("h", F.xxhash64("v"))
        )

    base = ready(table)
    asked = cut((ready(queries) if queries is not None else base.filter(F.col("vec_id") % every == 0)).dropDuplicates(["vec_id", "h", "v"]))
    copies = Window.partitionBy("h", "v").orderBy("vec_id")
    some = cut(base.withColumn("at", F.dense_rank().over(copies)).filter(F.col("at") <= k + 1).dropDuplicates(["h", "v", "at"]).drop("at"))
    sized = some.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))
    # Vectors are compared with those of their own number of components only; shells are of one such number.
    longest = sized.groupBy("dims").agg(F.max("length").alias("norm"), F.count(F.lit(1)).alias("n"))
    norms = {r["dims"]: (r["norm"], r["n"]) for r in longest.collect()}
    if not norms:
        return some.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("compared"))
    index = Index(sized, norms)
    home = stored(index.search(asked.select("vec_id", "v", "dims", F.lit(float("-inf")).alias("worst")), k, None), "home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    worst = home.filter("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    again = asked.join(worst, asked["vec_id"] == worst["query_id"], "left").select("vec_id", "v", "dims", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
    both = home.unionByName(index.search(again, k, True))
    both = stored(both, "found")
    counts = both.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    ranked = both.filter("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.drop("compared").join(counts, "query_id").select("query_id", "rank", "vec_id", "score", "compared")


class Index:
    """Tiles of vectors: where each is, and the box of its projected vectors."""

    def __init__(self, sized: DataFrame, norms: dict[int, tuple[float, int]]) -> None:
        base = {d: projection(d + 1) for d in norms}
        total = sum(n for _, n in norms.values())
        top = {d: norm * (1 + 1e-12) for d, (norm, _) in norms.items()}

        def shell_of(length: np.ndarray, dims: int) -> np.ndarray:
            return np.clip(np.floor(np.log(np.maximum(length / top[dims], 1e-300)) / math.log(SHELL)), 0, SHELLS - 1).astype(np.int64)

        def projected(v: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
            length = np.sqrt((v * v).sum(axis=1))
            shell = shell_of(length, dims)
            most = top[dims] * SHELL**shell
            return shell, np.column_stack((v, np.sqrt(np.maximum(most * most - length * length, 0)))) @ base[dims]

        share = min(1.0, SAMPLE / total)
        bound = int((1 << 40) * min(1.0, 1.2 * share + 1e-9))
        place = F.pmod("h", F.lit(1 << 40))
        rows = sized.filter(place < bound).orderBy(place, "vec_id").limit(SAMPLE).select("v", "dims").toArrow()
        sampled: dict[tuple[int, int], np.ndarray] = {}
        for d in norms:
            mine = rows.filter(pa.compute.equal(rows.column("dims"), d))
            if mine.num_rows:
                shell, points = projected(_matrix(mine.column("v"), d), d)
                sampled |= {(d, int(s)): points[shell == s] for s in np.unique(shell)}
        leaf = max(SAMPLED_TILE, int(TILE_VECTORS * min(1.0, rows.num_rows / total)))
        trees = {key: Tree(points, leaf) for key, points in sampled.items()}
        # Shells that the sample missed are one tile each.
        every = [(d, s) for d in norms for s in range(SHELLS)]
        first: dict[tuple[int, int], int] = {}
        tiles = 0
        for key in every:
            first[key] = tiles
            tiles += trees[key].tiles if key in trees else 1

        def deal(batches):
            for batch in batches:
                dims_ = batch.column("dims").to_numpy()
                tile = np.zeros(batch.num_rows, np.int64)
                points = np.zeros((batch.num_rows, PROJECTED))
                for d in np.unique(dims_).tolist():
                    at = np.flatnonzero(dims_ == d)
                    shell, mine = projected(_matrix(batch.column("v").take(pa.array(at)), d), d)
                    points[at] = mine
                    for s in np.unique(shell).tolist():
                        here = shell == s
                        tile[at[here]] = first[d, s] + (trees[d, s].tile(mine[here]) if (d, s) in trees else 0)
                spots = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), PROJECTED).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("dims"), pa.array(tile), spots], names=["vec_id", "v", "dims", "tile", "spot"])

        dealt = sized.select("vec_id", "v", "dims").mapInArrow(lean(deal), "vec_id bigint, v array<double>, dims int, tile bigint, spot array<double>")
        self.vectors = stored(dealt, "tiles")
        edges = [f(F.col("spot")[d]).alias(f"{n}{d}") for n, f in (("low", F.min), ("high", F.max)) for d in range(PROJECTED)]
        # As many rows as there are tiles, which SAMPLE bounds.
        boxes = self.vectors.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), *edges).orderBy("tile").toArrow()
        self.tile, self.counts = boxes.column("tile").to_numpy(), boxes.column("n").to_numpy()
        self.low, self.high = (np.column_stack([boxes.column(f"{n}{d}").to_numpy() for d in range(PROJECTED)]) for n in ("low", "high"))
        keys = [key for key in every for _ in range(trees[key].tiles if key in trees else 1)]
        self.dims = np.array([keys[t][0] for t in self.tile.tolist()])
        self.norm = np.array([top[keys[t][0]] * SHELL ** keys[t][1] for t in self.tile.tolist()])
        self.base = base

    def route(self, rest: bool | None):
        """For queries: the tiles to search first, or all others in which the stopping test is open."""
        limit = chi_square_quantile(CONFIDENCE, PROJECTED)
        tile, low, high, dims_, norms, base, counts = self.tile, self.low, self.high, self.dims, self.norm, self.base, self.counts

        def run(batches):
            for batch in batches:
                out: tuple[list, list, list] = ([], [], [])
                of = batch.column("dims").to_numpy()
                for d in np.unique(of).tolist():
                    mine = np.flatnonzero(dims_ == d)
                    if d not in base or not len(mine):
                        continue
                    rows = np.flatnonzero(of == d)
                    v = _matrix(batch.column("v").take(pa.array(rows)), d)
                    worst = batch.column("worst").to_numpy()[rows]
                    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
                    spot = np.column_stack((unit, np.zeros(len(v)))) @ base[d]
                    bound = np.empty((len(v), len(mine)))
                    for norm in np.unique(norms[mine]).tolist():
                        here = norms[mine] == norm
                        bound[:, here] = box_distances(spot * norm, low[mine[here]], high[mine[here]])
                    length, reach = np.sqrt((v * v).sum(axis=1))[:, None], norms[mine][None, :]
                    # First the tiles whose nearest points promise the greatest products, until they hold enough vectors.
                    order = np.argsort(bound / (2 * PROJECTED * reach) - reach, axis=1, kind="stable")
                    many = np.cumsum(counts[mine][order], axis=1)
                    first_ = np.zeros(bound.shape, bool)
                    np.put_along_axis(first_, order, np.column_stack((np.zeros(len(v)), many[:, :-1])) < HOME_VECTORS, axis=1)
                    if rest is None:
                        a, b = np.nonzero(first_)
                    else:
                        a, b = np.nonzero(~first_ & (bound <= limit * np.maximum(2 * reach * reach - 2 * reach * worst[:, None] / length, 0)))
                    for column, items in zip(out, (rows[a], tile[mine[b]], norms[mine[b]])):
                        column.append(items)
                at = np.concatenate([np.zeros(0, np.int64), *out[0]])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(at)) for c in ("vec_id", "v", "worst")), pa.array(np.concatenate([np.zeros(0, np.int64), *out[1]])), pa.array(np.concatenate([np.zeros(0), *out[2]]))],
                    names=["query_id", "v", "worst", "tile", "norm"],
                )

        return run

    def search(self, asked: DataFrame, k: int, rest: bool | None) -> DataFrame:
        """(query_id, vec_id, score, compared): what each query finds in its tiles; a row without vec_id for each tile has the count."""
        routed = cut(asked.mapInArrow(lean(self.route(rest)), "query_id bigint, v array<double>, worst double, tile bigint, norm double"))
        chunks = routed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_QUERIES)).cast("int").alias("chunks"))
        chunks = cut(chunks)
        left = self.vectors.join(F.broadcast(chunks), "tile").select("vec_id", "v", "tile", F.explode(F.sequence(F.lit(1), F.col("chunks"))).alias("chunk"))
        right = routed.join(F.broadcast(chunks), "tile").withColumn("chunk", (F.pmod(F.xxhash64("query_id", "v"), F.col("chunks")) + 1).cast("int")).drop("chunks")

        def tile(vectors: pa.Table, asks: pa.Table) -> pa.Table:
            names = ["query_id", "vec_id", "score", "compared"]
            if not vectors.num_rows or not asks.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=names)
            dims = len(vectors.column("v")[0])
            points, numbers = _matrix(vectors.column("v"), dims), vectors.column("vec_id").to_numpy()
            distinct, inverse = np.unique(points, axis=0, return_inverse=True)
            order = np.argsort(inverse.ravel(), kind="stable")
            ids = np.split(numbers[order], np.cumsum(np.bincount(inverse.ravel()))[:-1])
            queries = asks.column("query_id").to_numpy()
            *found, compared = search(distinct, ids, _matrix(asks.column("v"), dims), queries, asks.column("worst").to_numpy(), asks.column("norm")[0].as_py(), k)
            n, m = len(found[0]), len(queries)
            columns = [np.concatenate((found[0], queries)), np.concatenate((found[1], np.zeros(m, np.int64))), np.concatenate((found[2], np.zeros(m))), np.concatenate((np.zeros(n, np.int64), compared))]
            blank = np.arange(n + m) >= n
            return pa.table([pa.array(columns[0]), pa.array(columns[1], mask=blank), pa.array(columns[2], mask=blank), pa.array(columns[3])], names=names)

        return left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(tile, "query_id bigint, vec_id bigint, score double, compared bigint")
