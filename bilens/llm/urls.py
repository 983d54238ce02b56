"""URL filters: host and path rules, and gradient-boosted trees on lexical features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut, lean, ship

#: (rule, verdict): a host with its subdomains, and the path's beginning.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled URLs that the trees are fitted on, at most: those of least hash.
SAMPLE = 20_000
#: Suffixes whose statistics are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_SUFFIXES = 10_000
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "longest_label", "digit_ratio", "path_digits",
    "hyphens", "host_entropy", "path_entropy", "params", "fragment", "secure", "suffix_rate", "suffix_seen",
)


def host_of(url: Column) -> Column:
    """After the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased, empty if there is none."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def ruled(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """(url, block): the rows of ``pages`` that some rule judges, as labelled URLs."""
    url = F.col(url_col).cast("string")
    _, verdict = judged(host_of(url), path_of(url), rules)
    return pages.select(url.alias(url_col), (verdict == "block").cast("double").alias("block")).filter("block IS NOT NULL")


def _entropy(data: bytes) -> float:
    if not data:
        return 0.0
    counts = np.bincount(np.frombuffer(data, np.uint8))
    p = counts[counts > 0] / len(data)
    return float(-(p * np.log2(p)).sum())


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features of a URL that need nothing but its text."""
    labels = host.split(".") if host else []
    tail = url.partition("://")[2]
    query = tail.partition("#")[0].partition("?")[2]
    digits = sum(c in b"0123456789" for c in url.encode())
    path_digits = sum(c in b"0123456789" for c in path.encode())
    return [
        len(url), len(host), len(path), sum(bool(x) for x in path.split("/")), len(labels), max(map(len, labels), default=0),
        digits / max(1, len(url)), path_digits, host.count("-"), _entropy(host.encode()), _entropy(path.encode()),
        sum(bool(x) for x in query.split("&")), float("#" in tail), float(url[:8].lower() == "https://"),
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth: for each tree, features and cuts in heap order and leaf values."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with Newton leaves, on quantile histograms."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(start, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])
    score = np.full(len(y), start)
    features, cuts, leaves = [], [], []
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            mine = np.flatnonzero(node == at)
            best = (1e-9, None, None)
            if len(mine) >= 2 * least:
                whole = g[mine].sum() ** 2 / (h[mine].sum() + ridge)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[mine, f]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[mine], h[mine], np.ones(len(mine))))
                    gain = gs**2 / (hs + ridge) + (g[mine].sum() - gs) ** 2 / (h[mine].sum() - hs + ridge) - whole
                    gain[(ns < least) | (len(mine) - ns < least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, e[k])
            if best[1] is not None:
                feature[at], cut[at] = best[1], best[2]
            node[mine] = 2 * at + 1 + (x[mine, feature[at]] > cut[at])
        place = node - inner
        leaf = rate * np.bincount(place, g, 2**depth) / (np.bincount(place, h, 2**depth) + ridge)
        score += leaf[place]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(cuts), np.array(leaves))


def _features(batch: pa.RecordBatch) -> np.ndarray:
    rows = [lexical(u or "", h, p) for u, h, p in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")))]
    rates, seen = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("suffix_rate", "suffix_seen"))
    return np.column_stack((np.array(rows, float).reshape(len(rows), len(FEATURES) - 2), rates, seen))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) for each row of ``pages``.

    A rule that fits decides, the longest first; else boosted trees do, which block from
    a probability of one half on. They learn from ``labelled`` (url, block 0 or 1): at
    most ``sample`` distinct URLs, those of least hash, while suffix statistics cover all
    labelled rows, for a URL that is learned from all but itself. By default they learn
    from the URLs of ``pages`` that some rule judges, and suffix statistics are left out;
    ``labelled=ruled(pages)`` learns from the same URLs with them. Either is weak
    supervision, for the rules go by suffixes. Without labelled rows all is allowed. Null URLs, and URLs without ``://``, have an empty host and
    path. Repeated rows and null ids come out as they went in; further columns are
    ignored. No rows: no rows.
    """
    spark = pages.sparkSession
    ship(spark)

    def ready(rows: DataFrame, *kept: Column) -> DataFrame:
        url = F.col(url_col).cast("string")
        out = rows.select(*kept, url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
        return out.withColumn("suffix", F.substring_index("host", ".", -1))

    rows = ready(pages, F.col(id_col).cast("bigint").alias("page_id"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    if labelled is None:
        known = rows.filter("ruled IS NOT NULL").withColumn("block", (F.col("ruled") == "block").cast("double"))
    else:
        known = ready(labelled, F.col("block").cast("double").alias("block")).filter("block IS NOT NULL")
    suffixes = None
    if labelled is not None:
        # Blocked URLs of each last host label, and all of them.
        suffixes = known.groupBy("suffix").agg(F.sum("block").alias("blocked"), F.count(F.lit(1)).alias("all")).withColumnRenamed("suffix", "known_suffix")
        suffixes = cut(suffixes)
        # Suffixes are few and most URLs share one, so dealing rows by suffix is avoided where that is checked.
        if suffixes.count() <= BROADCAST_SUFFIXES:
            suffixes = F.broadcast(suffixes)

    def with_suffix(some: DataFrame, own: bool = False) -> DataFrame:
        """Smoothed share of blocked URLs of the suffix; for rows that are learned from, of the other rows. The same for all, where they are left out."""
        if suffixes is None:
            return some.select("*", F.lit(0.5).alias("suffix_rate"), F.lit(0.0).alias("suffix_seen"))
        blocked, every = F.coalesce("blocked", F.lit(0.0)), F.coalesce("all", F.lit(0))
        if own:
            blocked, every = blocked - F.col("block") * F.col("times"), every - F.col("times")
        joined = some.join(suffixes, some["suffix"] == suffixes["known_suffix"], "left")
        return joined.select(*some.columns, ((blocked + 1) / (every + 2)).alias("suffix_rate"), F.log2(every + 1.0).alias("suffix_seen"))

    # Distinct labelled URLs of least hash: a bound on the hash, set from their number, lets few rows through
    # before they are put in order.
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    many = known.agg(F.approx_count_distinct("url").alias("n")).first()["n"]
    near = known.filter(place < int((1 << 40) * min(1.0, 1.5 * (sample + 1000) / max(1, many))))
    chosen = near.groupBy("url", "host", "path", "suffix", "block").agg(F.count(F.lit(1)).alias("times")).orderBy(place, "url", "block").limit(sample)
    learned = with_suffix(chosen, own=True).orderBy(place, "url", "block").toArrow().to_batches()
    x = np.concatenate([np.zeros((0, len(FEATURES))), *(_features(b) for b in learned)])
    y = np.concatenate([np.zeros(0), *(b.column("block").to_numpy() for b in learned)])
    model = fit(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(_features(batch)) if len(y) else np.zeros(batch.num_rows)
            kept = [batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p)], names=["page_id", "host", "path", "rule", "ruled", "block_probability"])

    scored = with_suffix(rows).mapInArrow(lean(run), "page_id bigint, host string, path string, rule string, ruled string, block_probability double")
    guess = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"), "block_probability")
