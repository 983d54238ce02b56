"""The audit of filter interactions against plain loops over every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

from bilens.llm import interactions

DOCS = "doc_id bigint, text string, source string"
LABELS = "doc_id bigint, quality int, toxic int"


def sample():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "DELTA", "eps#", "zeta", "10%", "éta", "漢字", "iota"]
    rows = []
    for i in range(120):
        vocabulary = words if i % 3 else [f"w{j}" for j in range(80)]
        text = rng.choice([" ", "\n", "\t "]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 49, 50, 90])))
        rows.append((i, text, rng.choice(["s0", "s1", None, ""])))
    rows += [(200 + i, rows[5 + i % 4][1], f"s{i % 2}") for i in range(40)]
    rows += [(300, None, "s0"), (301, "", "s1"), (302, None, None), (None, rows[5][1], "s0"), (None, None, "s9"), (7, rows[5][1], "s1"), (4, "other text", "s0"), rows[9], rows[9]]
    rows.append((400, " ".join(f"v{i}" for i in range(30_000)), "long"))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(8, 1, 0), (8, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def brute(rows, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in range(2))
    least = defaultdict(lambda: float("inf"))
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least[t or ""], i)
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[s or ""].append(({f for f in failed if failed[f]}, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        taken = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                stay = [d for d in left if f not in d[0]]
                fail = [d for d in docs if f in d[0]]
                taken[f] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), len(fail) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(taken[order[step - 1]])
    return out


def test_every_order_as_if_it_were_run(spark):
    rows, labels = sample()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS mask", "'x' AS part", "1 AS n", "'y' AS k1", "0 AS good", "0 AS step", "'w' AS word").repartition(3)
    marks = spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' AS own", "1 AS n")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in interactions.audit(docs, marks).collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    rows, labels = sample()
    none, unmarked = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert interactions.audit(none, spark.createDataFrame(labels, LABELS)).count() == 0
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in interactions.audit(spark.createDataFrame(rows, DOCS), unmarked).collect()}
    assert got == brute(rows, [])


def test_filters_of_ones_own(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 3, 1, 0, 0), ("p", 2, 4, 0, 4)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = {(r["filter_order"], r["step"]): list(r)[3:] for r in interactions.orders_audit(masks, "XY").collect()}
    assert got == {
        ("XY", 1): [9, 3, 0, 0, 1, 1, 3],
        ("XY", 2): [5, 4, 3, 4, 0, 4, 11],
        ("YX", 1): [5, 7, 0, 4, 1, 5, 11],
        ("YX", 2): [5, 0, 3, 0, 0, 0, 3],
    }


def test_a_texts_words_do_not_travel(spark, sf):
    """One exchange carries texts; the words of a text are counted where it arrives."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("xxhash64(text) AS k1", "xxhash64('second', text) AS k2", "text")
    plan = interactions.word_totals(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
