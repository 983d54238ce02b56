"""Near-duplicates of embeddings by the inverted multi-index, against all pairs."""

import math

import numpy as np
import pytest

from bilens.llm import multi_index

ROWS = "vec_id bigint, embedding array<float>, label int"


def near(rng, v, cosine):
    """A vector at the given cosine of ``v``, of another length."""
    v = v / np.linalg.norm(v)
    other = rng.standard_normal(len(v))
    other -= other @ v * v
    return (cosine * v + math.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other)) * rng.uniform(0.1, 9)


def brute(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of each row, from all pairs."""
    good = [r for r, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    units = {r: np.float32(rows[r][1]).astype(float) for r in good}
    units = {r: v / np.linalg.norm(v) for r, v in units.items()}
    partners = {r: [s for s in good if s != r and rows[s][2] == rows[r][2] and len(units[s]) == len(units[r]) and units[s] @ units[r] >= least] for r in good}
    out = []
    for r, (i, _, _) in enumerate(rows):
        seen, todo = {r}, [r]
        while todo:
            for s in partners.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        least_id = min(ids) if ids else None
        out.append((i, len(partners.get(r, ())), least_id, i == least_id))
    return out


def sample(seed=1, dims=24, n=150):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dims).tolist(), int(i % 3)) for i in range(n)]
    for i in range(60):
        rows.append((1000 + i, near(rng, np.array(rows[i % 20][1]), rng.choice([0.97, 0.979, 0.9805, 0.99, 0.9999])).tolist(), rows[i % 20][2]))
    centre = rng.standard_normal(dims)
    rows += [(2000 + i, near(rng, centre, 0.9935).tolist(), 1) for i in range(40)]
    rows += [(3000 + i, rows[4][1], 1) for i in range(30)] + [(3100, rows[4][1], 2), (3101, rows[4][1], None)]
    rows += [(None, rows[5][1], 2), (None, rows[5][1], 2), (None, rng.standard_normal(dims).tolist(), 0), (7, rng.standard_normal(dims).tolist(), 0), rows[9], rows[9]]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * dims, 1), (4003, [float("nan")] + [1.0] * (dims - 1), 1), (4004, [float("inf")] * dims, 1), (4005, [None] + [1.0] * (dims - 1), 1)]
    rows += [(5000, [2.0], 1), (5001, [7.0], 1), (5002, [-1.0], 1), (5003, [1.0, 0.1], 1), (5004, [1e30, 1e29], 1), (5005, [-0.0, 1e-30], 1), (5006, [0.0, 3.0], 1)]
    return rows


def got(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_links_components_and_kept(spark):
    rows = sample()
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS node", "1 AS v", "2 AS k1", "'h' AS home", "3 AS many", "'c' AS cell").repartition(3)
    assert got(multi_index.near_duplicates(df)) == sorted(map(str, brute(rows)))
    assert multi_index.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0


def test_crowded_cells_are_compared_block_by_block(spark, monkeypatch):
    """With blocks of 16 vectors, the group of 40 and its cell are cut; nothing may change."""
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", 1)
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    rows = sample(2) + [(6000 + i, near(np.random.default_rng(i), np.ones(24), 0.9935).tolist(), 1) for i in range(700)]
    assert got(multi_index.near_duplicates(spark.createDataFrame(rows, ROWS))) == sorted(map(str, brute(rows)))


def test_a_fine_grid_still_meets_the_pairs(spark, monkeypatch):
    """Cells of eight vectors: of pairs at 0.98 to 0.99, the hardest, nearly all are met; none below is."""
    monkeypatch.setattr(multi_index, "CELL", 8)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(64).tolist(), 0) for i in range(3000)]
    rows += [(10_000 + i, near(rng, np.array(rows[i][1]), rng.uniform(0.98001, 0.99)).tolist(), 0) for i in range(800)] + [(20_000 + i, near(rng, np.array(rows[i][1]), 0.975).tolist(), 0) for i in range(800)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    true = {i: (n, c) for i, n, c, _ in brute(rows)}
    assert len(found) == len(rows) and all(found[i][0] <= true[i][0] for i in true)
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in true.values())


def test_the_traversal_takes_pairs_in_order_until_enough():
    first, second = np.array([1.0, 0.3, 0.1, 0.001]), np.array([1.0, 0.5, 0.02])
    order = sorted(((first[i] * second[j], i, j) for i in range(4) for j in range(3)), reverse=True)
    for enough in (0.0, 0.5, 0.9, 0.999, 1.0):
        pairs = multi_index.multi_sequence(first, second, enough)
        assert [first[i] * second[j] for i, j in pairs] == [p for p, _, _ in order[: len(pairs)]]
        assert sum(p for p, _, _ in order[len(pairs) :]) <= 1 - enough + 1e-12
        assert len(pairs) == 1 or sum(p for p, _, _ in order[len(pairs) - 1 :]) > 1 - enough


@pytest.mark.parametrize("width", [2, 8, 64])
def test_a_turn_keeps_lengths_and_products(width):
    v = np.random.default_rng(0).standard_normal((5, width - 1))
    t = multi_index.turned(v, width)
    assert np.allclose(t @ t.T, v @ v.T)
