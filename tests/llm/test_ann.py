"""Operator 11 against brute force: recall, exact scores, order."""

import numpy as np
import pytest

from trustloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, V int, shard int"


def brute(rows, is_query, k):
    """The k best of every query, by (score, id)."""
    fine = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q_id in {i for i, _ in fine if is_query(i)}:
        q = min((tuple(v) for i, v in fine if i == q_id))
        best = sorted({(-float((np.array(q) * v).sum()), i) for i, v in fine if i != q_id and len(v) == len(q)})[:k]
        out[q_id] = [(i, -s) for s, i in best]
    return out


def found(spark, rows, modulus, k):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(3)
    out = {}
    for r in sorted(ann.nearest(frame, frame.vec_id % modulus == 0, k).collect(), key=lambda r: r["rank"]):
        assert len(out.setdefault(r.query_id, [])) == r["rank"] - 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, wanted):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in wanted.items())
    return hits / sum(map(len, wanted.values()))


@pytest.mark.parametrize("kind", ["isotropic", "clusters", "lengths"])
def test_recall(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 32))
    if kind == "clusters":
        x = x * 0.1 + rng.standard_normal((40, 32))[rng.integers(40, size=4000)]
    if kind == "lengths":
        x *= rng.lognormal(size=(4000, 1))
    monkeypatch.setattr(ann, "SHARD_ROWS", (256, 300))
    monkeypatch.setattr(ann, "SAMPLE", 500)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got, wanted = found(spark, rows, 20, 20), brute(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == wanted.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, wanted) >= 0.95
    for q, mine in got.items():
        scores = {i: s for i, s in brute([rows[q], *[rows[i] for i, _ in mine]], lambda i: i == q, 20)[q]}
        assert all(abs(scores[i] - s) < 1e-12 for i, s in mine) and mine == sorted(mine, key=lambda p: (-p[1], p[0]))


def test_leaves_are_left_out_where_vectors_cluster():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8192, 24)) * 0.05 + rng.standard_normal((64, 24))[rng.integers(64, size=8192)]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    shard = ann.Shard(np.arange(8192), x, float(np.sqrt((x * x).sum(axis=1).max())))
    shard.search(np.arange(100), x[:100], np.full(100, -np.inf), 10, ann.quantile(ann.SURE))
    assert shard.verified < 0.6 * 100 * 8192


def test_odd_rows_copies_and_widths(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", (16, 40))
    rng = np.random.default_rng(9)
    rows = [(k, [0.5, 0.25, -1.0]) for k in range(300)] + [(k, rng.standard_normal(3).tolist()) for k in range(300, 420)]  # a large group of copies
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (1002, [3.0, 1.0])] + [(1100, [1.0, 1.0, 1.0, 1.0])]  # widths of their own
    rows += [(1200, None), (1220, []), (1240, [0.0, 0.0, 0.0]), (1260, [1.0, None, 0.0]), (1280, [float("nan"), 1.0, 1.0]), (1300, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(40, [0.5, 0.25, -1.0]), (40, [9.0, 9.0, 9.0]), (41, [7.0, 7.0, 7.0])]
    got, wanted = found(spark, rows, 20, 20), brute(rows, lambda i: i % 20 == 0, 20)
    assert {q: v for q, v in wanted.items() if v}.keys() == got.keys()
    assert recall(got, {q: wanted[q] for q in got}) > 0.95
    assert got[0] == wanted[0] and got[1000] == wanted[1000]  # ties to the smaller ids


def test_of_nothing(spark):
    assert found(spark, [], 20, 20) == {} and found(spark, [(1, [1.0]), (20, None)], 20, 20) == {} and found(spark, [(20, [1.0])], 20, 20) == {}


def test_quantiles():
    assert abs(ann.quantile(0.95, 8) - 15.507) < 1e-3 and abs(ann.quantile(0.5, 2) - 2 * np.log(2)) < 1e-9
