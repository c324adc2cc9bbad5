"""Set-similarity joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from trustloom.operators import setsim


def sets(seed, n):
    some = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        t = some.choices(words, weights=[40 - i for i in range(40)], k=some.randrange(0, 12))
        out.append((f"m{i:03d}", some.choice(["x", "y", None]), t))
        if some.random() < 0.4:
            out.append((f"n{i:03d}", out[-1][1], t[1:] + some.choices(words, k=1)))
    return out + [("null", "x", None), ("empty", "x", [])]


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least, hot, within", [(0.6, 20_000, None), (0.5, 3, "place"), (0.8, 2, None), (1.0, 20_000, "place")])
def test_as_all_pairs(spark, monkeypatch, least, hot, within):
    monkeypatch.setattr(setsim, "HOT", hot)
    rows = sets(3, 120)
    df = spark.createDataFrame(rows, "memory_id string, place string, tokens array<string>").repartition(3)
    asked = df.filter(F.substring("memory_id", -1, 1) < "5")
    got = sorted((r.query_id, r.memory_id, round(r.score, 9)) for r in setsim.join(asked, df, least, within).collect())
    full = [(i, p, set(t)) for i, p, t in rows if t]
    wanted = [(a, b, round(jaccard(s, t), 9)) for a, p, s in full if a[-1] < "5" for b, q, t in full if jaccard(s, t) >= least and (not within or p == q)]
    assert got == sorted(wanted) and len(wanted) > 60


def test_top_as_all_pairs(spark):
    rows = [(i, t) for i, _, t in sets(5, 150)]
    asked = [("a", ["w0", "w1", "w2", "w2"]), ("b", ["w39", "w5", "w7", "w9"]), ("c", ["other"]), ("d", [])]
    for least in (0.0, 0.3):
        got = setsim.top(spark.createDataFrame(asked, "query_id string, tokens array<string>"), spark.createDataFrame(rows, "memory_id string, tokens array<string>"), 6, least)
        wanted = []
        for q, s in asked:
            best = sorted((-round(jaccard(set(s), set(t)), 6), i) for i, t in rows if t and s and set(s) & set(t) and round(jaccard(set(s), set(t)), 6) >= least)[:6]
            wanted += [(q, n + 1, i, -x) for n, (x, i) in enumerate(best)]
        assert sorted(map(tuple, got.collect())) == sorted(wanted)
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
