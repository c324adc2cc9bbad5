"""Operator 3 against its SQL on rows of every kind."""

import random

import duckdb
import pytest

from trustloom.llm import topk


@pytest.mark.parametrize("block", [8192, 2])
def test_query_equals_sql(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    rng = random.Random(block)
    vector = lambda: [rng.choice([-1.5, -0.25, 0.0, 0.125, 0.5, 1.0]) for _ in range(4)]
    rows = [(k, vector(), 1) for k in range(650)] + [(700, None, 1), (701, [1.0, None, 0.0, 0.0], 1), (702, [float("nan"), 0.0, 0.0, 0.0], 1), (800, [float("inf"), 0.0, 0.0, 0.0], 1), (None, vector(), 1)]
    rows += [(7, vector(), 2), (7, vector(), 3)] + [(900 + k, [0.5] * 4, 1) for k in range(1, 60)]  # ties
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, topk.op3_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.sql(topk.ORACLE_SQL).fetchall()) and len(got) == 70


def test_too_few_and_no_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(rows, rows.vec_id == 0).collect()] == [(0, 1, 1, 3 * 1024 * 1024 + 8 * 1024 * 1024)]
    assert topk.top_k(rows.limit(0), rows.vec_id == 0).count() == topk.top_k(rows, rows.vec_id == 9).count() == 0
