"""Halves: numbers in texts and cosines round as their SQL does."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from trustloom.functions import embed, text
from trustloom.operators import knn, search
from trustloom.operators.queries import QUERIES
from trustloom.plans import sql as S


def test_two_places_round_by_the_exact_value(spark):
    values = [k / 1000 for k in range(1001)] + [k / 8 for k in range(9)] + [0.1249999999, 0.565000001, 0.004999, 1e-9, 0.9999999]
    got = [r.t for r in spark.createDataFrame(list(enumerate(values)), "k int, v double").orderBy("k").select(text.two_places(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.2f}" for v in values]
    assert got == [r[0] for r in duckdb.sql(f"select printf('%.2f', v::double) from (select unnest({values}) as v)").fetchall()]


def test_cosines_round_halves_away_from_zero(spark):
    assert embed.six(np.array([1 / 128, -1 / 128, 0.1234564, 0.0, -1.0])).tolist() == [0.007813, -0.007813, 0.123456, 0.0, -1.0]
    df = spark.createDataFrame([("a", [128.0, 0.0]), ("b", [1.0, float(np.sqrt(128 ** 2 - 1))])], "memory_id string, cells array<double>")
    a = df.filter("memory_id = 'a'").select(F.col("memory_id").alias("query_id"), "cells")
    assert [r.cosine for r in search.nearest(a, df, 1, not_self=True).collect()] == [r.cosine for r in knn.join(df, 1).collect()][:1] == [0.007813]


def test_final_rank_says_trust_as_its_sql(spark, tmp_path):
    db = duckdb.connect()
    db.sql(f"create table documents as select range as doc_id, 'What backend does the project use' as text, 'en' as lang, 's' || range % 2 as source from range(60000)")
    half = "abs(t * 1000 - round(t * 1000)) < 1e-9 and cast(round(t * 1000) as int) % 10 = 5 and printf('%.2f', t) <> printf('%.2f', t + 1e-9)"
    ids = db.sql(f"{S.SCORED_SQL}, z as (select cast(memory_id as int) as id, round(trust, 6) as t from scored where status = 'active' and sensitivity = 'public') select id from z where {half} order by id limit 8").fetchall()
    db.sql(f"delete from documents where doc_id not in {tuple(i for i, in ids)}")
    db.sql("update documents set source = null where doc_id = (select min(doc_id) from documents)")
    db.sql(f"copy documents to '{tmp_path}/documents.parquet'")
    query, sql = QUERIES["final_rank"]
    found, wanted = query(spark, str(tmp_path)), db.sql(sql)
    names = sorted(found.columns)
    key = lambda row: tuple(map(str, row))
    got = sorted(map(key, found.select(*names).collect()))
    assert got and got == sorted(map(key, wanted.select(*[f'"{n}"' for n in names]).fetchall()))
