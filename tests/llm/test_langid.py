"""Operator 5: held-out accuracy, and rows of every kind."""

import numpy as np

from trustloom.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = langid.op5_langid(spark, sf).join(labels, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_rows_of_every_kind(spark):
    rng = np.random.default_rng(1)
    text = {"a": "the cat and the dog went out of the house", "b": "der hund und die katze gingen aus dem haus", "c": "кот и собака вышли из дома"}
    rows = [(k, " ".join(rng.permutation(text[lang].split())), lang, "x") for k in range(40) for lang in text]
    odd = [(None, "the dog and the cat", "a", "x"), (200, None, "a", "x"), (201, "", "b", "x"), (202, "12 34 !", "b", "x"), (203, "der katze " * 100_000, None, "x"), (204, "кот", None, "x"), (204, "кот", None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, LANG_PRED string")
    model = langid.train(docs)
    assert model[0] == ["a", "b", "c"]
    out = langid.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {(str(r.doc_id), r.lang_pred) for r in out.filter("doc_id is null or doc_id >= 200").collect()}
    assert got == {("None", "a"), ("200", "und"), ("201", "und"), ("202", "und"), ("203", "b"), ("204", "c")} and out.count() == len(rows) + len(odd)
    assert all(r.lang == r.lang_pred for r in out.filter("lang is not null and lang_pred <> 'und'").collect())
    assert langid.train(docs.limit(0)) is None and langid.train(docs.filter("doc_id = 202")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"} and langid.predict(docs.limit(0), model).count() == 0


def test_fit_is_bounded_and_determined(spark):
    rows = [(k, f"text {k} of a kind", f"lang{k % 30}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = langid.train(docs, 400, 60), langid.train(docs.repartition(7), 400, 60)
    assert len(a[0]) == 30 and np.allclose(a[1], b[1], atol=1e-4) and np.allclose(a[2], b[2], atol=1e-4)


def test_blocks_of_the_fit_are_one(monkeypatch):
    rng = np.random.default_rng(2)
    bits = rng.random((50, langid.BUCKETS)) < 0.01
    langs = [["x", "y"][k % 2] for k in range(50)]
    one = langid.fit(np.packbits(bits, axis=1), langs)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert np.allclose(one[1], langid.fit(np.packbits(bits, axis=1), langs)[1], atol=1e-5)
