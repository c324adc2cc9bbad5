"""Keyword search over frames."""

from trustloom.operators import search


def test_phrases_are_counted_without_a_row_a_place(spark, monkeypatch):
    rows = [("a", "cache-version cache version of the cache", ["noon"]), ("b", "the the the cache", ["version"]), ("c", None, None), ("d", "lunch at", ["noon", "the"])]
    df = spark.createDataFrame(rows, "memory_id string, content string, tags array<string>")
    kept, write = [], search.stored

    def seen(x):
        out = write(x)
        kept.extend(out.collect())
        return out

    monkeypatch.setattr(search, "stored", seen)
    got = [(r.query_id, r.rank, r.memory_id) for r in search.keyword(df, [("p", "cache-version"), ("q", "the cache"), ("r", "at-noon"), ("s", "...")], 5).orderBy("query_id", "rank").collect()]
    assert got == [("p", 1, "a"), ("q", 1, "b"), ("q", 2, "a")] or got == [("p", 1, "a"), ("q", 1, "a"), ("q", 2, "b")]
    assert len(kept) == len(rows)  # a row a record, however often it holds a term
    assert {(r.memory_id, h.query_id, h.phrase): h.f for r in kept for h in r.found} == {
        ("a", "p", 0): 2, ("a", "q", 0): 1, ("a", "q", 1): 3, ("b", "q", 0): 3, ("b", "q", 1): 1, ("d", "q", 0): 1}
