"""The kept keyword index against the search that reads all records."""

import random

import pyarrow as pa
import pytest

from trustloom.operators import index as kept, search

WORDS = "alpha beta gamma delta the of and cache-key v1.2 noon é über".split()
ASKED = [("a", "the of"), ("b", "alpha"), ("c", "cache-key"), ("d", "cache-key the"), ("e", "gone"), ("f", "v1.2 noon"), ("g", "!!"), ("h", "UBER e")]


def texts(seed, ids):
    some = random.Random(seed)
    return [(f"m{i:04d}", " ".join(some.choices(WORDS, weights=[3, 2, 1, 1, 9, 8, 5, 2, 2, 1, 1, 1], k=some.randrange(0, 30))), some.choice([None, [], ["the"], ["beta", "noon"]])) for i in ids]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "memory_id string, content string, tags array<string>").repartition(3)


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_as_the_search_through_changes(spark, tmp_path, frame, monkeypatch):
    monkeypatch.setattr(kept, "STRETCH", 16)
    monkeypatch.setattr(kept, "SEEDS", 1)
    found, rows = kept.Index(spark, str(tmp_path)), {}

    def same(k=5):
        live = frame(list(rows.values())) if rows else frame([("x", "", None)]).limit(0)
        assert plain(found.top(ASKED, k)) == plain(search.keyword(live, ASKED, k))

    same()
    for seed, ids in ((1, range(200)), (2, range(150, 230))):  # the second replaces fifty
        new = texts(seed, ids)
        found.add(frame(new))
        rows |= {r[0]: r for r in new}
        same()
    gone = [f"m{i:04d}" for i in range(0, 230, 3)]
    found.delete(frame([(g, None, None) for g in [*gone, "unknown"]]))
    rows = {i: r for i, r in rows.items() if i not in gone}
    same()
    found.compact()
    same(3)
    assert len(found.manifest()["segments"]) == 1 and not found.manifest()["gone"] and found.top([], 3).count() == 0 == found.top(ASKED, 0).count()
    assert found.vacuum(keep=1, older_than_s=-60)
    same()


def test_stretches_below_the_kth_score_are_not_read(spark, tmp_path, frame, monkeypatch):
    monkeypatch.setattr(kept, "STRETCH", 8)
    rows = [(f"m{i:04d}", "noon " + ("noon " * 5 if i < 8 else "and then a long run of other words " * 3), None) for i in range(400)] + [(f"n{i}", "else", None) for i in range(900)]
    found = kept.Index(spark, str(tmp_path))
    found.add(frame(rows).repartition(1).sortWithinPartitions("memory_id"))
    assert plain(found.top([("q", "noon")], 4)) == plain(search.keyword(frame(rows), [("q", "noon")], 4))
    every, first, more = (df.count() for df in found.read_stretches)
    assert every == 50 and first == kept.SEEDS and more == 0
    plan = found._blocks(found.manifest(), ["noon"]).select("term", "n", "most", "least")._jdf.queryExecution().toString()
    assert "In(term, [noon])" in plan or "EqualTo(term,noon)" in plan


def test_a_writer_that_dies_leaves_the_index(spark, tmp_path, frame, monkeypatch):
    found = kept.Index(spark, str(tmp_path))
    found.add(frame(texts(1, range(20))))
    found.delete(frame([("m0002", None, None)]))
    before = plain(found.top(ASKED, 3))
    found._step = lambda name: 1 / 0
    for change in (lambda: found.add(frame(texts(2, range(30)))), lambda: found.delete(frame([("m0001", None, None)])), found.compact):
        with pytest.raises(ZeroDivisionError):
            change()
    assert plain(kept.Index(spark, str(tmp_path)).top(ASKED, 3)) == before


def test_places_are_put_in_blocks_where_records_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "PLACES", 3)  # several parts of a stretch
    rows = spark.createDataFrame([(f"m{k}", text, ["a b"]) for k, text in enumerate(["a b a", "", "b", "c a b c a b"])], "memory_id string, content string, tags array<string>").coalesce(1)
    made = kept.Index(spark, str(tmp_path / "i"))
    made.add(rows)
    at = made.manifest()
    got = {r.term: (r.n, r.most, r.least, list(zip(r.docs, r.counts, r.sizes, r.places))) for r in made._read(at, "blocks", kept.BLOCKS).collect()}
    assert got["a"] == (4, 3, 2, [(0, 3, 5, [0, 2, 4]), (1, 1, 2, [1]), (2, 1, 3, [2]), (3, 3, 8, [1, 4, 7])])
    assert got["b"] == (4, 3, 2, [(0, 2, 5, [1, 5]), (1, 1, 2, [2]), (2, 2, 3, [0, 3]), (3, 3, 8, [2, 5, 8])]) and got["c"] == (1, 2, 8, [(3, 2, 8, [0, 3])])
    parts = list(kept._parts((pa.RecordBatch.from_pylist([{"doc": d, "size": 2, "a": ["x", "x"], "b": []}], pa.schema([("doc", pa.int64()), ("size", pa.int64()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string()))])) for d in (4095, 4096)), 4096, 9))
    assert [r for p in parts for r in p.select(["stretch", "docs", "places"]).to_pylist()] == [{"stretch": 0, "docs": [4095], "places": [[0, 1]]}, {"stretch": 1, "docs": [0], "places": [[0, 1]]}]
