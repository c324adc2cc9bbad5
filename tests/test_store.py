"""The store's commits: nothing in between is seen, nothing is lost, and little is rewritten."""

import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from trustloom.store import Conflict, Store

NOW = datetime(2024, 6, 1, 12, tzinfo=UTC)
SCHEMA = "memory_id string, content string, source_type string, source_ref string, created_at timestamp, updated_at timestamp, contradicts array<string>"


class Died(Exception):
    pass


class Mortal(Store):
    """A store whose writers stop, or let others go first, at a step."""

    at = None

    def _step(self, name):
        if self.at and name == self.at[0]:
            act, self.at = self.at[1], None
            act()


def die():
    raise Died


@pytest.fixture
def rows(spark):
    return lambda *given: spark.createDataFrame([(f"m{i}", content, "user", "user://a", NOW, NOW, list(links)) for i, content, *links in given], SCHEMA)


def opened(spark, path, kind=Mortal):
    return kind(spark, str(path), id_pattern="^m[0-9]+$", buckets=8)


def state(store):
    return sorted((r.memory_id, r.content, r.status) for r in store.table("records").collect()), sorted((r.memory_id, r.other_id) for r in store.edges().collect())


@pytest.mark.parametrize("step", ["written", "beside"])
@pytest.mark.parametrize("verb", ["add", "update", "put", "soft_delete"])
def test_a_writer_that_dies_changes_nothing(spark, tmp_path, rows, step, verb):
    s = opened(spark, tmp_path)
    s.add(rows((1, "a", "m2"), (2, "b")))
    before, what = state(s), {"add": rows((3, "c", "m1")), "update": rows((1, "z")), "put": rows((1, "z"), (4, "d", "m2")), "soft_delete": "m1"}[verb]
    s.at = (step, die)
    with pytest.raises(Died):
        getattr(s, verb)(what)
    again = opened(spark, tmp_path)
    assert state(again) == before and again.version() == 1
    getattr(again, verb)(what)
    assert state(again) != before and again.version() == 2 and state(again) == state(opened(spark, tmp_path))
    lost = again.vacuum(keep=1, older_than_s=-60)
    assert lost and state(opened(spark, tmp_path)) == state(again)


def test_a_store_without_its_log_is_not_written_over(spark, tmp_path, rows):
    opened(spark, tmp_path).add(rows((1, "a")))
    for name in os.listdir(tmp_path / "log"):
        os.remove(tmp_path / "log" / name)
    with pytest.raises(ValueError):
        opened(spark, tmp_path)


def test_two_writers_lose_nothing(spark, tmp_path, rows):
    a, b = opened(spark, tmp_path), opened(spark, tmp_path)
    a.add(rows(*[(i, "old") for i in range(20)]))
    a.at = ("written", lambda: b.update(rows(*[(i, "theirs") for i in range(0, 20, 2)])))  # the same buckets
    a.update(rows(*[(i, "mine") for i in range(1, 20, 2)]))
    assert [r[1] for r in sorted(state(a)[0], key=lambda r: int(r[0][1:]))] == ["theirs", "mine"] * 10
    a.at = ("beside", lambda: b.add(rows((100, "new"))))
    with pytest.raises(ValueError, match="known memory_id m100"):
        a.add(rows((100, "also new")))
    a.at = ("beside", lambda: b.soft_delete("m1"))
    a.soft_delete("m2")
    assert {r[0] for r in state(b)[0] if r[2] == "deleted"} == {"m1", "m2"}


def test_writers_of_other_buckets_do_no_work_twice(spark, tmp_path, rows):
    a, b = opened(spark, tmp_path), opened(spark, tmp_path)
    a.add(rows(*[(i, "old", "m0") for i in range(1, 30)]))
    of = {r.memory_id: r.b for r in a.table("records").select("memory_id", a._bucket(F.col("memory_id")).alias("b")).collect()}
    one = "m1"
    two = next(m for m in of if of[m] != of[one])
    done = []
    written = a._written
    a._written = lambda *given: done.append(given[2]) or written(*given)
    a.at = ("written", lambda: b.soft_delete(two))
    a.soft_delete(one)
    assert done == [{str(of[one])}]  # put on top of the other's commit
    assert {r[0] for r in state(a)[0] if r[2] == "deleted"} == {one, two} and len(state(a)[1]) == 29
    first, last = a.manifest(1)["tables"], a.manifest()["tables"]
    assert {k for k, v in last["records"].items() if first["records"][k] != v} == {str(of[one]), str(of[two])} and first["edges"] == last["edges"]
    assert a.table("records", version=1).filter("status = 'deleted'").count() == 0


def test_endless_conflict_is_said(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr("trustloom.store.ATTEMPTS", 2)
    a, b = opened(spark, tmp_path), opened(spark, tmp_path)
    a.add(rows((1, "x")))
    turn = iter(range(9))
    a._step = lambda name: b.update(rows((1, f"y{next(turn)}"))) if name == "written" else None
    with pytest.raises(Conflict):
        a.update(rows((1, "z")))


def test_other_file_systems_refuse_a_taken_number(spark, tmp_path):
    s = opened(spark, tmp_path)

    class Named:
        def __getattr__(self, name):
            return (lambda: "other") if name == "getScheme" else getattr(files, name)

    files = s._fs
    s._fs = Named()
    nothing = s.manifest() | {"version": 1}
    assert s._publish(nothing) and not s._publish(nothing) and s.version() == 1


def test_a_lookup_reads_one_bucket_and_filters_reach_the_scan(spark, tmp_path, rows):
    s = opened(spark, tmp_path)
    s.add(rows(*[(i, "x") for i in range(50)]))
    assert s.get("m7").count() == 1 and s.get("m77").count() == 0 and len({os.path.dirname(f) for f in s.get("m7").inputFiles()}) == 1
    plan = s.scan(scope="global", status="active")._jdf.queryExecution().toString()
    assert "EqualTo(scope,global)" in plan and "EqualTo(status,active)" in plan


def test_edges_keep_when_they_were_found(spark, tmp_path, rows):
    s = opened(spark, tmp_path)
    s.add(rows((1, "a", "m2", "m3")))
    found = {r.other_id: r.detected_at for r in s.edges().collect()}
    s.update(rows((1, "b", "m3", "m4")))
    now = {r.other_id: r.detected_at for r in s.edges().collect()}
    assert now.keys() == {"m3", "m4"} and now["m3"] == found["m3"] and s.hydrated().first().contradicts == ["m3", "m4"]


def test_whole_rows_are_sent_once(spark, rows, tmp_path, capsys):
    """A replacement neither joins whole rows nor sends them twice; files are packed with CODEC."""
    import pyarrow.parquet as pq

    store = opened(spark, tmp_path, Store)
    store.add(rows(*[(i, f"old {i}") for i in range(40)]))
    old = store.table("records")
    store._replaced(old, old.filter("memory_id < 'm2'").withColumn("content", F.lit("new")), {str(b) for b in range(8)}).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan
    store.put(rows(*[(i, f"new {i}") for i in range(20, 60)]))
    assert sorted(r.content for r in store.table("records").collect()) == sorted([f"old {i}" for i in range(20)] + [f"new {i}" for i in range(20, 60)])
    files = [p for p in tmp_path.rglob("*.parquet")]
    assert files and {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in files} == {"ZSTD"}
