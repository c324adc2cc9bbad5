"""The keyed stream, stopped and started again, against the batch."""

import random
from datetime import UTC, datetime, timedelta

from trustloom.streaming import state
from trustloom.streaming.events import file_stream

START = datetime(2024, 1, 1, tzinfo=UTC)


def test_restarted_stream_equals_batch(spark, tmp_path):
    some, at = random.Random(6), lambda h: START + timedelta(hours=h)
    rows = []
    for i in range(30):
        rows.append((f"m{i}", "create", at(some.randrange(10)), at(some.choice([6, 15, 400])) if i % 3 else None, None))
        rows += [(f"m{i}", some.choice(["confirm", "link", "link"]), at(some.randrange(40)), None, f"m{some.randrange(5)}") for _ in range(some.randrange(5))]
    rows += [("m3", "delete", at(2), None, None), ("late", "confirm", at(1), None, None), (None, "create", at(1), None, None)]
    some.shuffle(rows)
    parts = [rows[:40], rows[40:80], rows[80:] + [("clock", "create", at(300), None, None)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        query = state.changes(file_stream(spark, source, state.EVENT), "100 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination(120)

    for part in parts:  # each time a new query takes up the state of the one before
        spark.createDataFrame(part, state.EVENT).coalesce(1).write.mode("append").parquet(source)
        run()
    spark.createDataFrame([("clock", "confirm", at(300), None, None)], state.EVENT).coalesce(1).write.mode("append").parquet(source)
    run()  # timers fire under the watermark that the last batch left
    events = spark.read.schema(state.EVENT).parquet(source)
    wanted = sorted(map(tuple, state.settled(events, int(at(200).timestamp())).collect()))
    got = sorted(map(tuple, state.latest_change(spark.read.parquet(out)).collect()))
    assert got == wanted and {w[1] for w in wanted} == {"active", "expired", "deleted", "unknown"}
