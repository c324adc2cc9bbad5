"""Which texts hold one of many strings: an Aho-Corasick automaton, one a worker and block of strings, one pass a text."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.frames import reachable, settle

BLOCK = 200_000  # strings of an automaton
_HELD: dict[str, object] = {}


def automaton(key: str, strings: list[str]):
    """Built once by a worker for each block; only the last is kept."""
    if key not in _HELD:
        import ahocorasick

        _HELD.clear()
        made = ahocorasick.Automaton()
        for s in strings:
            made.add_word(s, None)
        made.make_automaton()
        _HELD[key] = made
    return _HELD[key]


def holders(rows: DataFrame, key: str, text: str, strings: DataFrame) -> DataFrame:
    """The distinct `key`s of rows whose text holds one of the strings (a column of a frame). Empty and null strings are held by none.

    The strings, a stated list, pass through the driver in blocks of `BLOCK`; one block leaves before the next comes.
    """
    spark = rows.sparkSession
    reachable(spark)
    name = strings.columns[0]
    distinct = settle(strings.filter(F.col(name) != "").select(F.col(name).alias("s")).distinct())
    blocks = max(1, -(-distinct.count() // BLOCK))
    given = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    shape, out = f"key {given.schema['key'].dataType.simpleString()}", None
    for block in range(blocks):
        mine = distinct if blocks == 1 else distinct.filter(F.pmod(F.xxhash64("s"), F.lit(blocks)) == block)
        sent, called = spark.sparkContext.broadcast([r.s for r in mine.collect()]), uuid.uuid4().hex

        def run(batches, sent=sent, called=called):
            for batch in batches:
                found = automaton(called, sent.value) if sent.value else None
                hit = [found is not None and next(found.iter(t), None) is not None for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], ["key"])

        part = given.mapInArrow(run, shape).distinct()
        part = settle(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out.distinct() if blocks > 1 else out
