"""Operator 12 against its SQL, and against a plain reading of chains and copies."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from trustloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, DEPTH int, k0 string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    of = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            of[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in of.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = turns.get(c - int(c / 20) * 20 and int(c / 20) * 20 if c % 20 else c, [])
        seq = base[:h] + own[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    name = lambda node: min(members[node])[0]
    ends = lambda node: ",".join(str(c) for c, n in sorted(members[node]) if n == len(node))
    return sorted((name(n), len(n), name(n[:-1]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n in members)


def found(spark, rows):
    got = trie.trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3))
    assert got.columns == list(NAMES)
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1]))


def random_rows(seed, least=0):
    some = random.Random(seed)
    say = lambda: (some.choice(["user", "assistant", None]), some.choice(["a", "b b", "", None, " c\x0bd é\xa0f "]))
    rows = [(c, some.choice([None, *range(5)]), *say()) for c in range(least, least + 130) for _ in range(some.randrange(1, 6)) if some.random() < 0.9]
    return rows + [rows[0], rows[1]] + [(None, 1, "user", "x")]


@pytest.mark.parametrize("seed, least", [(1, 0), (2, 1_000_000), (3, 15)])
def test_random_conversations(spark, monkeypatch, seed, least):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = random_rows(seed, least)
    assert found(spark, rows) == plain(rows)


def test_conversations_saved_as_they_grow(spark):
    """A chain of branches: every conversation has one turn more than the one before."""
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(40) for t in range(c + 1)]
    rows += [(20 * 100, t, "user", f"turn {t}") for t in range(25)] + [(20 * 101, t, "user", f"turn {t}" if t < 20 else "else") for t in range(24)]
    assert found(spark, rows) == plain(rows)


def test_copies_and_bare_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 3000, 20) for t in range(3)] + [(c, 0, "user", "one") for c in range(40_001, 40_016)]
    assert found(spark, rows) == plain(rows)


def test_of_nothing(spark):
    assert found(spark, []) == [] and found(spark, [(None, 0, "user", "x")]) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    wanted = db.sql(trie.ORACLE_SQL)
    assert sorted(map(tuple, trie.op12_trie(spark, sf).select(*NAMES).collect()), key=lambda r: (r[0], r[1])) == sorted(wanted.select(*NAMES).fetchall(), key=lambda r: (r[0], r[1]))
