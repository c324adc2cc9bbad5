"""Operator 10 and the pipeline's grouping against all pairs."""

import random

import numpy as np
import pytest

from trustloom.llm import simhash
from trustloom.llm.common import cut_few


def least_reachable(names, linked):
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    out = []
    for i in range(len(names)):
        ids = [n for k, n in enumerate(names) if find(k) == find(i) and n is not None]
        out.append(min(ids) if ids else None)
    return out


def texts(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    out = [None, "", " \t", "one", "One", "one two three four", "long text " * 120_000]
    for _ in range(n):
        if len(out) > 12 and rng.random() < 0.6:
            words = (rng.choice(out[7:]) or "x").split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        else:
            out.append(" ".join(word() for _ in range(rng.randint(1, 150))))
    return out + [out[9]] * 12


@pytest.mark.parametrize("split_at", [4096, 3])
def test_components_equal_all_pairs(spark, split_at):
    rng = random.Random(3)
    rows = [(k * 7 % 1000 if k % 11 else None, t, "z") for k, t in enumerate(texts(rng, 150))]
    rows.append(rows[8])
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP string")
    prints = [simhash.fingerprint(t) for _, t, _ in rows]
    want = least_reachable([r[0] for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.near_duplicates(docs, split_at=split_at).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=r[0], fp=p, component_id=c)) if False else f"Row(doc_id={r[0]}, fp={p}, component_id={c})" for r, p, c in zip(rows, signed, want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_bits_by_counting():
    import xxhash

    text = "A b\tc  d e f g a b c d"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(len(words) - 3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_one_of_each_group_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k if k % 9 else None, t, f"s{k}") for k, t in enumerate(texts(rng, 120))]
    rows += [(3000, "a clean text under an id that is used again", "p"), (3000, "and quite another text under the same one", "q"), rows[10], rows[10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ALL string")
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for _, t, _ in rows]
    same = lambda a, b: a == b or (a | b and len(a & b) >= 0.8 * len(a | b))
    want = least_reachable(list(range(len(rows))), lambda i, j: same(sets[i], sets[j]))
    groups: dict = {}
    for k, c in enumerate(want):
        groups.setdefault(c, []).append(k)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(groups)
    least = lambda ks: min(ks, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for ks in groups.values():
        best = rows[least(ks)][0]
        assert any((best, rows[k][1]) in got for k in ks if rows[k][0] == best)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_groups_keep_links_that_a_bucket_s_first_do_not_show(spark, monkeypatch):
    """Texts in one bucket that are unlike its first and its last, but like one another."""
    rng = random.Random(9)

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(10, 190, 6), n):
            words[at] = f"x{rng.randrange(10 ** 9)}"
        return " ".join(words)

    pool = [changed([f"w{g}_{k}" for k in range(200)], 2) for g in range(12) for _ in range(3)]
    monkeypatch.setattr(simhash, "_bands", lambda h: np.zeros(1, np.uint64))  # all in one bucket
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in pool]
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = least_reachable(list(range(len(pool))), like)
    ids = [xxhash_of(t) for t in pool]
    lo, hi = min(range(len(ids)), key=ids.__getitem__), max(range(len(ids)), key=ids.__getitem__)
    shown = least_reachable(list(range(len(pool))), lambda i, j: {lo, hi} & {i, j} and like(i, j))
    assert len(set(want)) < len(set(shown))
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string"))
    assert kept.count() == len(set(want))


def test_parts_of_a_bucket_meet_without_a_row_a_pair(spark, monkeypatch):
    """Groups of texts in one bucket, of several tiles: grouped as all pairs would, with rows that grow with the bucket only."""
    rng = random.Random(5)

    def changed(words):
        words = list(words)
        for at in rng.sample(range(10, 190, 6), 2):
            words[at] = f"x{rng.randrange(10 ** 9)}"
        return " ".join(words)

    pool = [changed([f"w{g}_{k}" for k in range(200)]) for g in range(16) for _ in range(5)]
    monkeypatch.setattr(simhash, "_bands", lambda h: np.zeros(1, np.uint64))  # all in one bucket
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    held, whole = [], simhash._jaccard_links
    monkeypatch.setattr(simhash, "_jaccard_links", lambda pairs, *rest: held.append(pairs.count()) or whole(pairs, *rest))
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in pool]
    want = least_reachable(list(range(len(pool))), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    named = simhash.alike(spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string"))
    least = {}
    got = {r.doc_id: r._root for r in named.collect()}
    for k in sorted(got):
        least.setdefault(got[k], k)
    assert [least[got[k]] for k in range(len(pool))] == want
    assert sum(held) <= 3 * len(pool)  # 3,040 pairs are across the groups


def xxhash_of(text):
    import xxhash

    return np.array([xxhash.xxh64_intdigest(np.unique(simhash.shingle_hashes(text, 5)).tobytes(), 5)], np.uint64).view(np.int64)[0]


def test_all_pairs_within_four_bits():
    bits = np.array([0, 1, 0b11111, 0b11110, 1 << 63], np.uint64)
    want = [(i, j) for i in range(5) for j in range(i + 1, 5) if (int(bits[i]) ^ int(bits[j])).bit_count() <= 4]
    assert simhash.every_pair(bits) == want and len(simhash.forest(bits)) < len(want)


def test_few_links_take_few_parts(spark):
    """Every part writes files of its own in every later shuffle: 211 parts of some links each once took the disk."""
    chains = [(10 * k + i, 10 * k + i + 1) for k in range(30) for i in range(9)]
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = simhash.components(spark.createDataFrame(chains, "a long, b long").repartition(40))
        assert found.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, found.collect())) == [(10 * k + i, 10 * k) for k in range(30) for i in range(1, 10)]
        assert cut_few(spark.range(1000).repartition(40), rows=100).rdd.getNumPartitions() == 10
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
