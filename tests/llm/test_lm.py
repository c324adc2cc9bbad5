"""Operator 7 against brute-force counts and sums."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from trustloom.llm import lm


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdefgéß*") for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(20)]
    rows = [(k, " ".join(rng.choice(common) if rng.random() < 0.8 else word() for _ in range(rng.randint(0, 40)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\r\n"), (n + 3, "The THE the É É x " * 3000), (n + 3, "The"), (n + 3, "The"), (None, "a b")]


def folds(rows):
    import zlib

    return [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]


def symbols(rows):
    seen = Counter()
    for _, text in rows:
        seen.update([*lm.tokens(text), b""])
    total = sum(seen.values())
    head = sorted(((w, n) for w, n in seen.items() if n * lm.HEAD_SHARE >= total), key=lambda x: (-x[1], x[0]))
    kind_n, kind_words = np.zeros(lm.KINDS), np.zeros(lm.KINDS)
    for w, n in seen.items():
        if w and n * lm.WORD_SHARE < total:
            kind_n[lm.kind_of(w)] += n
            kind_words[lm.kind_of(w)] += 1
    return seen, lm.Symbols([w for w, _ in head], np.array([n for _, n in head], np.int64), kind_n, kind_words, total, len(seen))


def test_probabilities_sum_to_one():
    rows = corpus(random.Random(1), 200)
    _, s = symbols(rows)
    trainer = lm.Trainer(lm.first_model(s), lm.first_model(s))
    sequences = [s.encode(t)[0] for _, t in rows]
    trainer.texts(sequences)
    every = np.flatnonzero(s.real)
    logs = lm.log_probabilities(trainer.p, [np.array([sequences[3][0], x], np.uint16) for x in every]) - lm.log_probabilities(trainer.p, [sequences[3][:1]])
    assert abs((10 ** logs).sum() - 1) < 1e-3
    # a longer text's score is the sum over its own places, however texts are laid side by side
    one = [lm.log_probabilities(trainer.p, [x])[0] for x in sequences]
    assert np.allclose(one, lm.log_probabilities(trainer.p, sequences), atol=1e-4)


@pytest.mark.parametrize("head, own", [(1_000_000, 32_768), (50, 20), (1, 1)])
def test_columns_equal_brute_force(spark, monkeypatch, head, own):
    """Words that travel, words that are joined, and words of a kind give the same base columns."""
    monkeypatch.setattr(lm, "HEAD_SHARE", head)
    monkeypatch.setattr(lm, "WORD_SHARE", own)
    rows = corpus(random.Random(2), 120)
    held = folds(rows)
    docs = spark.createDataFrame([(k, t, "x", 5, h) for (k, t), h in zip(rows, held)], "doc_id long, text string, _ROW string, Score int, held boolean")
    out = lm.score(docs, "not held")
    assert out.columns == ["doc_id", "text", "_ROW", "held", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    seen, _ = symbols([r for r, h in zip(rows, held) if not h])
    total = sum(seen.values())
    want = []
    for doc_id, text in rows:
        words = [*lm.tokens(text), b""]
        want.append((str(doc_id), str(text), len(words), sum(w in seen for w in words), total, sum(math.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in words)))
    got = sorted((str(r.doc_id), str(r.text), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isfinite(g[6]) and g[6] < 0
    assert sum(g[6] for g in got) > sum(g[5] for g in got)


def test_score_is_the_sum_over_places(spark, monkeypatch):
    """Each token's symbol by softmaxes over the groups and over the group, one by one, and the word's share of its kind."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(lm, "train", lambda encoded, s: {k: (v + rng.normal(0, 0.4, v.shape) * (v > -1e3)).astype(np.float32) for k, v in lm.first_model(s).items()} | models.setdefault("kept", {}))
    models, rows = {}, corpus(random.Random(4), 30)[:30]
    seen, s = symbols(rows)
    fixed = lm.train(None, s)
    models["kept"] = fixed
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), "true").collect()}
    width = fixed["q"].shape[1]
    for doc_id, text in rows:
        at, _, share, *_ = s.encode(text)
        before, total = [0] * lm.CONTEXT, 0.0
        for x in at.tolist():
            h = sum(fixed["r"][before[-1 - j]].astype(float) * fixed["c"][j] for j in range(lm.CONTEXT))
            g, groups = x // width, fixed["qg"] @ h + fixed["bg"]
            inside = fixed["q"][g] @ h + fixed["b"][g]
            total += groups[g] - np.log(np.exp(groups).sum()) + inside[x % width] - np.log(np.exp(inside).sum())
            before.append(x)
        assert math.isclose(got[doc_id], total / math.log(10) + share, rel_tol=1e-3, abs_tol=1e-2)


def test_every_position_is_learnt_from():
    rows = corpus(random.Random(1), 300)
    _, s = symbols(rows)
    sequences = [s.encode(t)[0] for _, t in rows]
    trainer = lm.Trainer(lm.first_model(s), lm.first_model(s))
    before = lm.log_probabilities(trainer.p, sequences).sum()
    for _ in range(3):
        trainer.texts(sequences)
    assert trainer.weight == 3 * sum(map(len, sequences)) and lm.log_probabilities(trainer.p, sequences).sum() > before


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, "false").collect()}
    assert got[1].train_tokens == got[1].n_known == 0 and got[1].base_score == 0 and math.isfinite(got[1].score)
    assert lm.score(docs.limit(0), "true").count() == 0
