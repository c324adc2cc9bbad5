"""Operator 2 against edit distances computed without any filter."""

import random

import numpy as np
import pytest

from trustloom.llm import decontaminate as D


def fewest_edits(pattern: str, text: str) -> int:
    """Edits between the whole pattern and the best stretch of the text."""
    t = np.array([ord(x) for x in text])
    cost = np.zeros(len(t) + 1, int)
    ramp = np.arange(len(t) + 1)
    for k, letter in enumerate(pattern):
        step = np.r_[k + 1, np.minimum(cost[:-1] + (t != ord(letter)), cost[1:] + 1)]
        cost = np.minimum.accumulate(step - ramp) + ramp
    return int(cost.min())


def brute(item: str, text: str):
    a, b = D.normalise(item), D.normalise(text)
    if len(a) < D.Q or not b:
        return None
    size = min(len(a), D.WINDOW)
    most = min(int(size * D.ERRORS), (size - D.Q) // D.Q)
    least = min(fewest_edits(a[s:s + size], b) for s in range(len(a) - size + 1))
    return least if least <= most else None


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "z", "q" + text[at]]) + text[at + 1:]
    return text


def test_equals_unfiltered_edit_distances():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate((2, 4, 5, 8, 14, 20, 30))] + [(90, ""), (91, None)]
    items.append((92, items[5][1]))  # a repeated item
    texts = [None, "", "ab", prose(60)]
    for _ in range(120):
        item = rng.choice(items[2:7])[1]
        a = rng.randrange(1 + len(item) // 4)
        texts.append(prose(rng.randint(0, 20)) + " " + edited(rng, item[a:a + rng.randint(30, 110)], rng.randint(0, 7)) + " " + prose(rng.randint(0, 20)))
    want = sorted((p, i, e) for p, t in enumerate(texts) for i, x in items if x and t and (e := brute(x, t)) is not None)
    assert len(want) > 40
    index = D.Index(items)
    assert index.scan(texts) == want
    assert sorted((p, i, e) for p, t in enumerate(texts) for i, e in index.matches(t)) == want


def test_long_texts_are_read_whole(monkeypatch):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    item, filler = prose(20), prose(3000)
    index = D.Index([(1, item)])
    monkeypatch.setattr(D, "PIECE", 500)
    for at in range(0, 2000, 37):
        assert index.matches(filler[:at] + " " + item[:70] + " " + filler[at:]) == [(1, 0)]
    assert index.matches("x" * 1_000_000) == []


@pytest.mark.parametrize("block_chars", [4_000_000, 100])
def test_rows_are_judged_by_their_own_text(spark, block_chars):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    bench = [(k, prose(20)) for k in range(4)] + [(None, prose(20)), (9, None)]
    clean = prose(40)
    rows = [(1, clean, "a"), (1, bench[0][1], "b"), (None, f"{clean} {bench[1][1]}", "c"), (None, clean, "d"), (2, None, "e"), (3, "", "f"), (4, bench[2][1], "g"), (4, bench[2][1], "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _KEY string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.edits) for r in D.contaminated(docs, items, block_chars).collect())
    assert got == [("1", 0, 0), ("4", 2, 0), ("4", 2, 0), ("None", 1, 0)]
    kept = D.drop_contaminated(docs, items, block_chars)
    assert kept.columns == docs.columns and sorted(r._KEY for r in kept.collect()) == ["a", "d", "e", "f"]
    assert D.contaminated(docs.limit(0), items).count() == D.contaminated(docs, items.limit(0)).count() == 0
