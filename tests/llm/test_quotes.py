"""Operator 6 against a plain reading of every thread."""

import random
import re
from collections import Counter

import pytest

from trustloom.llm import quotes


def read(text):
    """(level, line) of every line, marks off."""
    out = []
    for raw in re.split("\r?\n", text or ""):
        marks = re.match(quotes.MARKS, raw)
        out.append((marks.group().count(">") if marks else 0, raw[marks.end():] if marks else raw))
    return out


def runs(text):
    """[(level, [normalised lines])]; blank lines part runs."""
    out, last = [], None
    for level, line in read(text):
        line = " ".join(line.lower().split())
        kind = level if line else -1
        if line:
            if kind != last:
                out.append((level, []))
            out[-1][1].append(line)
        last = kind
    return out


def brute(rows):
    """(conv, turn) -> (reply_to, n_linked)."""
    of = {}
    for conv, turn, text in rows:
        if conv is not None and turn is not None:
            of.setdefault((conv, turn), set()).add(text)
    own = {k: ({" ".join(ls) for t in ts for lv, ls in runs(t) if lv == 0}, {x for t in ts for lv, ls in runs(t) if lv == 0 for x in ls}) for k, ts in of.items()}
    out = {}
    for (conv, turn), ts in of.items():
        latest = lambda part, which: max((t for (c, t), o in own.items() if c == conv and t < turn and part in o[which]), default=None)
        votes = Counter()
        for t in ts:
            for level, ls in runs(t):
                if level and (found := latest(" ".join(ls), 0)) is not None:
                    votes[found, level] += len(ls)
                elif level:
                    for x in ls:
                        if (one := latest(x, 1)) is not None:
                            votes[one, level] += 1
        if votes:
            out[conv, turn] = (max((-lv, n, o) for (o, lv), n in votes.items())[2], sum(votes.values()))
    return out


@pytest.mark.parametrize("stretch", [1024, 3])
def test_threads_equal_a_plain_reading(spark, monkeypatch, stretch):
    monkeypatch.setattr(quotes, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(25):
            lines = [rng.choice(["thanks", "I agree", "No way", f"point {rng.randint(0, 9)}", "  Spaced   out "]) for _ in range(rng.randint(0, 3))]
            for _ in range(rng.randint(0, 2)):
                if said:
                    source = rng.choice(said).split("\n")
                    a = rng.randrange(len(source))
                    lines += ["> " + x if rng.random() < 0.9 else ">>" + x for x in source[a:a + rng.randint(1, 4)]] + [rng.choice(["", "ok then"])]
            text = "\n".join(lines)
            said.append(text)
            rows.append((conv, turn, text))
    rows += [(0, 7, "thanks"), (0, 7, "thanks"), (None, 1, "> thanks"), (1, None, "> thanks"), (50, 0, None), (50, 1, ""), (50, 2, "> " * 500 + "deep"), (51, 0, "long line\n" * 30_000), (51, 1, "> long line\n" * 30_000)]
    messages = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, text string, ROOT string, _all int")
    out = quotes.conversations(messages)
    assert out.columns == ["conv_id", "turn", "text", "_all", "reply_to", "root", "depth", "n_quoted", "n_linked", "own_text"]
    want = brute(rows)
    got = out.collect()
    assert len(got) == len(rows) and len(want) > 40
    for r in got:
        reply, n = want.get((r.conv_id, r.turn), (None, 0))
        assert (r.reply_to, r.n_linked) == (reply, n), r
        at, depth = r.turn, 0
        while (r.conv_id, at) in want:
            at, depth = want[r.conv_id, at][0], depth + 1
        assert (r.root, r.depth) == (at, depth)
        assert r.n_quoted == sum(lv > 0 for lv, _ in read(r.text)) and r.own_text == "\n".join(x for lv, x in read(r.text) if lv == 0).strip()
    assert quotes.conversations(messages.limit(0)).count() == 0
