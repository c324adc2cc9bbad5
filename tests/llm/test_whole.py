"""Cases in which a part of the job was once left out."""

import random
import re
import re._parser as sre
from itertools import product

import pytest

from trustloom.llm import decontaminate, html, licenses, pii


def test_templates_inside_articles_are_deleted(spark, monkeypatch):
    box = "<div class='x1'><p>Read our offers today</p></div>"
    own = [f"<p>Text number {k} <b>with</b> words</p><table><tr><td>yes</td><td>{k}</td></tr></table>" for k in range(8)]
    rows = [(k, "https://A.example:80/x" if k % 2 else "https://u@a.example/y z", f"<article>{p}{box}</article>") for k, p in enumerate(own)]
    rows += [(100 + k, "https://b.example/", "<article><p>One article copied</p></article>") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (200_000, 0):  # known templates broadcast, then joined
        monkeypatch.setattr(html, "MAX_TEMPLATES", most)
        got = {r.page_id: r.text for r in html.extract(pages).collect()}
        assert got == {k: f"Text number {k} with words\nyes\n{k}" for k in range(8)} | {100 + k: "One article copied" for k in range(8)}


def samples(tree) -> list[str]:
    """Texts of a pattern: every alternative, optional parts with and without."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            each = [chr(arg)]
        elif op == "IN":
            each = [chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1]) if str(arg[0][0]) != "CATEGORY" else "e"]
        elif op == "NOT_LITERAL":
            each = ["e"]
        elif op == "SUBPATTERN":
            each = samples(arg[3])
        elif op == "BRANCH":
            each = [s for branch in arg[1] for s in samples(branch)]
        else:
            least, most, inside = arg
            assert op == "MAX_REPEAT"
            each = [s * n for n in {least, min(most, least + 1)} for s in samples(inside)]
        out = [a + b for a, b in product(out, dict.fromkeys(each))]
    return list(dict.fromkeys(out))


def test_every_license_rule_finds_its_own_texts_and_no_near_miss(spark):
    rules = licenses.rules()
    assert len(rules) > 220 and len({p for _, _, p, _ in rules}) == len(rules)
    texts = []
    for label, gate, pattern, rank in rules:
        for text in dict.fromkeys(" ".join(t.split()) for t in samples(sre.parse(pattern))[:24]):
            assert gate & set(text.split()), (pattern, text)  # the prefilter lets every match through
            texts.append((label, text, rank, True))
        # without its keywords, or with a word between, the rule's text is not the rule's
        words = text.split()
        lost = " ".join(w for w in words if w not in gate)
        assert not re.search(pattern, "".join(f" {w} " for w in lost.split())), pattern
        if len(words) > 1 and "?" not in pattern and "[^ ]+" not in pattern:
            apart = [x for w in words for x in (w, "qq")]
            assert not re.search(pattern, "".join(f" {w} " for w in apart)), pattern
    docs = spark.createDataFrame([(k, f"zz {t} yy") for k, (_, t, *_) in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(docs).select("doc_id", "labels", "detections").collect():
        label, text, rank, _ = texts[r.doc_id]
        past = 1 + len(text.split())
        # the rule's own find, or one that suppresses it
        assert any(d.first <= 1 and d.past >= past and (d.label == label or d.rank >= rank) for d in r.detections), (label, text, r.detections)


def test_license_names_that_were_missed(spark):
    want = {"GPLv3": "gpl-3.0", "LGPLv2": "lgpl-2.1", "AGPLv3": "agpl-3.0", "PSF License": "python", "Open Software License": "osl", "European Union Public Licence": "eupl",
            "library general public license": "gpl,lgpl", "Creative Commons Zero": "cc0", "the Apache Software License": "apache", "Copyright 2019, 2020": "copyright",
            "licensed under the GPL": "gpl", "SPDX-License-Identifier: MIT": "mit", "Copyright 2020 Acme": "copyright", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
            "Licensed under the Apache License, Version 2.0": "apache-2.0", "nothing here": "", "the mitten and a gplx": "", "rights reserved": "", "permission to use": ""}
    docs = spark.createDataFrame(list(want.items()), "text string, want string")
    got = {r.text: r.labels for r in licenses.scan(docs).collect()}
    assert got == want


def test_license_base_columns_equal_brute_force(spark):
    rng = random.Random(8)
    bits = ["cc", "by", "CC BY", "general public license", "General", "Public License", "all rights reserved", "ALL", "rights", "réserved", "x", "-", "\n", "\t", "\U0001f600", "é", "9"]
    rows = [(k, rng.choice([" ", ", ", ""]).join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(300)] + [(None, "cc by"), (300, None), (301, ""), (302, "cc by " * 20_000), (302, "cc by")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Labels string")
    out = licenses.scan(docs)
    assert out.columns[:2] == ["doc_id", "text"] and "Labels" not in out.columns and licenses.scan(docs.limit(0)).count() == 0
    want = []
    for doc_id, text in rows:
        low = (text or "").translate({ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = [(k, label) for phrase, label in licenses.BASE for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
        starts = [k for k, _ in found]
        want.append((str(doc_id), len(words), len(found), str(min(starts, default=None)), str(max(starts, default=None)), ",".join(sorted({label for _, label in found}))))
    got = [(str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out.collect())


@pytest.mark.parametrize("text, kind, part", [
    *((f"write ann at mail dot {end} now", "email", f"ann at mail dot {end}") for end in ("nl", "it", "ca", "us", "co", "museum")),
    ("x a dot b dot c dot d dot e dot f dot g at h dot i dot j dot k dot l dot m dot n dot nl.", "email",
     "a dot b dot c dot d dot e dot f dot g at h dot i dot j dot k dot l dot m dot n dot nl"),
    ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
    ("host 192 dot 168.0 [dot] 1 up", "ip", "192 dot 168.0 [dot] 1"),
])
def test_spoken_addresses_of_any_ending_and_length(text, kind, part):
    assert [(k, text[s:e]) for k, s, e in pii.spans(text)[1]] == [(kind, part)]


@pytest.mark.parametrize("text", ["we met at noon. Then we left", "at home dot", "3 dot 5 of it"])
def test_plain_text_has_no_spoken_address(text):
    assert pii.spans(text)[1] == []


def test_spoken_scan_is_linear():
    assert pii.spans("a dot " * 100_000)[1] == pii.spans("a at " * 100_000)[1] == []


def test_partial_and_edited_passages_are_found():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    words = [word() for _ in range(56)]
    item, other = " ".join(words), " ".join(word() for _ in range(300))
    index = decontaminate.Index([(7, item), (8, " ".join(word() for _ in range(56)))])
    for start in range(len(item) - 62):  # 60 characters at least when the ends are trimmed
        assert index.matches(f"{other} | {item[start:start + 62]} | {other}")[0] == (7, 0)
    for shift in range(8):  # one word in eight replaced
        edited = " ".join(word() if k % 8 == shift else w for k, w in enumerate(words))
        assert [i for i, _ in index.matches(f"{other} {edited} {other}")] == [7]
    assert index.matches(other) == []
