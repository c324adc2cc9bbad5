"""Operator 13 against a reading of every text by both libraries, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers

from trustloom.llm import align

SCHEMA = "doc_id long, text string, UID string, bucket int"
ODD = ["", None, " ", "  two  spaces ", "a\tb\n\n c\r\n d", "x;\r y\r", "▁ under ▁score", "é ﬁ 한국어 日本 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x41>", " x   y　z", "a\x00b \x1c c\x85d",
       "don't I'll we've 's 'S", "!!!   ???\n\t\n end\t", "\n\nstart", "ab" * 3000, " " * 400 + "x", "12345 67 8.9e10", "the the the", "the the the", "﻿bom", "tab\t\ttab \t x"]


def plain(texts):
    """Rows by the libraries; corpus counts in dictionaries."""
    a_path, b_path = align.default_vocabs()
    a, b = tokenizers.Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    a.no_truncation(), a.no_padding()
    marks = align._byte_of_mark()
    rows, docs_of = [], Counter()
    for text in texts:
        row = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": Counter(), "said": ""}
        rows.append(row)
        if not text:
            continue
        whole, ids, pieces = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(marks[m] for m in a.id_to_token(i)) for i in ids]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        if b"".join(ta) != whole or b"".join(tb) != whole:
            continue
        groups, i, j, ga, gb, ea, eb = [], 0, 0, [], [], 0, 0
        while i < len(ids) or j < len(pieces):
            if ea <= eb and i < len(ids):
                ga.append(i)
                ea += len(ta[i])
                i += 1
            else:
                gb.append(j)
                eb += len(tb[j])
                j += 1
            if ea == eb and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        spans = lambda tokens: [(sum(map(len, tokens[:k])), sum(map(len, tokens[:k + 1]))) for k in range(len(tokens))]
        sa, sb = spans(ta), spans(tb)
        for ga, gb in groups:
            for x in ga:
                for y in gb:
                    if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]:
                        row["links"][ids[x], pieces[y]] += 1
        row |= {"n_a": len(ids), "n_b": len(pieces), "n_groups": len(groups), "said": ";".join(",".join(str(ids[x]) for x in ga) + "|" + ",".join(str(pieces[y]) for y in gb) for ga, gb in groups)}
        docs_of.update(row["links"].keys())
    most = defaultdict(int)
    for (x, _), n in docs_of.items():
        most[x] = max(most[x], n)
    return [(r["n_a"], r["n_b"], r["n_groups"], sum(r["links"].values()), sum(m for p, m in r["links"].items() if docs_of[p] == most[p[0]]), sum(m * docs_of[p] for p, m in r["links"].items()),
             hashlib.sha256(r["said"].encode()).hexdigest() if r["said"] else "") for r in rows]


def texts():
    some, alphabet = random.Random(5), ["a", "b", "the", " ", " ", "\n", "\t", "\r", "é", "▁", "'s", "9", ".", "!", " ", "ing", "日", ";", "<", "|", "🙂", "  ", "\x1d"]
    return ODD + ["".join(some.choices(alphabet, k=some.randrange(1, 60))) for _ in range(150)] + ["".join(some.choices(alphabet[:5] + alphabet[11:14], k=40)) for _ in range(60)]


@pytest.mark.parametrize("flush, slice_", [(align.FLUSH, align.SLICE), (300, 100)])
def test_as_both_libraries(spark, monkeypatch, flush, slice_):
    monkeypatch.setattr(align, "FLUSH", flush)
    monkeypatch.setattr(align, "SLICE", slice_)
    monkeypatch.setattr(align, "READ", 7)
    given = texts()
    rows = [(i % 5 if i % 7 else None, t, "u", 3) for i, t in enumerate(given)]
    wanted = sorted((str(r[0]), *w) for r, w in zip(rows, plain(given)))
    got = align.aligned(spark.createDataFrame(rows, SCHEMA).repartition(3), *align.default_vocabs()).collect()
    assert sorted((str(g.doc_id), g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups_sha256) for g in got) == wanted


def test_of_nothing(spark):
    assert align.aligned(spark.createDataFrame([], SCHEMA), *align.default_vocabs()).collect() == []


def test_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    wanted = sorted((r.doc_id, *w) for r, w in zip(rows, plain([r.text[:3000] if r.text else r.text for r in rows])))
    docs = spark.createDataFrame([(r.doc_id, r.text[:3000] if r.text else r.text) for r in rows], "doc_id long, text string")
    got = align.aligned(docs, *align.default_vocabs()).collect()
    assert sorted((g.doc_id, g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups_sha256) for g in got) == wanted
