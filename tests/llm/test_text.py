"""Per-text functions against brute force and round trips."""

import random
import re
from array import array

import numpy as np
import pytest

from trustloom.llm import bpe, decontaminate, html, langid, pii, simhash, topk


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.default_vocab(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_bpe_equals_the_library(vocabulary, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocab())
    words = [" the", "the", " then", " of", "ing"]
    (tmp_path / "words").write_bytes(bpe.compile_lexicon({w.encode(): vocabulary.merge_word(w.encode()) for w in words}))
    coder = bpe.Encoder(vocabulary, str(tmp_path / "words"))
    for text in ["", "a<|endoftext|> b  \n\n x", "it's ééé   12345 😀 the then", "aaaa" * 500, " \t\n", "x" * 3000]:
        ids = array("i")
        ids.frombytes(coder.encode([text])[0])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert b"".join(vocabulary.bytes_of[i] for i in ids).decode() == text


def test_lexicon_holds_its_words_alone(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate("tap taps top tops stop stops a".split())}
    (tmp_path / "words").write_bytes(bpe.compile_lexicon(words))
    (tmp_path / "none").write_bytes(bpe.compile_lexicon({}))
    lexicon = bpe.Lexicon(str(tmp_path / "words"))
    assert lexicon.get(list(words)) == [array("i", ids).tobytes() for ids in words.values()]
    assert lexicon.get([b"", b"t", b"tapss", b"z"]) == [None] * 4
    assert bpe.Lexicon(str(tmp_path / "none")).get([b"a"]) == [None]


def test_bulk_merge_equals_single_merges(vocabulary):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé 1😀") for _ in range(rng.randint(0, 60))).encode() for _ in range(2000)]
    assert vocabulary.merge_words(words) == [array("i", vocabulary.merge_word(w)).tobytes() for w in words]
    assert vocabulary.merge_words([]) == []


def test_pii_base_equals_plain_expressions():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(5)
    for _ in range(5000):
        t = "".join(rng.choice("ab@.1 1+4-(") for _ in range(rng.randint(0, 40)))
        got = pii.detect(t)
        assert [x[1:] for x in got if x[0] == "email"] == [m.span() for m in email.finditer(t)]
        assert [x[1:] for x in got if x[0] == "phone"] == [m.span() for m in phone.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@pytest.mark.parametrize("text, kind, part", [
    ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("x [at] y [dot] org", "email", "x [at] y [dot] org"),
    ("call plus one five five five, one two three four five six seven", "phone", "plus one five five five, one two three four five six seven"),
    ("аdmin@exаmple.com yes", "email", "аdmin@exаmple.com"),
])
def test_pii_disguises_keep_offsets(text, kind, part):
    base, every = pii.spans(text)
    assert [(k, text[s:e]) for k, s, e in every] == [(kind, part)]
    assert pii.redact_text(text) == text.replace(part, f"[{kind.upper()}]")


def test_decontamination_finds_edited_passages_only():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    item = " ".join(word() for _ in range(40))
    other = " ".join(word() for _ in range(400))
    index = decontaminate.Index([(7, item)])
    half = len(other) // 2
    edited = item[:50] + "z" + item[51:]  # item[40:120] is a window, one letter off
    assert index.matches(f"{other[:half]} {item} {other[half:]}") == [(7, 0)]
    assert index.matches(f"{other[:half]} {edited[10:140]} {other[half:]}")[0][0] == 7
    assert index.matches(other) == [] and index.matches(None) == [] and decontaminate.Index([]).matches(other) == []


def test_html_main_text():
    page = ("<html><head><title>no</title></head><body><nav><li>menu</nav><div class=ad>buy</div><article><h1>T&amp;x</h1>"
            "<p>one  two<script>x</script></p><div class='comments'>hi</div><p>end</article><footer>f</footer>")
    assert html.main_text(page, ()) == "T&x\none two\nend"
    assert html.main_text(None, ()) == html.main_text("", ()) == ""
    body = html.parse("<div><span>Same box</span></div><div>Own words</div>")
    shared = [h for n, h in ((n, html.hashes(body).get(id(n))) for n in html.walk(body)) if h is not None and n.inside == ["Same box"]]
    assert len(shared) == 1
    assert html.main_text("<div><span>Same box</span></div><div>Own words</div>", set(shared)) == "Own words"


@pytest.mark.parametrize("page, text", [
    ('<article><h1 class="page-header">Title</h1><section id="related-work">Prior art</section><p>end', "Title\nPrior art\nend"),
    ('<main><p>Text</p><article class="comment">I disagree</article></main>', "Text"),
    ('<article><p>Text</p><div class="replies">me too</div><ul id="comments-list"><li>no</ul></article><article class="comment">hm</article>', "Text"),
    ('<body><div class="cookie-banner">accept</div><div class="shared-values">Our values</div><div class="ad">buy</div>tail', "Our values\ntail"),
    ('<article><p class="header">x</p><h2 class="header">Head</h2>a<br>b &eacute;&#233; &lt;c></article>', "Head\na\nb éé <c>"),
    ("<p>one<p>two<!-- <p>no --><template><p>no</template><textarea>no</textarea>", "one\ntwo"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("plain  text &amp; no tags <", "plain text & no tags <"),
])
def test_html_names_and_marks(page, text):
    assert html.main_text(page, ()) == text


def test_html_rows_of_every_kind(spark):
    rows = [(1, "http://a/x", None, "t"), (2, None, "", "t"), (3, "http://[bad", "<p>x" * 60_000, "t"), (4, "http://a/x", "<p>same", "t"), (4, "http://a/x", "<p>same", "t"), (None, "http://a/y", "<p>same", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    out = html.extract(pages)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = {(str(r.page_id), r.text[:4], r.n_chars) for r in out.collect()}
    assert got == {("1", "", 0), ("2", "", 0), ("3", "x\nx\n", 119_999), ("4", "same", 4), ("None", "same", 4)} and out.count() == 6
    assert html.extract(pages.limit(0)).count() == 0


def test_language_id_on_two_scripts():
    texts = ["the cat and the dog"] * 5 + ["der hund und die katze"] * 5
    names, matrix, bias = langid.fit(np.packbits(np.stack([langid.presence(t) for t in texts]), axis=1), ["en"] * 5 + ["de"] * 5)
    x = langid.presence("und die maus")
    assert names[int((x @ matrix / np.sqrt(x.sum()) + bias).argmax())] == "de"
    assert not langid.has_letter("12 !") and not langid.has_letter(None)


def test_forest_connects_like_brute_force():
    rng = np.random.default_rng(3)
    bits = np.array([0b111, 0, 0b1111111, 1 << 40, (1 << 40) | 0b11], np.uint64)
    assert len(simhash.forest(bits)) == 4
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    assert simhash.forest(rng.integers(0, 1 << 62, 3).astype(np.uint64)) == []


def test_ball_tree_search_is_exact():
    rng = np.random.default_rng(4)
    x, ids = rng.integers(-40, 40, (3000, 5)), np.arange(3000)
    s, i = np.full((20, 10), topk.LEAST), np.full((20, 10), -1)
    topk.search(x, ids, x[:20], ids[:20], 10, s, i)
    for q in range(20):
        all_ = sorted(((-int(x[q] @ x[j]), j) for j in range(3000) if j != q))[:10]
        assert [(-a, j) for a, j in all_] == list(zip(s[q].tolist(), i[q].tolist()))


def test_pii_query_counts_kinds_and_hashes_spans(spark, tmp_path):
    import hashlib

    rows = [(1, "write ann@x.org or +44 20 7946 0958, host 10.0.0.7"), (2, None), (3, ""), (3, ""), (None, "card 4111111111111111")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    want = set()
    for doc_id, text in rows:
        base = pii.spans(text)[0]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.add((doc_id, *(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")), hashlib.sha256(line.encode()).hexdigest()))
    assert got == want and (1, 1, 1, 0, 1) in {g[:5] for g in got}


def test_bpe_query_equals_the_library(spark, tmp_path):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocab())
    library.no_truncation()
    library.no_padding()
    texts = [None, "", "the cat the cat the cat", "the cat the cat the cat", "naïve \U0001f600 <|endoftext|>\n\n  x", "ab " * 400_000, "z" * 20_000, "Ünïcode\u2003space\r\n\tq"]
    rows = [(k if k != 3 else None, t, "other") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((str(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.op1_bpe_roundtrip(spark, str(tmp_path)).collect()) == sorted(want)
    out = bpe.encode(docs, bpe.default_vocab())
    assert out.columns == ["doc_id", "text", "ids"] and bpe.encode(docs.limit(0), bpe.default_vocab()).count() == 0
