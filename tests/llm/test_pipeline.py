"""Every stage of the pipeline on its own input against brute force."""

import random
from array import array

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from trustloom.llm import decontaminate, pii, simhash  # noqa: E402
from tests.llm.test_decontaminate import brute  # noqa: E402
from tests.llm.test_simhash import least_reachable, texts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    found = texts(rng, 60)
    found = [t for t in found if not t or len(t) < 5000] + ["123 456", "mail ann at example dot org now", "key token = \"abcdef0123456789\" end"]
    return [(k if k % 13 else None, t, rng.choice(["en", "de", None]), "s", len(t or "")) for k, t in enumerate(found)]


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_language_stage_drops_texts_without_letters_alone(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert plain(out.drop("lang")) == sorted(repr((*r[:2], *r[3:])) for r in kept)
    given = {repr(r) for r in kept if r[2]}
    assert given <= set(plain(out)) and {r.lang for r in out.collect()} == {"en", "de"}  # found where none was given


def test_language_stage_without_labels_or_rows(spark, rows):
    bare = [(*r[:2], None, *r[3:]) for r in rows]
    docs = spark.createDataFrame(bare, SCHEMA)
    assert plain(corpus_pipeline.language(spark, docs, "")) == sorted(repr(r) for r in bare if r[1] and any(map(str.isalpha, r[1])))
    assert corpus_pipeline.language(spark, docs.limit(0), "").columns == docs.columns


def test_near_duplicate_stage_keeps_one_of_each(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = [frozenset(simhash.shingle_hashes(r[1], 5).tolist()) for r in rows]
    same = lambda a, b: a == b or (a | b and len(a & b) >= 0.8 * len(a | b))
    names = least_reachable(list(range(len(rows))), lambda i, j: same(sets[i], sets[j]))
    out = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    by_row = {repr(tuple(r)) for r in out}
    assert len(out) == len(set(names))
    assert {names[k] for k, r in enumerate(rows) if repr(r) in by_row} == set(names)


def test_decontamination_stage_equals_edit_distances(spark, rows, tmp_path):
    items = [(1, rows[20][1]), (None, rows[25][1]), (3, "no such passage stands in any of the rows here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [r for r in rows if not (r[1] and any(x and brute(x, r[1]) is not None for _, x in items))]
    assert 0 < len(want) < len(rows)
    assert plain(corpus_pipeline.decontaminated(spark, docs, str(tmp_path))) == sorted(map(repr, want))


def test_personal_data_stage_redacts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [(r[0], t := pii.redact_text(r[1]), *r[2:4], None if t is None else len(t)) for r in rows]
    assert any("[EMAIL]" in (w[1] or "") for w in want) and any("[SECRET]" in (w[1] or "") for w in want)
    assert plain(corpus_pipeline.redacted(spark, docs, "")) == sorted(map(repr, want))


def test_bpe_stage_equals_the_library(spark, rows):
    from tokenizers import Tokenizer
    from trustloom.llm import bpe

    library = Tokenizer.from_file(bpe.default_vocab())
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.ids, r.n_tokens, r.round_trip) for r in corpus_pipeline.encoded(spark, docs, "").collect())
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    assert got == sorted((str(r[0]), i, len(i), True) for r, i in zip(rows, ids))


def test_run_applies_all_stages_in_order(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[20][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(out) < len(rows) and all(r.round_trip and r.n_tokens for r in out)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "bpe"]
