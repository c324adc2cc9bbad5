"""SQL functions against the column functions."""

from pyspark.sql import functions as F

from trustloom.functions import detect, text, trust
from trustloom.operators import capture
from trustloom.plans import surface
from trustloom.plans.memories import NOW_S, memories
from trustloom.schema import tier_rank

SF = "/root/testdata/sf0.001"


def test_functions_equal_columns(spark):
    assert len(surface.register(spark)) == len(surface.functions())
    m = trust.signals(memories(spark, SF), F.lit(NOW_S)).cache()
    m.createOrReplaceTempView("tl_records")
    c = F.col
    wanted = m.select("memory_id", text.words(c("content")).alias("w"), F.array_sort(text.numbers(c("content"))).alias("n"), tier_rank(c("sensitivity")).alias("r"), trust.source_authority(c("source_type")).alias("a"),
                      c("tier_penalty").alias("p"), c("freshness").alias("f"), c("confirmation").alias("k"), c("trust").alias("t"), detect.contains_secret(c("content")).alias("s"))
    got = spark.sql(f"""SELECT memory_id, tl_words(content) AS w, tl_numbers(content) AS n, tl_tier_rank(sensitivity) AS r, tl_source_authority(source_type) AS a, tl_sensitivity_penalty(sensitivity) AS p,
      tl_freshness(({NOW_S} - created_s) / 86400D, (expires_s - created_s) / 86400D) AS f, tl_confirmation(confirmations) AS k,
      tl_trust(authority, freshness, confirmation, contradiction, tier_penalty, corrected) AS t, tl_has_secret(content) AS s FROM tl_records""")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    assert "BatchEvalPython" not in got._jdf.queryExecution().toString()


def test_table_functions_equal_operators(spark):
    surface.register(spark)
    said = spark.createDataFrame([("a", "api", "user: We moved on. Use pnpm now!\r\n - \nassistant:  Deploy this on Fly.  \nshort"), ("b", "api", None), ("c", "api", "")], "source_ref string, source_type string, text string")
    said.createOrReplaceTempView("tl_said")
    got = spark.sql("SELECT source_ref, s.line, s.part, s.chunk FROM tl_said, LATERAL tl_sentences(text) s")
    wanted = capture.sentences(said).select("source_ref", "line", "part", "chunk")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and wanted.count() == 3
    assert [tuple(r) for r in spark.sql("SELECT * FROM tl_grams('One two, three', 2) ORDER BY at").collect()] == [(0, "one two"), (1, "two three")]
    assert spark.sql("SELECT tl_jaccard(tl_words('a b c'), tl_words('b c d')) AS j").first().j == 0.5
