"""Operator 6: quotation linking of chat messages.

A line that starts with > marks is quoted, its level the number of marks. Runs of lines of
one level are passages: the quoted ones of a message, and its own paragraphs. Passages and
lines are normalised (lower case, white space runs one space, trimmed, blank lines part
passages), hashed, and joined within their conversation to the latest earlier message that
has the same as its own. A line counts only where its whole passage is no message's. A
message answers the earlier message that owns most of its quoted lines of the lowest level
found; ties go to the later message. Messages lose their quotes and get the root and the
depth of their reply chain: in the order of (root, turn) every message follows what it
answers.

The latest earlier owner is found as of the turn, in stretches of `STRETCH` turns, so that
a line that a whole conversation shares costs rows, never pairs, and no task holds them all.

Null texts count as empty, and the text of a message without lines of its own is empty.
Rows with a null conv_id or turn are returned unlinked, each its own root. Rows that share
(conv_id, turn) count as one message, share its links and give a row each. Texts of any
length are read whole. Other columns stay; those of the added columns' names, in any case,
are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.llm.common import cut, let, table, together

MARKS = r"^\s*(?:>\s?)+"
STRETCH = 1024


def _lines(text):
    """Array of (level, line) with the marks taken off."""
    level = lambda s: F.regexp_count(F.regexp_extract(s, MARKS, 0), F.lit(">"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda s: F.struct(level(s).alias("level"), F.regexp_replace(s, MARKS, "").alias("line")))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h, lines): each passage's level, its hash and its lines' hashes; own ones have level 0.

    Found within the row: lines are joined again with a mark between them and another where
    their kind changes, and parted at the marks.
    """
    flat = F.transform(_lines(F.col("text")), lambda x: F.struct(x["level"].alias("level"), F.trim(F.regexp_replace(F.lower(x["line"]), r"[\s\x02\x03]+", " ")).alias("line")))
    kind = lambda x: F.when(x["line"] == "", -1).otherwise(x["level"])
    fresh = lambda a, x, i: (i == 0) | (kind(F.get(a, i - 1)) != kind(x))
    start = lambda x: F.concat(F.lit("\x03"), kind(x).cast("string"), F.lit("\x02"))
    marked = let(flat, lambda a: F.array_join(F.transform(a, lambda x, i: F.concat(F.when(fresh(a, x, i), start(x)).otherwise(F.lit("\x02")), x["line"])), ""))
    runs = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.xxhash64("text").alias("m"), F.explode(F.split(marked, "\x03")).alias("run"))
    parts = F.split("run", "\x02")
    runs = runs.select("conv_id", "turn", "m", F.get(parts, F.lit(0)).try_cast("int").alias("level"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("lines")).filter("level >= 0")
    runs = runs.select("conv_id", "turn", "m", "level", F.xxhash64(F.array_join("lines", " ")).alias("h"), F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"))
    # rows that share a message's text say it once; a text may hold a passage several times
    again = messages.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn", F.xxhash64("text").alias("m")).count().filter("count > 1").select("conv_id", "turn", "m", "count")
    runs = runs.groupBy("conv_id", "turn", "m", "level", "h", "lines").agg(F.count("*").alias("times")).join(again, ["conv_id", "turn", "m"], "left")
    return runs.select("conv_id", "turn", "level", "h", "lines", (F.col("times") / F.coalesce("count", F.lit(1))).cast("long").alias("times"))


def owners(own: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (conv_id, h, turn, ...) with `owner`, the latest earlier turn that has the same h among own, where there is one."""
    key = ["conv_id", "h"]
    stretch = F.floor(F.col("turn") / STRETCH).alias("s")
    mine = own.select(*key, "turn").distinct().select(*key, "turn", stretch, F.col("turn").alias("own"))
    wanted = asked.select(*key, "turn").distinct().select(*key, "turn", stretch, F.lit(None).cast("long").alias("own"))
    every = mine.join(wanted.select(*key).distinct(), key, "left_semi").unionByName(wanted)  # parts that nobody quotes stay behind
    near = Window.partitionBy(*key, "s").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    last = every.groupBy(*key, "s").agg(F.max("own").alias("last")).withColumn("before", F.max("last").over(before)).drop("last")
    found = every.withColumn("near", F.max("own").over(near)).filter("own is null").join(last, [*key, "s"]).select(*key, "turn", F.coalesce("near", "before").alias("owner")).filter("owner is not null")
    return asked.join(found, [*key, "turn"])


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked): the message that each quoting message answers."""
    whole = cut(passages(messages))
    own, quoted = whole.filter("level = 0"), whole.filter("level > 0")
    by_passage = cut(owners(own, quoted))
    line = lambda df: df.select("conv_id", "turn", "level", "times", F.explode("lines").alias("h"))
    rest = owners(line(own), line(quoted.join(by_passage.select("conv_id", "turn", "h").distinct(), ["conv_id", "turn", "h"], "left_anti")))
    found = by_passage.select("conv_id", "turn", "owner", "level", (F.size("lines") * F.col("times")).alias("n")).unionByName(rest.select("conv_id", "turn", "owner", "level", F.col("times").alias("n")))
    found = found.groupBy("conv_id", "turn", "owner", "level").agg(F.sum("n").alias("n"))
    best = F.max(F.struct(-F.col("level"), "n", "owner"))
    return found.groupBy("conv_id", "turn").agg(best.alias("b"), F.sum("n").alias("n_linked")).select("conv_id", "turn", F.col("b.owner").alias("reply_to"), "n_linked")


def conversations(messages: DataFrame) -> DataFrame:
    """Add reply_to, root, depth, n_quoted, n_linked and own_text."""
    link = cut(links(messages))
    # pointer doubling: every round halves the distance to the root
    now = link.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        step = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        after = cut(now.join(step, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        now = after.drop("moved")
        if not after.filter("moved").limit(1).count():
            break
    lines = _lines(F.col("text"))
    own = F.regexp_replace(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    whole = F.struct(F.lit(None).cast("int").alias("_"), *[F.col(f"`{c}`") for c in messages.columns]).alias("_all")
    rows = messages.select(whole, "conv_id", "turn", F.size(F.filter(lines, lambda x: x["level"] > 0)).cast("long").alias("n_quoted"), own.alias("own_text"))
    out = rows.join(link.join(now, ["conv_id", "turn"]), ["conv_id", "turn"], "left").withColumns({
        "root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long")), "n_linked": F.coalesce("n_linked", F.lit(0).cast("long"))})
    return together(out, messages, ["reply_to", "root", "depth", "n_quoted", "n_linked", "own_text"])


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "turn", "role", "reply_to", "root", "depth", "n_quoted", "n_linked", "own_text")
