"""Chunks of bounded size: paragraphs, lines, words, hard cuts; packed greedily, with the last chunk's tail before each.

All in column functions: the packing is a fold over an array, so a text stays one row
until its chunks are laid out, and no chunk depends on another row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, OVERLAP = 1000, 100  # fixed values


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _packed(pieces: Column, budget: int, glue: str) -> Column:
    """Neighbours joined by glue as long as they fit the budget."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc, x):
        fits = F.length(acc["now"]) + 1 + F.length(x) <= budget
        return F.when(acc["now"] == "", F.struct(acc["out"].alias("out"), x.alias("now"))).when(
            fits, F.struct(acc["out"].alias("out"), F.concat(acc["now"], F.lit(glue), x).alias("now"))).otherwise(
            F.struct(F.concat(acc["out"], F.array(acc["now"])).alias("out"), x.alias("now")))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))


def _words(line: Column, budget: int) -> Column:
    """An over-long line in pieces: words packed by a blank, over-long words cut (and packed with nothing)."""
    words = F.filter(F.split(line, " "), lambda w: w != "")
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / budget).cast("int")), lambda k: F.struct(F.substr(w, k * budget + 1, F.lit(budget)).alias("w"), F.lit(True).alias("alone")))
    parts = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > budget, cut(w)).otherwise(F.array(F.struct(w.alias("w"), F.lit(False).alias("alone"))))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc, x):
        flushed = F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"])))
        return F.when(x["alone"], F.struct(F.concat(flushed, F.array(x["w"])).alias("out"), F.lit("").alias("now"))).when(
            acc["now"] == "", F.struct(acc["out"].alias("out"), x["w"].alias("now"))).when(
            F.length(acc["now"]) + 1 + F.length(x["w"]) <= budget, F.struct(acc["out"].alias("out"), F.concat(acc["now"], F.lit(" "), x["w"]).alias("now"))).otherwise(
            F.struct(flushed.alias("out"), x["w"].alias("now")))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))


def pieces(text: Column, budget: int) -> Column:
    """Whole paragraphs that fit, else their lines, else their words."""
    full = lambda parts: F.filter(F.transform(parts, _strip), lambda p: p != "")
    of_line = lambda line: F.when(F.length(line) <= budget, F.array(line)).otherwise(_words(line, budget))
    of_paragraph = lambda p: F.when(F.length(p) <= budget, F.array(p)).otherwise(F.flatten(F.transform(full(F.split(p, "\n")), of_line)))
    return F.flatten(F.transform(full(F.split(text, r"\n[ \t]*\n")), of_paragraph))


def chunks(text: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Array of chunks of at most `most` characters; blank texts have none."""
    if most <= 0 or overlap < 0 or overlap >= most:
        raise ValueError("most must be positive and overlap between 0 and most")
    budget = max(1, most - overlap - (1 if overlap else 0))
    whole = _strip(F.coalesce(text, F.lit("")))

    def lay(t):
        packed = _packed(pieces(t, budget), budget, "\n")
        if overlap:
            packed = F.get(F.transform(F.array(packed), lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.right(F.get(p, i - 1), F.lit(overlap)), F.lit("\n"), x)))), F.lit(0))
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(packed)

    return F.get(F.transform(F.array(whole), lay), F.lit(0))


def chunked(rows: DataFrame, text: str = "text", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """A row for every chunk, with chunk_index from 0."""
    return rows.select("*", F.posexplode(chunks(F.col(text), most, overlap)).alias("chunk_index", "chunk"))
