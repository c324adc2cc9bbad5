"""Operator 8: license scan by ordered signature rules, in DataFrame functions only.

Texts are lower-cased (A-Z) and reduced to words. One keyword prefilter finds the rules'
keywords in a single pass; only texts that hold one are scanned, and only by the rules of
the keywords they hold.
A detection inside another of the same or a higher priority is suppressed. The three
base phrases are counted apart and their labels always stay.

Null texts count as empty: no words, no labels, score 0. Whole texts are scanned, of any
length. Repeated rows give repeated results, empty tables empty ones. Detections that tie
in place and priority are ordered by label, and all but the first are suppressed. Other
columns stay; those of the added columns' names, in any case, are replaced.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm import signatures
from trustloom.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

PRIORITIES = 4
STRETCH = 300


def rules() -> list[tuple[str, frozenset[str], str, int]]:
    """(label, keywords, pattern, priority) of every signature, higher priorities first."""
    return [(label, signatures.keywords(pattern), signatures.compiled(pattern), rank) for label, rank, pattern in signatures.lines()]


def _rule_map() -> tuple[list[str], Column]:
    """(keywords, map from keyword to its rules)."""
    of_word: dict[str, list] = {}
    for label, rank, pattern in signatures.lines():
        rule = F.struct(F.lit(label).alias("label"), F.lit(signatures.compiled(pattern)).alias("pattern"), F.lit(f"({signatures.compiled(pattern, True)})").alias("numbered"), F.lit(rank).alias("rank"))
        for word in signatures.keywords(pattern):
            of_word.setdefault(word, []).append(rule)
    words = sorted(of_word)
    return words, F.create_map(*[x for w in words for x in (F.lit(w), F.array(*of_word[w]))])


def _n_words(spaced: Column) -> Column:
    """Words of a piece in which every word stands between two spaces of its own."""
    return F.shiftright(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))), 1)


def with_words(docs: DataFrame) -> DataFrame:
    """(`_in0`, `_in1`, ..., `_norm`, n_words): the columns as they are; the words, each between two spaces of its own."""
    docs = docs.select(*[F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(docs.columns)], F.col("text").alias("_text"))
    low = F.translate(F.coalesce(F.col("_text"), F.lit("")), UPPER, LOWER)
    flat = F.trim(F.regexp_replace(low, NOT_WORD, "  "))
    norm = F.concat(F.lit(" "), flat, F.lit(" "))
    # a generator keeps the optimiser from writing the expression out at each of its uses
    once = docs.select("*", F.explode(F.array(norm)).alias("_norm"))
    once = once.withColumn("_norm", F.when(F.col("_norm") == "  ", F.lit("")).otherwise(F.col("_norm")))
    return once.withColumn("n_words", _n_words(F.col("_norm")).cast("long"))


def _spaced(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def scan(docs: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, detections and score.

    detections: array of (label, priority, first, past) in words from 0, none suppressed.
    """
    df = with_words(docs)
    norm = F.col("_norm")
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        mark = _spaced(phrase)
        held = F.contains(norm, F.lit(mark))
        n = F.floor((F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(mark), F.lit("")))) / len(mark))
        places.append(F.when(held, n.cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(held, _n_words(F.substring_index(norm, mark, 1)).cast("long")))
        after = _n_words(F.substring_index(norm, mark, -1)).cast("long")
        lasts.append(F.when(held, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    df = df.withColumns({
        "n_base": sum(places[1:], places[0]),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "_base": F.array_sort(F.array_compact(F.array(*labels))),
    })
    words, rule_map = _rule_map()
    by_letter = "|".join(f"{k}(?:{'|'.join(w[1:] for w in group)})" for k, group in groupby(words, lambda w: w[0]))
    found_words = F.array_distinct(F.regexp_extract_all(norm, F.lit(f" ({by_letter})(?= )"), F.lit(1)))
    df = df.select("*", F.explode(F.array(found_words)).alias("_words"))
    gate = F.size("_words") > 0
    chosen = F.filter(F.array_distinct(F.flatten(F.transform("_words", lambda w: F.element_at(rule_map, w)))), lambda r: F.regexp_like(norm, r["pattern"]))

    # only texts with a match of some rule have their words numbered
    matched = F.when(gate, chosen).otherwise(F.array().cast("array<struct<label:string,pattern:string,numbered:string,rank:int>>"))
    df = df.select("*", F.explode(F.array(matched)).alias("_rules"))
    each = F.transform(F.split(F.trim(norm), "  "), lambda w, i: F.concat(F.lit(" "), w, F.lit("\x02"), i.cast("string"), F.lit(" ")))
    numbered = F.when(F.size("_rules") > 0, F.array_join(each, "")).otherwise(F.lit(""))
    df = df.select("*", F.explode(F.array(numbered)).alias("_numbered"))

    def places_of(r):
        place = lambda m, pattern: F.regexp_extract(m, pattern, 1).cast("long")
        return F.transform(F.regexp_extract_all(F.col("_numbered"), r["numbered"], F.lit(1)), lambda m: F.struct(
            r["label"].alias("label"), r["rank"].alias("rank"), place(m, "\x02([0-9]+)").alias("first"), (place(m, "\x02([0-9]+) $") + 1).alias("past")))

    found = F.flatten(F.transform("_rules", places_of))
    ordered = F.array_sort(found, lambda a, b: F.when(a["first"] != b["first"], F.when(a["first"] < b["first"], -1).otherwise(1))
                           .when(a["past"] != b["past"], F.when(a["past"] > b["past"], -1).otherwise(1))
                           .when(a["rank"] != b["rank"], F.when(a["rank"] > b["rank"], -1).otherwise(1))
                           .when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    kept_type = "array<struct<label:string,rank:int,first:bigint,past:bigint>>"
    # furthest end so far among detections of each priority or above
    zero = F.struct(F.array(*[F.lit(0).cast("long")] * PRIORITIES).alias("ends"), F.array().cast(kept_type).alias("out"))

    def keep(acc, d):
        inside = F.element_at(acc["ends"], d["rank"]) >= d["past"]
        ends = F.transform(acc["ends"], lambda e, i: F.when(i < d["rank"], F.greatest(e, d["past"])).otherwise(e))
        return F.when(inside, acc).otherwise(F.struct(ends.alias("ends"), F.concat(acc["out"], F.array(d)).alias("out")))

    df = df.select("*", F.explode(F.array(ordered)).alias("_ordered"))
    # in stretches, so that what is kept is not copied for every detection
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size("_ordered") - 1) / STRETCH).cast("int")), lambda k: F.slice("_ordered", k * STRETCH + 1, STRETCH))
    none = F.struct(zero["ends"].alias("ends"), F.array().cast(f"array<{kept_type}>").alias("out"))

    def keep_stretch(acc, part):
        inner = F.aggregate(part, F.struct(acc["ends"].alias("ends"), F.array().cast(kept_type).alias("out")), keep)
        return F.get(F.transform(F.array(inner), lambda i: F.struct(i["ends"].alias("ends"), F.concat(acc["out"], F.array(i["out"])).alias("out"))), F.lit(0))

    detections = F.when(F.size("_ordered") > 0, F.flatten(F.aggregate(stretches, none, keep_stretch)["out"])).otherwise(F.array().cast(kept_type))
    df = df.select("*", F.explode(F.array(detections)).alias("detections"))
    rank = F.coalesce(F.array_max(F.transform("detections", lambda d: d["rank"])), F.when(F.col("n_base") > 0, F.lit(2)), F.lit(0))
    df = df.withColumns({
        "base_labels": F.array_join("_base", ","),
        "labels": F.array_join(F.array_sort(F.array_union("_base", F.transform("detections", lambda d: d["label"]))), ","),
        "score": rank / F.lit(float(PRIORITIES)),
    })
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score"]
    return df.select(*[F.col(f"_in{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in added], *added)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

