"""Tokens, grams, numbers and small text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
WORD = "[a-z0-9]+"
WORD_WITH_DECIMALS = r"[a-z0-9]+(?:\.[0-9]+)?"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
SCHEMES = {"user": "user", "file": "file", "repo": "file", "commit": "commit", "slack": "slack", "jira": "jira", "api": "api"}
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words_with_decimals(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_WITH_DECIMALS), F.lit(0))


def _joined(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def grams(tokens: Column, most: int = 2) -> Column:
    """All unigrams, then all bigrams, ...; repeats stay."""
    parts = [tokens]
    for n in range(2, most + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, _joined(tokens, n)))
    return F.concat(*parts)


def numbers(text: Column) -> Column:
    """The set of numbers; 15 and 15.0 are one."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))))


def collapsed(text: Column) -> Column:
    """White space as one space each; single spaces, which are most, are not touched."""
    return F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r]\s*| \s+", " "))


def holds(low: Column, needles) -> Column:
    """Whether a lower-cased text holds one of some strings."""
    out = F.lit(False)
    for needle in needles:
        out = out | low.contains(needle)
    return out


def has_any(text: Column, needles) -> Column:
    return holds(F.lower(text), needles)


def source_type_of(ref: Column) -> Column:
    """From the scheme of a source reference; api where it names none that is known."""
    scheme = F.lower(F.regexp_extract(ref, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    out = F.lit("api")
    for name, kind in SCHEMES.items():
        out = F.when(scheme == name, F.lit(kind)).otherwise(out)
    return out


def phrase_query(text: str) -> list[str]:
    """The words of a keyword query, each to be looked for as a phrase."""
    return text.split()


def duration_seconds(text: Column) -> Column:
    """30d, 12h, ... in seconds; null for anything else."""
    n, unit = F.regexp_extract(text, r"^\s*([0-9]+)([smhdw])\s*$", 1), F.regexp_extract(text, r"^\s*([0-9]+)([smhdw])\s*$", 2)
    factor = F.lit(None).cast("long")
    for name, seconds in UNITS.items():
        factor = F.when(unit == name, F.lit(seconds).cast("long")).otherwise(factor)
    return F.nullif(n, F.lit("")).try_cast("long") * factor


def expiry(text: Column, now: Column) -> Column:
    """The moment a duration after now, or an ISO moment (UTC where it names no zone)."""
    seconds = duration_seconds(text)
    return F.coalesce(F.timestamp_micros(F.unix_micros(now) + seconds * 1_000_000), F.try_to_timestamp(text))


def shortened(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.left(text, F.lit(width - 1)), F.lit("…")))


def two_places(x: Column) -> Column:
    """Number as text with two decimals, as C and Python round: by the exact binary value (0.565 is under its half), where format_string reads the shortest decimal."""
    n, high = F.floor(x * 100), x.cast("float").cast("double")
    over = (high * 100 - (n + 0.5)) + (x - high) * 100  # both products are exact, so the sign is
    return F.format_string("%.2f", (n + F.when((over > 0) | ((over == 0) & (n % 2 != 0)), 1).otherwise(0)) / 100)


def percent(x: Column) -> Column:
    return F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))


def level(trust: Column) -> Column:
    return F.when(trust >= 0.7, "high").when(trust >= 0.4, "medium").otherwise("low")


def semver_key(version: Column) -> Column:
    """A struct that orders versions: numbers, releases over their prereleases, numeric identifiers under others.

    Null for what is no version. Build metadata is left out.
    """
    core = F.regexp_extract(version, r"^([^+]*)", 1)
    numbers_ = F.split(F.regexp_extract(core, r"^([^-]*)", 1), r"\.")
    pre = F.regexp_extract(core, r"^[^-]*-(.*)$", 1)
    # of each identifier: kind 0 numeric, 1 other; array order is identifier by identifier, shorter first
    key = F.transform(F.split(pre, r"\."), lambda i: F.struct(
        F.when(i.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"), F.coalesce(F.when(i.rlike("^[0-9]+$"), i.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("n"),
        F.when(i.rlike("^[0-9]+$"), F.lit("")).otherwise(i).alias("text")))
    empty = F.slice(key, 1, 0)
    part = lambda k: F.get(numbers_, F.lit(k)).try_cast("int")
    good = (F.size(numbers_) == 3) & F.forall(numbers_, lambda x: x.rlike("^[0-9]+$"))
    return F.when(good, F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"),
                                 F.when(pre == "", 1).otherwise(0).alias("release"), F.when(pre == "", empty).otherwise(key).alias("pre")))
