"""The operators from plain SQL: functions, and table functions for LATERAL, registered by one call.

All are SQL functions of the session, so calls are inlined into the plan and stay in
generated code; constants and patterns are those of the column functions.

    register(spark)
    SELECT memory_id, t.line, t.chunk FROM records, LATERAL tl_sentences(content) t WHERE tl_has_secret(t.chunk)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from trustloom.functions import detect, text, trust
from trustloom.operators import capture
from trustloom.schema import TIERS

LINE = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"


def literal(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cases(values: dict, key: str, default: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {literal(k)} THEN {v}D" for k, v in values.items()) + f" ELSE {default}D END"


def functions() -> dict[str, tuple[str, str, str]]:
    """(parameters, what is returned, the body) of every function by name."""
    w, clamp = trust.WEIGHTS, lambda x: f"greatest(0D, least(1D, {x}))"
    return {
        "tl_words": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(lower(t), {literal(text.WORD)}, 0)"),
        "tl_numbers": ("t STRING", "ARRAY<DOUBLE>", f"array_sort(array_distinct(transform(regexp_extract_all(t, {literal(text.NUMBER)}, 0), x -> cast(x AS DOUBLE))))"),
        "tl_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0D)"),
        "tl_tier_rank": ("tier STRING", "INT", "cast(coalesce(nullif(array_position(array(" + ", ".join(map(literal, TIERS)) + f"), tier), 0) - 1, {len(TIERS)}) AS INT)"),
        "tl_source_authority": ("source_type STRING", "DOUBLE", cases(trust.AUTHORITY, "source_type", 0.5)),
        "tl_sensitivity_penalty": ("tier STRING", "DOUBLE", cases(trust.SENSITIVITY, "tier", 0.8)),
        "tl_freshness": ("age_days DOUBLE, life_days DOUBLE", "DOUBLE", f"CASE WHEN life_days IS NULL THEN exp(-greatest(age_days, 0D) / {trust.FRESH_DAYS}D) WHEN life_days <= 0 THEN 0D ELSE {clamp('1 - age_days / life_days')} END"),
        "tl_confirmation": ("n BIGINT", "DOUBLE", "1 - exp(-greatest(n, 0) / 3.0D)"),
        "tl_trust": ("authority DOUBLE, freshness DOUBLE, confirmation DOUBLE, contradiction DOUBLE, tier_penalty DOUBLE, corrected DOUBLE", "DOUBLE",
                     clamp(f"{w['authority']}D * authority + {w['freshness']}D * freshness + {w['confirmation']}D * confirmation + {w['contradiction']}D * (1 - contradiction) "
                           f"+ {w['sensitivity']}D * (1 - tier_penalty) + {w['correction']}D * (corrected - 0.5D)")),
        "tl_has_secret": ("t STRING", "BOOLEAN", " OR ".join(f"coalesce(rlike(t, {literal(p)}), FALSE)" for p in detect.SECRETS)),
        "tl_sentences": ("t STRING", "TABLE(line INT, part INT, chunk STRING)",
                         f"SELECT l.pos + 1, p.pos, regexp_replace(p.col, '^[ \\\\-\\\\t]+|[ \\\\-\\\\t]+$', '') FROM LATERAL posexplode(split(t, {literal(LINE)})) l, "
                         f"LATERAL posexplode(split(regexp_replace(regexp_replace(l.col, {literal('^\\s+|\\s+$')}, ''), {literal(capture.SPEAKER)}, ''), {literal('(?<=[.!?])\\s+')})) p "
                         f"WHERE length(regexp_replace(p.col, '^[ \\\\-\\\\t]+|[ \\\\-\\\\t]+$', '')) >= {capture.SHORTEST}"),
        "tl_grams": ("t STRING, width INT", "TABLE(at INT, gram STRING)", f"SELECT pos, array_join(slice(regexp_extract_all(lower(t), {literal(text.WORD)}, 0), pos + 1, width), ' ') FROM "
                     f"LATERAL posexplode(regexp_extract_all(lower(t), {literal(text.WORD)}, 0)) WHERE pos + width <= size(regexp_extract_all(lower(t), {literal(text.WORD)}, 0))"),
    }


def register(spark: SparkSession) -> list[str]:
    """Make every function known to the session; returns their names."""
    for name, (given, returned, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {returned} RETURN {body}")
    return list(functions())
