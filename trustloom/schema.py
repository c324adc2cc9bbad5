"""The record's fields, their kinds and the rules a record must keep (first violation first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType, TimestampType

# fixed values
SOURCE_TYPES = ("user", "file", "commit", "slack", "jira", "api")
SCOPES = ("global", "org", "project", "repo", "user", "session")
BOUND_SCOPES = ("project", "repo", "user", "session")
TIERS = ("public", "internal", "secret", "pii")
STATUSES = ("active", "corrected", "superseded", "outdated", "expired", "deleted", "disputed")

RECORD = StructType([
    StructField("memory_id", StringType()), StructField("content", StringType()), StructField("source_type", StringType()),
    StructField("source_ref", StringType()), StructField("scope", StringType()), StructField("scope_ref", StringType()),
    StructField("created_at", TimestampType()), StructField("updated_at", TimestampType()), StructField("expires_at", TimestampType()),
    StructField("trust_score", DoubleType()), StructField("sensitivity", StringType()), StructField("status", StringType()),
    StructField("tags", ArrayType(StringType())), StructField("confirmations", LongType()), StructField("embedding", ArrayType(FloatType())),
    StructField("metadata", StringType()), StructField("contradicts", ArrayType(StringType())),
])
DEFAULTS = {
    "scope": "global", "sensitivity": "internal", "status": "active", "trust_score": 0.0, "confirmations": 0, "metadata": "{}",
}
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def tier_rank(tier: Column) -> Column:
    """public 0 < internal 1 < secret 2 < pii 3; anything else, null included, ranks highest."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), tier), F.lit(0)) - 1, F.lit(len(TIERS))).cast("int")


def violations(id_pattern: str = UUID4) -> Column:
    """Names of the rules that a row breaks, in order; an empty array for a valid record."""
    c = F.col
    rules = [
        ("memory_id", c("memory_id").isNull() | ~c("memory_id").rlike(id_pattern)),
        ("source_type", c("source_type").isNull() | ~c("source_type").isin(*SOURCE_TYPES)),
        ("source_ref", blank(c("source_ref"))),
        ("content", blank(c("content"))),
        ("scope", c("scope").isNull() | ~c("scope").isin(*SCOPES)),
        ("sensitivity", c("sensitivity").isNull() | ~c("sensitivity").isin(*TIERS)),
        ("status", c("status").isNull() | ~c("status").isin(*STATUSES)),
        ("trust_score", c("trust_score").isNull() | F.isnan("trust_score") | ~c("trust_score").between(0, 1)),
        ("updated_at", c("updated_at") < c("created_at")),
        ("expires_at", c("expires_at") <= c("created_at")),
        ("contradicts", F.array_contains("contradicts", c("memory_id"))),
        ("scope_ref", c("scope").isin(*BOUND_SCOPES) & blank(c("scope_ref"))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))


def split_valid(records: DataFrame, id_pattern: str = UUID4) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with `violations`)."""
    checked = records.withColumn("violations", violations(id_pattern))
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def complete(rows: DataFrame) -> DataFrame:
    """rows with every field of RECORD, missing ones at their defaults, in order."""
    has = set(rows.columns)
    columns = []
    for field in RECORD.fields:
        value = F.col(field.name) if field.name in has else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]).cast(field.dataType))
        if field.name in ("tags", "contradicts"):
            value = F.coalesce(value, F.array().cast(field.dataType))
        if field.name == "trust_score":
            value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
        columns.append(value.alias(field.name))
    return rows.select(*columns)
