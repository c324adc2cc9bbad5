"""Trust signals as columns; every one stays in generated code."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
AUTHORITY = {"commit": 0.9, "file": 0.8, "api": 0.7, "jira": 0.7, "user": 0.6, "slack": 0.5}
SENSITIVITY = {"public": 0.0, "internal": 0.2, "secret": 0.6, "pii": 0.8}
WEIGHTS = {"authority": 0.35, "freshness": 0.20, "confirmation": 0.20, "contradiction": 0.15, "sensitivity": 0.10, "correction": 0.10}
FRESH_DAYS = 90.0
#: of the reranker, where no trust is stored
RERANK_WEIGHTS = (0.4, 0.3, 0.3)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def looked_up(values: dict, key: Column, default: float) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def source_authority(source_type: Column, reputation: Column | float = 1.0) -> Column:
    return clamp01(looked_up(AUTHORITY, source_type, 0.5) * reputation)


def freshness(age_days: Column, life_days: Column) -> Column:
    """Linear to the expiry if there is one, else e-folding over 90 days."""
    return F.when(life_days.isNull(), F.exp(-F.greatest(age_days, F.lit(0)) / FRESH_DAYS)).when(
        life_days <= 0, F.lit(0.0)).otherwise(clamp01(1 - age_days / life_days))


def confirmation(n: Column) -> Column:
    return 1 - F.exp(-F.greatest(n, F.lit(0)) / 3.0)


def contradiction_penalty(n: Column) -> Column:
    return F.least(F.lit(1.0), n / 3.0)


def unresolved(contradicts: Column) -> Column:
    """Distinct records that a record contradicts."""
    return F.size(F.array_distinct(F.array_compact(F.coalesce(contradicts, F.array().cast("array<string>")))))


def sensitivity_penalty(tier: Column) -> Column:
    return looked_up(SENSITIVITY, tier, 0.8)


def correction_signal(kind: Column, count: Column) -> Column:
    """Over 0.5 for affirmed records, under it for superseded ones; a count alone affirms, other kinds are neutral."""
    kind = F.lower(F.trim(kind))
    n = F.greatest(F.when(kind.isNull(), F.coalesce(count, F.lit(0))).otherwise(F.coalesce(count, F.lit(1))), F.lit(0))
    swing = 0.5 * (1 - F.exp(-n / 3.0))
    return F.when(kind.isNull() | (kind == "affirm"), 0.5 + swing).when(kind == "supersede", 0.5 - swing).otherwise(F.lit(0.5))


def correction_of(metadata: Column) -> Column:
    """The signal of a JSON object with correction or correction_kind, and perhaps corrections."""
    member = lambda name: F.get_json_object(metadata, f"$.{name}")
    return correction_signal(F.coalesce(member("correction"), member("correction_kind")), member("corrections").try_cast("int"))


def listed(member: Column) -> Column:
    """A JSON member that is a list, or one value, or missing, as an array of strings."""
    none = F.array().cast("array<string>")
    return F.when(member.isNull(), none).when(member.startswith("["), F.coalesce(F.from_json(member, "array<string>"), none)).otherwise(F.array(member))


def trust_score(a: Column, f: Column, c: Column, p: Column, s: Column, k: Column) -> Column:
    w = WEIGHTS
    return clamp01(w["authority"] * a + w["freshness"] * f + w["confirmation"] * c + w["contradiction"] * (1 - p)
                   + w["sensitivity"] * (1 - s) + w["correction"] * (k - 0.5))


def rerank_trust(stored: Column, a: Column, f: Column, c: Column, p: Column, s: Column) -> Column:
    """The stored trust where there is one, else a product of what speaks for and against the record."""
    wa, wf, wc = RERANK_WEIGHTS
    return F.when(stored > 0, clamp01(stored)).otherwise(clamp01((wa * a + wf * f + wc * c) * (1 - p) * (1 - s)))


def signals(records: DataFrame, now_s: Column) -> DataFrame:
    """records (created_s, expires_s, n_contradicts, ...) with the six signals and trust."""
    c = F.col
    age = (now_s - c("created_s")) / 86400.0
    life = (c("expires_s") - c("created_s")) / 86400.0
    names = ("authority", "freshness", "confirmation", "contradiction", "tier_penalty", "corrected")
    out = records.withColumns(dict(zip(names, (
        source_authority(c("source_type")), freshness(age, life), confirmation(c("confirmations")), contradiction_penalty(c("n_contradicts")),
        sensitivity_penalty(c("sensitivity")), correction_signal(c("correction"), c("corrections"))))))
    return out.withColumn("trust", trust_score(*map(c, names)))
