"""Detectors of poisoned, sensitive and secret text as columns; text is only ever matched."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.frames import let
from trustloom.functions.text import holds
from trustloom.schema import tier_rank

# fixed values: category, severity, pattern (any case; (?s) where . spans lines)
POISON = (
    ("prompt_injection", 0.85, r"\bignore\s+(?:the\s+|all\s+)?(?:above|previous|prior|preceding|earlier|foregoing)\b"),
    ("prompt_injection", 0.85, r"\bdisregard\s+(?:all\s+|the\s+)?(?:above|prior|previous|preceding|earlier|instructions?|rules?)\b"),
    ("prompt_injection", 0.8, r"\bforget\s+(?:everything|all|what\s+you|previous|prior)\b"),
    ("prompt_injection", 0.8, r"\bnote to (?:ai|assistant|the\s+(?:ai|assistant|model)|llm)\b"),
    ("prompt_injection", 0.8, r"\bthe real instruction is\b"),
    ("prompt_injection", 0.85, r"\bact as (?:the\s+)?(?:system|admin|administrator|root|developer)\b"),
    ("prompt_injection", 0.8, r"^\s*(?:system|assistant|developer)\s*:"),
    ("prompt_injection", 0.8, r"(?s)<!--.*?(?:assistant|system|ignore|override|instruction|prompt).*?-->"),
    ("jailbreak", 0.85, r"\byou are now\b"),
    ("jailbreak", 0.9, r"\bdan\b\s+and\s+have\s+no\s+restrictions\b"),
    ("jailbreak", 0.7, r"\bno\s+restrictions\b"),
    ("jailbreak", 0.85, r"\boverride\s+(?:your\s+)?(?:guardrails?|safety|safeguards?|restrictions?|filters?|rules?|policies|security)\b"),
    ("exfiltration", 0.9, r"\bexfiltrat"),
    ("exfiltration", 0.8, r"\bleak\s+(?:the|all|every|your|our|my)\b"),
    ("exfiltration", 0.85, r"\bsend\s+.{0,60}?\b(?:to|via)\b.{0,40}?(?:webhook|https?://|url|endpoint|attacker|e-?mail|address|server)\b"),
    ("exfiltration", 0.85, r"\bprint\s+the\s+contents?\s+of\b"),
    ("exfiltration", 0.85, r"\brespond\s+only\s+with\s+the\s+contents?\s+of\b"),
    ("exfiltration", 0.75, r"\bconnection string\b"),
    ("credential_theft", 0.9, r"\breveal\s+the\b.{0,40}\b(?:password|secret|secrets|token|tokens|api[_\s-]?keys?|keys?|credentials?)\b"),
    ("credential_theft", 0.85, r"\b(?:admin|root|database|db)\s+(?:password|secret|credentials?)\b"),
    ("remote_code_execution", 0.95, r"\b(?:curl|wget)\s+https?://"),
    ("remote_code_execution", 0.9, r"\|\s*(?:sh|bash|zsh)\b"),
    ("sabotage", 0.85, r"\bdelete\s+(?:all\s+)?.{0,30}?\b(?:logs?|audit|backups?|records?|tables?|database)\b"),
    ("sabotage", 0.85, r"\bdisable\s+(?:the\s+)?(?:policy|security|audit|guard|firewall|protection|safety)\b"),
    ("data_exposure", 0.8, r"/etc/(?:passwd|shadow)\b"),
)
POISON_ORDER = ("prompt_injection", "jailbreak", "exfiltration", "credential_theft", "remote_code_execution", "sabotage", "data_exposure", "obfuscation")
ENCODED, ENCODED_SEVERITY, EACH_CATEGORY = r"[A-Za-z0-9+/]{40,}={0,2}", 0.55, 0.03
# fixed values: name, pattern, tier, in the order of report
SENSITIVE = (
    ("aws_access_key_id", r"\bAKIA[0-9A-Z]{16}\b", "secret"),
    ("aws_secret_access_key", r"(?i)aws_secret_access_key", "secret"),
    ("private_key", r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----", "secret"),
    ("github_token", r"\bgh[poursa]_[A-Za-z0-9]{20,}\b", "secret"),
    ("slack_webhook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/_-]+", "secret"),
    ("bearer_token", r"(?i)\bbearer\s+[A-Za-z0-9._\-]{8,}", "secret"),
    ("password", r"(?i)\b[a-z0-9_]*(?:password|passwd|pwd)\b\s*[=:]\s*\S+", "secret"),
    ("internal_info", r"(?i)\b(?:company[\s-]+|strictly[\s-]+)?confidential\b", "secret"),
    ("internal_info", r"(?i)\b(?:for\s+)?internal[\s-]+(?:use[\s-]+)?only\b", "secret"),
    ("internal_info", r"(?i)\bproprietary\s+(?:and\s+confidential|information)\b", "secret"),
    ("internal_info", r"(?i)\btrade\s+secrets?\b", "secret"),
    ("internal_info", r"(?i)\bdo\s+not\s+(?:distribute|share|forward)\b", "secret"),
    ("internal_info", r"\b[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.(?:internal|corp|intranet)\b", "secret"),
    ("generic_secret", None, "secret"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "pii"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "pii"),
)
CARD = r"\b(?:[0-9][ -]?){15}[0-9]\b"
RUN, RUN_SIZE = "[A-Za-z0-9/+]+", 40
#: of each of them strings of which every match holds one, in lower case (none: always tried); looking for a string takes a small part of a pattern's time
POISON_PARTS = (
    ("ignore",), ("disregard",), ("forget",), ("note to ",), ("the real instruction is",), ("act as ",), (),
    ("<!--",), ("you are now",), ("restrictions",), ("restrictions",), ("override",), ("exfiltrat",), ("leak",),
    ("send",), ("print",), ("respond",), ("connection string",), ("reveal",), ("password", "secret", "credential"), ("curl", "wget"),
    ("|",), ("delete",), ("disable",), ("/etc/",),
)
SENSITIVE_PARTS = (
    ("akia",), ("aws_secret_access_key",), ("-----begin ",), ("_",), ("hooks.slack.com",), ("bearer",), ("password", "passwd", "pwd"),
    ("confidential",), ("internal",), ("proprietary",), ("trade",), ("distribute", "share", "forward"), (".internal", ".corp", ".intranet"), (),
    ("@",), ("-",),
)
#: the same runs, tried only where one begins; and what every card number holds
ENCODED_RUN, KEY_RUN, DIGITS = "(?<![A-Za-z0-9+/])" + ENCODED, f"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{{{RUN_SIZE}}}(?![A-Za-z0-9/+])", "[0-9](?:[ -]?[0-9]){15}"
REDACTED = "[REDACTED]"
#: what counts as a secret in free text, and is cut out of it
SECRETS = (
    r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[poursa]_[A-Za-z0-9]{20,}\b",
    r"https://hooks\.slack\.com/services/[A-Za-z0-9/_-]+", r"(?i)\bbearer\s+[A-Za-z0-9._\-]{8,}", r"\bsk-[A-Za-z0-9_-]{12,}",
    r"""(?i)\b(?:password|passwd|pwd|secret|token|api[ _-]?key)\b["']?\s*(?:\bis\b|=|:)\s*\S+""",
    r"(?i)\b[a-z0-9_]*(?:password|passwd|pwd)\b\s*[=:]\s*\S+",
)
SECRET_PARTS = (("-----begin ",), ("akia",), ("_",), ("hooks.slack.com",), ("bearer",), ("sk-",), ("password", "passwd", "pwd", "secret", "token", "api"), ("password", "passwd", "pwd"))


def tried(text: Column, low: Column, pattern: str, parts: tuple[str, ...]) -> Column:
    """text.rlike(pattern), looked for only where one of the parts is."""
    return holds(low, parts) & text.rlike(pattern) if parts else text.rlike(pattern)


def poison(text: Column) -> Column:
    """struct(is_poisoned, categories in order, severity, reason)."""
    text = F.coalesce(text, F.lit(""))

    def each(low):
        worst = []
        for category in POISON_ORDER[:-1]:
            found = [F.when(tried(text, low, "(?i)" + p, parts), F.lit(s)).otherwise(F.lit(0.0)) for (c, s, p), parts in zip(POISON, POISON_PARTS) if c == category]
            worst.append((category, F.greatest(*found) if len(found) > 1 else found[0]))
        coded = F.exists(F.regexp_extract_all(text, F.lit(ENCODED_RUN), F.lit(0)), lambda x: x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]"))
        worst.append((POISON_ORDER[-1], F.when(coded, F.lit(ENCODED_SEVERITY)).otherwise(F.lit(0.0))))
        return F.filter(F.array(*[F.struct(F.lit(c).alias("c"), s.alias("s")) for c, s in worst]), lambda x: x["s"] > 0)

    def result(hits):
        severity = F.when(F.size(hits) > 0, F.least(F.lit(1.0), F.array_max(F.transform(hits, lambda x: x["s"])) + EACH_CATEGORY * (F.size(hits) - 1))).otherwise(F.lit(0.0))
        names = F.transform(hits, lambda x: x["c"])
        reason = F.when(F.size(hits) > 0, F.concat(F.lit("matched "), F.array_join(names, ", "))).otherwise(F.lit("no known injection or poisoning patterns detected"))
        return F.struct((F.size(hits) > 0).alias("is_poisoned"), names.alias("categories"), severity.alias("severity"), reason.alias("reason"))

    return let(let(F.lower(text), each), result)


def card_found(text: Column) -> Column:
    return text.rlike(DIGITS) & F.exists(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), lambda x: F.call_function("luhn_check", F.regexp_replace(x, "[ -]", "")))


def sensitive(text: Column) -> Column:
    """struct(has_sensitive, detected in order of first sight, suggested tier or null, reason)."""
    text = F.coalesce(text, F.lit(""))
    run = F.exists(F.regexp_extract_all(text, F.lit(KEY_RUN), F.lit(0)), lambda x: x.rlike("[0-9/+]"))

    def each(low):
        hits = [(name, run if pattern is None else tried(text, low, pattern, parts), tier) for (name, pattern, tier), parts in zip(SENSITIVE, SENSITIVE_PARTS)] + [("credit_card", card_found(text), "pii")]
        return F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(tier).alias("tier"))) for name, hit, tier in hits]))

    def result(found):
        names = F.array_distinct(F.transform(found, lambda x: x["name"]))
        tier = F.when(F.size(found) > 0, F.when(F.exists(found, lambda x: x["tier"] == "secret"), "secret").otherwise("pii"))
        reason = F.when(F.size(found) > 0, F.concat(F.size(names).cast("string"), F.lit(" found: "), F.array_join(names, ", "), F.lit(" -> "), tier)).otherwise("nothing found")
        return F.struct((F.size(found) > 0).alias("has_sensitive"), names.alias("detected"), tier.alias("suggested"), reason.alias("reason"))

    return let(let(F.lower(text), each), result)


def raised(current: Column, suggested: Column) -> Column:
    """The more restrictive tier; never a lower one than the current."""
    return F.when(suggested.isNotNull() & (tier_rank(suggested) > tier_rank(current)), suggested).otherwise(current)


def contains_secret(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return let(F.lower(text), lambda low: functools.reduce(operator.or_, [tried(text, low, pattern, parts) for pattern, parts in zip(SECRETS, SECRET_PARTS)]))


def redact(text: Column) -> Column:
    """Cuts make no new part of a secret, so that the parts are looked for in the text as it was."""

    def cut(low):
        one = lambda out, step: let(out, lambda t: F.when(holds(low, step[1]), F.regexp_replace(t, step[0], REDACTED)).otherwise(t))
        return functools.reduce(one, zip(SECRETS, SECRET_PARTS), text)

    return let(F.lower(text), cut)


def annotate(metadata: Column, name: str, value: Column) -> Column:
    """The JSON object with one more member."""
    members = F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,string>")
    pair = F.concat(F.lit(f'"{name}":'), F.to_json(value))
    plain = F.regexp_replace(F.coalesce(metadata, F.lit("{}")), r"\}\s*$", "")
    return F.concat(plain, F.when(F.size(F.coalesce(members, F.create_map().cast("map<string,string>"))) > 0, ",").otherwise(""), pair, F.lit("}"))


def inspect_poison(records: DataFrame) -> DataFrame:
    """Poisoned records lose trust by their severity, become disputed and are annotated."""
    r = records.withColumn("_p", poison(F.col("content")))
    bad = F.col("_p.is_poisoned")
    return r.withColumns({
        "trust_score": F.when(bad, F.greatest(F.lit(0.0), F.col("trust_score") * (1 - F.col("_p.severity")))).otherwise(F.col("trust_score")),
        "status": F.when(bad, "disputed").otherwise(F.col("status")),
        "metadata": F.when(bad, annotate(F.col("metadata"), "poison", F.col("_p"))).otherwise(F.col("metadata"))}).drop("_p")


def inspect_sensitive(records: DataFrame) -> DataFrame:
    """Sensitive records are raised to the tier found and annotated."""
    r = records.withColumn("_s", sensitive(F.col("content")))
    return r.withColumns({
        "sensitivity": raised(F.col("sensitivity"), F.col("_s.suggested")),
        "metadata": F.when(F.col("_s.has_sensitive"), annotate(F.col("metadata"), "sensitive", F.col("_s"))).otherwise(F.col("metadata"))}).drop("_s")


def inspect(records: DataFrame, inspectors=(inspect_poison, inspect_sensitive)) -> DataFrame:
    for step in inspectors:
        records = records.transform(step)
    return records
