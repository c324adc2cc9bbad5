"""Project decisions in a sentence: which key it settles, and to what value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustloom.frames import let
from trustloom.functions.text import collapsed, holds

# fixed values
VALUE = r"([A-Za-z][A-Za-z0-9_.+-]*(?:\s+[A-Za-z][A-Za-z0-9_.+-]*)?)"
MANAGER = "(npm|pnpm|yarn|bun)"
COMMAND = r"(vitest\s+run|uv\s+run\s+pytest|pytest|pnpm\s+test|npm\s+test|yarn\s+test|bun\s+test|ruff\s+check\s+\.)"
USES = r"(?:uses?|using|use)"
PROJECT = r"(?:this\s+project\s+|the\s+project\s+)?(?:now\s+)?"
IS_NOW = r"(?:uses?|using|is|has\s+(?:now\s+)?been\s+using)"
#: (key, pattern, groups of which the first that matched is the value), in order of precedence
PATTERNS = (
    ("test_command", rf"\b(?:the\s+)?test\s+command\s+(?:is\s+)?{COMMAND}\b|\b(?:run\s+tests?\s+with|tests?\s+run\s+with|use)\s+{COMMAND}(?:\s+for\s+tests?)?\b", (1, 2)),
    ("package_manager", rf"\breplace\s+{MANAGER}\s+with\s+{MANAGER}\b", (2,)),
    ("package_manager", rf"\b{PROJECT}{USES}\s+{MANAGER}\s*,?\s+(?:not|instead\s+of)\s+{MANAGER}\b", (1,)),
    ("package_manager", rf"\b{PROJECT}{USES}\s+{MANAGER}\b", (1,)),
    ("replacement", rf"\breplace\s+{VALUE}\s+with\s+{VALUE}\b", (2,)),
    ("backend_framework", rf"\b(?:backend|back\s*end)(?:\s+[A-Za-z0-9_]+){{0,4}}\s+{IS_NOW}\s+{VALUE}\b", (1,)),
    ("backend_framework", rf"\b(?:uses?|using)\s+{VALUE}\s+for\s+(?:the\s+)?backend\b", (1,)),
    ("package_manager", rf"\b(?:use|uses|using)\s+{VALUE}\s+(?:not|instead\s+of)\s+[A-Za-z0-9_]+\b", (1,)),
    ("package_manager", rf"\b(?:package\s+manager|pm)\s+(?:is|uses?|using)\s+{VALUE}\b", (1,)),
    ("frontend_framework", rf"\b(?:frontend|front\s*end|ui)(?:\s+[A-Za-z0-9_]+){{0,4}}\s+{IS_NOW}\s+{VALUE}\b", (1,)),
    ("frontend_framework", rf"\b(?:uses?|using)\s+{VALUE}\s+for\s+(?:the\s+)?frontend\b", (1,)),
    ("database_local", rf"\blocal\s+database\s+(?:is|uses?|using)\s+{VALUE}\b", (1,)),
    ("database_cloud", rf"\bcloud\s+database\s+(?:is|uses?|using)\s+{VALUE}\b", (1,)),
    ("database", rf"\bdatabase\s+(?:is|uses?|using)\s+{VALUE}\b", (1,)),
    ("database", rf"\b(?:uses?|using)\s+{VALUE}\s+for\s+(?:the\s+)?database\b", (1,)),
    ("database", rf"\b(?:uses?|using)\s+{VALUE}\s+as\s+(?:the\s+)?database\b", (1,)),
    ("deployment_target", rf"\b(?:deploy(?:ment)?\s+(?:target|platform)|deploys?\s+to|hosted\s+on)\s+(?:is\s+|uses?\s+|using\s+)?{VALUE}\b", (1,)),
)
#: of each pattern strings of which every match in collapsed text holds one, in lower case: looking for these takes a small part of a pattern's time
_MANAGERS, _COMMANDS = ("npm", "yarn", "bun"), ("vitest", "pytest", "npm", "yarn", "bun", "ruff")
PARTS = (
    _COMMANDS, ("replace",), _MANAGERS, _MANAGERS, ("replace",), ("backend ", "back end "), ("backend",), (" not ", " instead of "), ("package manager", "pm is ", "pm us"),
    ("frontend ", "front end ", "ui "), ("frontend",), ("local database",), ("cloud database",), ("database",), ("database",), ("database",), ("deploy", "hosted on"),
)
LABELS = {
    "backend_framework": "Backend framework", "package_manager": "Package manager", "database_local": "Local database",
    "database_cloud": "Cloud database", "database": "Database", "frontend_framework": "Frontend framework",
    "deployment_target": "Deployment target", "test_command": "Test command", "replacement": "Replacement",
}
CUE = r"\b(now|from\s+now\s+on|has\s+now\s+been|now\s+using|replace|replaced|no\s+longer|instead\s+of|supersedes?)\b"
STOP = r"\s+(?:for|as|because|since|instead|not|now|currently|in|on|with)\b.*$"
EDGE = r"""^[ .,:;"']+|[ .,:;"']+$"""
TOOLS = r"^(uv|pnpm|npm|yarn|bun|pytest|ruff|vitest)\b"
DATABASES = ("database", "database_local", "database_cloud")
#: words of a question -> the keys it asks for
ASKS = (
    (("backend", "back end", "api framework"), ("backend_framework",)),
    (("package manager", "npm", "pnpm", "yarn", "bun"), ("package_manager",)),
    (("database", "datastore", "db"), DATABASES),
    (("deploy", "deployed", "hosted", "hosting"), ("deployment_target",)),
    (("test", "tests", "testing"), ("test_command",)),
    (("frontend", "front end", "ui framework"), ("frontend_framework",)),
)


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, EDGE, "")


def normalised(value: Column) -> Column:
    """Up to a word that ends a value, without edge marks; two words at most unless it is a tool's command."""
    short = trimmed(F.regexp_replace(value, "(?i)" + STOP, ""))
    return F.get(F.transform(F.array(short), lambda v: F.when(v.rlike("(?i)" + TOOLS), v).otherwise(F.array_join(F.slice(F.split(v, r"\s+"), 1, 2), " "))), F.lit(0))


def found(text: Column) -> Column:
    """struct(key, value) of the first pattern that gives a value, else null."""

    def first(whole, low):
        raw = lambda pattern, groups: F.concat(*[F.regexp_extract(whole, "(?i)" + pattern, g) for g in groups])
        each = [F.struct(F.lit(key).alias("key"), F.when(holds(low, parts), raw(pattern, groups)).otherwise("").alias("raw")) for (key, pattern, groups), parts in zip(PATTERNS, PARTS)]
        hits = F.filter(F.array(*each), lambda s: s["raw"] != "")
        return F.filter(F.transform(hits, lambda s: F.struct(s["key"].alias("key"), normalised(s["raw"]).alias("value"))), lambda s: s["value"] != "")

    return F.get(let(collapsed(text), lambda whole: let(F.lower(whole), lambda low: first(whole, low))), F.lit(0))


def has_cue(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + CUE)


def label(key: Column) -> Column:
    out = F.concat(F.upper(F.left(key, F.lit(1))), F.lower(F.regexp_replace(F.substring(key, 2, 1000), "_", " ")))
    for name, text in LABELS.items():
        out = F.when(key == name, F.lit(text)).otherwise(out)
    return out


def asked_keys(query: Column) -> Column:
    """Keys that a question asks for, by parts of words, sorted."""
    low = F.lower(query)
    parts = []
    for needles, keys in ASKS:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | low.contains(needle)
        parts.append(F.when(hit, F.array(*map(F.lit, keys))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*parts)))
