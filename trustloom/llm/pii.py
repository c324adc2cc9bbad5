"""Operator 9: personal data, found also behind disguises, with offsets kept.

Base detectors read the source text. Transducers then rewrite disguises (homoglyphs,
spelled digits, at/dot in words or brackets) and keep, for every rewritten piece, where
it came from; the detectors run on the rewritten text and each find that touches a
rewritten piece is mapped back to source code points. Base spans always stay; a
recovered span is added unless a base span of its kind covers it, so a wider one stands
beside the base span inside it. Secrets (keys and tokens of known shapes, and values with
a digit that are said to be a password, token or the like) are added as a kind of their
own, `secret`.

Null and empty texts have no spans. Repeated rows give repeated results, empty tables
empty ones. Every scan is linear in the text, long runs of one character class included,
and texts of any length are read whole. Other columns stay; those called base_spans or
spans, in any case, are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm.common import replace_columns, schema_with, table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: words before a spoken "at" that name no mailbox
_NO_BOX = frozenset("me us him her it them you look looks looked looking see seen found find available located hosted visit visited read more us "
                    "arrive arrived stay be is are was were am go went home here there meet met live lives lived work works worked and or".split())
_KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]+)")
_KEY_HINTS = ("AKIA", "gh", "sk", "pk", "rk", "xox", "eyJ")
_SAID = re.compile(r"(?:password|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key)[\"']?\s{0,3}(?:=|:|:=|=>|\bis\b)\s{0,3}[\"']?([^\s\"']{6,})", re.I)
_SAID_HINTS = ("passw", "pwd", "secret", "token", "key")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit first and then the look behind: the scan can jump from digit to digit
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        past = found.end() if found else at + 1
        if found:
            yield start, past
        at = text.find("@", past)


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base detectors, by start and then by kind as listed."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def homoglyphs() -> dict[int, str]:
    """Look-alike code point -> ASCII; each is one character, so offsets stay."""
    pairs = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijshdqwABEKMHOPCTXIJS"))
    pairs |= dict(zip("αοενιρΑΒΕΗΙΚΜΝΟΡΤΧΖ", "aoeviPABEHIKMNOPTXZ"))
    out = {ord(a): b for a, b in pairs.items()}
    out |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}  # full width
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # other digits
        out |= {zero + d: str(d) for d in range(10)}
    return out | {0x2024: ".", 0x3002: ".", 0xFE52: ".", 0xFE6B: "@", 0x2010: "-", 0x2011: "-", 0x2212: "-", 0xA0: " "}


_GLYPHS = homoglyphs()
_GLYPH = re.compile("[" + "".join(re.escape(chr(c)) for c in _GLYPHS) + "]")
_DIGITS = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_DIGIT = "|".join(_DIGITS)
#: a run of at least four spelled digits, perhaps after "plus", mixed with real digits
_SPELLED = re.compile(rf"\b(?:plus[ -])?(?:(?:{_DIGIT}|[0-9])[ ,.-]{{1,2}}){{3,}}(?:{_DIGIT}|[0-9])\b", re.I)
_TOKEN = re.compile(rf"\bplus\b|\b(?:{_DIGIT})\b|[0-9]", re.I)
_MARK = re.compile(r"\s?[\[({<]\s?(at|dot|@|\.)\s?[\])}>]\s?", re.I)
_AT = re.compile(r" at |@", re.I)
_AFTER = re.compile(r"[A-Za-z0-9-]++(?:(?: dot |\.)[A-Za-z0-9-]++)*+", re.I)
_BEFORE = re.compile(r"[A-Za-z0-9_%+-]++(?:(?: tod |\.)[A-Za-z0-9_%+-]++)*+", re.I)  # reads backwards
_LABEL = re.compile(r" dot |\.", re.I)
_END = re.compile(r"[A-Za-z]{2,}+\b")
#: a spoken dot between digits
_BETWEEN = re.compile(r"(?<=[0-9]) dot (?=[0-9])", re.I)
_SPACED = re.compile(r" (at|dot) ", re.I)
#: without one of these no disguise of at or dot matches
_HINTS = (" at ", " dot ", "[", "(", "{", "<")
_TWO = re.compile(rf"[zotfsen](?<!\w\w)(?:{"|".join(w[1:] for w in _DIGITS)})[ ,.-]{{1,2}}(?:{_DIGIT}|[0-9])\b")


def _worded(plain: str):
    """(start, end) of e-mails with at or dot in words; the ending is any of two or more letters."""
    back = plain[::-1]
    for m in _AT.finditer(plain):
        before, after = _BEFORE.match(back, len(plain) - m.start()), _AFTER.match(plain, m.end())
        if before and after:
            for label in reversed(list(_LABEL.finditer(plain, after.start(), after.end()))):
                if last := _END.match(plain, label.end()):
                    spoken = m.group() != "@" and plain[len(plain) - before.end():m.start()].lower() in _NO_BOX
                    if not spoken:
                        yield len(plain) - before.end(), last.end()
                    break


def rewrite(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with look-alikes replaced, edits): edits are (start, end, new) apart from each other."""
    plain = text if text.isascii() or not _GLYPH.search(text) else text.translate(_GLYPHS)
    edits = []
    low = plain.lower()
    if any(h in low for h in _HINTS):
        edits += [(m.start(), m.end(), "@" if m.group(1).lower() in ("at", "@") else ".") for m in _MARK.finditer(plain)]
        for start, end in _worded(plain):
            edits += [(start + k.start(), start + k.end(), "@" if k.group(1).lower() == "at" else ".")
                      for k in _SPACED.finditer(plain[start:end])]
        edits += [(m.start(), m.end(), ".") for m in _BETWEEN.finditer(plain)]
    if sum(low.count(w) for w in _DIGITS) > 1 and _TWO.search(low):
        for m in _SPELLED.finditer(plain):
            tokens = list(_TOKEN.finditer(m.group()))
            for a, b in zip(tokens, [*tokens[1:], None]):
                end = b.start() if b else a.end()  # the separator goes with its digit
                word = a.group().lower()
                edits.append((m.start() + a.start(), m.start() + end, "+" if word == "plus" else _DIGITS.get(word, word)))
    apart, past = [], 0
    for start, end, new in sorted(edits):
        if start >= past:
            apart.append((start, end, new))
            past = end
    return plain, apart


def recovered(text: str) -> list[tuple[str, int, int]]:
    """Spans seen only after rewriting, in source code points."""
    plain, edits = rewrite(text)
    if not edits and plain is text:
        return []
    parts, new_at, old_at, at, made = [], [0], [0], 0, 0
    for start, end, new in edits:
        parts += [plain[at:start], new]
        made += start - at
        new_at += [made, made + len(new)]
        old_at += [start, end]
        made += len(new)
        at = end
    whole = "".join([*parts, plain[at:]])

    def source(p: int, end: bool) -> int:
        k = bisect_right(new_at, p) - 1
        if k % 2:  # inside a rewritten piece
            return old_at[k + 1] if end else old_at[k]
        return old_at[k] + p - new_at[k]

    out = []
    for kind, start, end in detect(whole):
        a = source(start, False)
        b = source(end - 1, True) if (bisect_right(new_at, end - 1) - 1) % 2 else source(end - 1, False) + 1
        if text[a:b] != whole[start:end]:
            while b > a and text[b - 1].isspace():
                b -= 1
            while a < b and text[a].isspace():
                a += 1
            out.append((kind, a, b))
    return out


def secrets(text: str) -> list[tuple[str, int, int]]:
    out = [("secret", *m.span()) for m in _KEY.finditer(text)] if any(h in text for h in _KEY_HINTS) else []
    low = text.lower()
    if any(h in low for h in _SAID_HINTS):
        out += [("secret", *m.span(1)) for m in _SAID.finditer(text) if any(c.isdigit() for c in m.group(1))]
    return sorted(set(out))


def spans(text: str | None) -> tuple[list, list]:
    """(base spans, all spans)."""
    text = text or ""
    base = detect(text)
    extra = [x for x in recovered(text) if not any(k == x[0] and s <= x[1] and x[2] <= e for k, s, e in base)]
    return base, sorted(base + extra + secrets(text), key=lambda x: (x[1], ALL_KINDS.index(x[0]), x[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame) -> DataFrame:
    """Add base_spans and spans: arrays of (kind, start, end) in code points of `text`."""

    def run(batches):
        for batch in batches:
            both = [spans(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            cells = [[[dict(zip(("kind", "start", "end"), s)) for s in row[k]] for row in both] for k in (0, 1)]
            yield replace_columns(batch, {"base_spans": pa.array(cells[0], _SPAN), "spans": pa.array(cells[1], _SPAN)})

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.mapInArrow(run, schema_with(docs, f"base_spans {kind}, spans {kind}"))


def redact_text(text: str | None) -> str | None:
    """Spans replaced by their kind in brackets; spans that overlap go together, under the first one's kind."""
    if text is None:
        return None
    joined: list[list] = []
    for kind, start, end in spans(text)[1]:
        if joined and start < joined[-1][2]:
            joined[-1][2] = max(end, joined[-1][2])
        else:
            joined.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in joined:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data in `text` replaced."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array([redact_text(t) for t in batch.column(k).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: lambda s: s["kind"] == F.lit(k)  # a second parameter would be the element's place
    counts = [F.size(F.filter("base_spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
                        F.size(F.filter("spans", of_kind("secret"))).cast("long").alias("n_secret"))
