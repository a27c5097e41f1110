"""Operator 5 - personal data, with DataFrame functions only.

Regular expressions propose spans, leftmost and non-overlapping per kind;
checksums confirm them (Luhn for cards, mod 97 for bank account numbers, the
number range for addresses, the digit count for phones); words in the
``CONTEXT_CHARS`` before a span adjust its score. Four kinds are the base;
``iban`` is what the method adds.

Positions come from the pieces between the matches: the n-th match begins after
all pieces and matches before it. The patterns are written without backtracking
into what they have read (possessive parts, look-behinds at the start of a run),
so long runs cost linear time; they find the same spans as the plain forms.

Defined cases: null text is the empty text and has no spans; offsets are code
points, end exclusive; repeated rows repeat; other columns are kept by
``redacted`` and ignored by ``pii_report``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

CONTEXT_CHARS = 32
_MAIL = "A-Za-z0-9._%+-"
#: kind: (a quick test that every text with such a span passes, the pattern).
PATTERNS = {
    "email": ("@", rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?:[ -][0-9]++)*+"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: kind: (score of a confirmed span, words before it that raise the score by RAISE).
SCORES = {
    "email": (0.9, "mail|contact|write"), "ip": (0.6, "ip|address|host|server"), "card": (0.8, "card|visa|credit|payment"),
    "phone": (0.7, "phone|tel|call|mobile|fax"), "iban": (0.9, "iban|account|bank|transfer"),
}
RAISE = 0.1


def _proposed(text: Column, kind: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches."""
    quick, pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("piece"), found.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = lambda a, x: a["at"] + F.length(x["piece"])
    end = lambda a, x: start(a, x) + F.length(x["value"])
    walk = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(end(a, x).alias("at"), F.concat(a["out"], F.array(F.struct(start(a, x).alias("start"), end(a, x).alias("end"), x["value"].alias("value")))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(text.contains(quick) if quick == "@" else text.rlike(quick), walk).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether letters and digits pass the mod-97 checksum of bank account numbers."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _judged(body: Column, kind: str) -> Column:
    """The confirmed spans of a kind with their scores."""
    sure, words = SCORES[kind]

    def score(s: Column) -> Column:
        at = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        before = F.substr(body, at + 1, s["start"] - at)
        raised = F.when(before.rlike(rf"(?i)(?<![a-z])(?:{words})"), F.lit(min(1.0, sure + RAISE))).otherwise(F.lit(sure))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), raised.alias("score"))

    return F.transform(F.filter(_proposed(body, kind), lambda s: _confirmed(kind, s["value"])), score)


def with_spans(df: DataFrame, text: str, into: str = "_spans") -> DataFrame:
    """``df`` with an array of struct<kind, start, end, score>: by kind, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df
    for kind in KINDS:
        out = out.withColumn(f"{into}_{kind}", _judged(body, kind))
    return out.withColumn(into, F.concat(*(f"{into}_{k}" for k in KINDS))).drop(*(f"{into}_{k}" for k in KINDS))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, counts of the base kinds, their digest, all spans and their scores."""
    found = with_spans(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    of = lambda kind: F.filter("_spans", lambda s: s["kind"] == kind)
    return found.select(
        F.col("_key").alias(key),
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(F.filter("_spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"),
        F.array_join(F.transform("_spans", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )


def redacted(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` with each span of at least that score replaced by its kind in brackets, e.g. ``[email]``.

    Of overlapping spans the one that begins first is named and all are removed; null stays null.
    """
    name = fresh(df, "_pii")
    found = with_spans(df, text, name)
    spans = F.array_sort(F.transform(F.filter(name, lambda s: s["score"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    body = F.col(text)

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["out"], F.substr(body, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], more).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(body, a["at"] + 1)))
    return found.withColumn(text, F.when(F.size(name) > 0, clean).otherwise(body)).select(*(F.col(f"`{c}`") for c in df.columns))
