"""Personal data: patterns, checksums, spans, reversible masking. Column expressions and folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns by kind, in the order of detection, and the confidence of a hit.
PATTERNS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.99),
    ("PAN", r"\b[A-Z]{3}[CPHFATBLJG][A-Z][0-9]{4}[A-Z]\b", 1.0),
    ("CREDIT_CARD", r"\b[3-6][0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{1,4}\b", 0.98),
    ("AADHAAR", r"\b[2-9][0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b", 1.0),
    ("IBAN", r"\b[A-Z]{2}[0-9]{2}[\s-]?[A-Za-z0-9]{4}(?:[\s-]?[A-Za-z0-9]{1,4}){2,7}\b", 0.99),
    ("PHONE", r"(?:\+91[\s-]?)?[6-9][0-9]{4}[\s-]?[0-9]{5}|\+[1-9][0-9]{0,2}[\s-]?[0-9]{4,12}", 0.90),
)

SPANS = "array<struct<kind:string,start:int,end:int,value:string,confidence:double>>"


def dihedral(a: int, b: int) -> int:
    """The product of the dihedral group of order ten, on which the Verhoeff check digit rests."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def digit_permutation(power: int) -> list[int]:
    """The Verhoeff permutation of the digits, applied `power` times."""
    once, out = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], list(range(10))
    for _ in range(power % 8):
        out = [once[x] for x in out]
    return out


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _bare(raw: Column, drop: str = r"[\s-]") -> Column:
    return F.regexp_replace(raw, drop, "")


def valid_aadhaar(raw: Column) -> Column:
    """Twelve digits, not beginning with 0 or 1, with a right Verhoeff check digit."""
    s = _bare(raw)
    step = F.array(*[F.array(*[F.lit(x) for x in digit_permutation(i)]) for i in range(8)])
    group = F.array(*[F.array(*[F.lit(dihedral(a, b)) for b in range(10)]) for a in range(10)])
    numbered = F.transform(F.reverse(_digits(s)), lambda d, i: F.element_at(F.element_at(step, (i % 8 + 1).cast("int")), (d + 1).cast("int")))
    total = F.aggregate(numbered, F.lit(0), lambda c, p: F.element_at(F.element_at(group, c + 1), p + 1))
    return F.when(s.rlike("^[2-9][0-9]{11}$"), total == 0).otherwise(False)


def valid_card(raw: Column) -> Column:
    """13 to 19 digits with a right Luhn check digit."""
    s = _bare(raw)
    return F.when(s.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", s)).otherwise(False)


def valid_pan(raw: Column) -> Column:
    return F.upper(F.trim(raw)).rlike("^[A-Z]{3}[CPHFATBLJG][A-Z][0-9]{4}[A-Z]$")


def valid_iban(raw: Column) -> Column:
    """15 to 34 characters, country and check digits first, the remainder modulo 97 equal to 1."""
    s = F.upper(_bare(raw))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(value(c) > 9, (r * 100 + value(c)) % 97).otherwise((r * 10 + value(c)) % 97))
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def valid_phone(raw: Column) -> Column:
    """+91 and ten digits from 6 up, ten digits from 6 up, or + and 7 to 14 digits."""
    s = _bare(raw, r"[\s\-\(\)]")
    indian = s.startswith("+91") & (F.length(s) == 13)
    return F.when(indian, s.rlike(r"^\+91[6-9][0-9]{9}$")).otherwise(s.rlike("^[6-9][0-9]{9}$") | s.rlike(r"^\+[0-9]{7,14}$"))


VALID = {"PAN": valid_pan, "CREDIT_CARD": valid_card, "AADHAAR": valid_aadhaar, "IBAN": valid_iban, "PHONE": valid_phone}


def _found(text: Column, kind: str, pattern: str, confidence: float) -> Column:
    """Valid hits of one kind. Offsets come from the lengths of the hits and of the gaps between them."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("value"), F.lit(confidence).alias("confidence"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    check = VALID.get(kind)
    return F.filter(spans, lambda s: check(s["value"])) if check else spans


def detect(text: Column, plug_in: Callable[[Column], Column] | None = None) -> Column:
    """Spans of personal data, by start (longer first), overlaps with a kept one dropped.

    plug_in: a text column to a column of SPANS, as a trained detector gives them;
    its spans compete with the patterns' by the same rule.
    """
    everything = F.concat(*[_found(text, *p) for p in PATTERNS], *([F.coalesce(plug_in(text).cast(SPANS), F.array().cast(SPANS))] if plug_in else []))
    ordered = F.array_sort(everything, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    return F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("reach"), F.array().cast(SPANS).alias("kept")),
        lambda acc, s: F.when(s["start"] >= acc["reach"], F.struct(s["end"].alias("reach"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )


def mask(text: Column, spans: Column) -> Column:
    """struct<masked_text, token_map>: spans replaced by numbered tokens, one count over all kinds from 1."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("text"), F.array().cast("array<struct<token:string,value:string>>").alias("tokens"))

    def step(acc: Column, s: Column) -> Column:
        token = F.concat(F.lit("<PII:"), s["kind"], F.lit(":"), (acc["n"] + 1).cast("string"), F.lit(">"))
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        entry = F.struct(token.alias("token"), s["value"].alias("value"))
        return F.struct(s["end"].alias("at"), (acc["n"] + 1).alias("n"), F.concat(acc["text"], gap, token).alias("text"), F.concat(acc["tokens"], F.array(entry)).alias("tokens"))

    return F.aggregate(spans, start, step, lambda acc: F.struct(F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))).alias("masked_text"), F.map_from_entries(acc["tokens"]).alias("token_map")))


def redact(text: Column) -> Column:
    return mask(text, detect(text))["masked_text"]


def unmask(text: Column, token_map: Column) -> Column:
    return F.aggregate(F.map_entries(token_map), text, lambda t, e: F.replace(t, e["key"], e["value"]))
