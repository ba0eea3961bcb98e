"""Phones of Nepal's numbering plan, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First three digits of mobile numbers (fixed values).
MOBILE_PREFIXES = ("984", "985", "986", "974", "975", "976", "980", "981", "982", "970", "988", "961", "962", "972")
#: Two-digit area codes outside the capital, where numbers have six more digits; the capital's is 1, with seven more (fixed values).
AREA_CODES = (
    "21", "23", "24", "25", "26", "27", "29", "41", "44", "46", "51", "53", "56", "57", "61", "63", "64", "65", "66", "67", "68", "69",
    "71", "75", "76", "77", "78", "81", "82", "83", "84", "91", "92", "93", "94", "97",
)
_MOBILE, _AREA = "|".join(MOBILE_PREFIXES), "|".join(AREA_CODES)
#: Candidates for phones in running text: international, mobile, landline (fixed patterns).
INTERNATIONAL_TEXT = r"\+[0-9][0-9\s()-]{6,24}"
MOBILE_TEXT = r"(?:^|[^0-9])((?:\+977[-.\s]?)?9[78][0-9][-.\s]?[0-9]{7})(?:[^0-9]|$)"
LANDLINE_TEXT = r"(?:^|[^0-9])((?:\+977[-.\s]?)?0[1-9][0-9]?[-.\s]?[0-9]{6,7})(?:[^0-9]|$)"


def sanitize(x: Column) -> Column:
    """From the first plus or digit to the last digit."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"^[^+0-9]+", ""), r"[^0-9]+$", "")


def digits_of(x: Column) -> Column:
    """ASCII digits only."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def match_digits(x: Column) -> Column:
    """Digits for matching: country code, doubled country code and trunk 0 taken off where the length shows them; '' for null."""
    d = digits_of(x)
    once = F.substring(d, 4, 60)
    return (
        F.when(d.startswith("9771") & (F.length(d) == 11), once)
        .when(d.startswith("97701") & (F.length(d) == 12), F.substring(d, 5, 60))
        .when(d.rlike("^977(98|97|96)") & (F.length(d) == 13), once)
        .when(d.startswith("977977"), F.when(F.length(once).isin(13, 14), F.substring(d, 7, 60)).otherwise(once))
        .when((F.length(d) == 9) & d.startswith("0"), F.substring(d, 2, 60))
        .otherwise(d)
    )


def classify(raw: Column) -> Column:
    """Struct ``(type, digits, reason)``: mobile, landline, international or invalid, canonical digits, and why invalid."""
    # each part is bound once, else the ladder would hold its whole text again and again
    return _let(sanitize(raw), lambda c: _let(digits_of(c), lambda d0: _let(F.when(d0.startswith("977977"), F.substring(d0, 4, 60)).otherwise(d0), lambda d: _ladder(raw, c, d0, d))))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), lambda v: body(v))[0]


def _ladder(raw: Column, c: Column, d0: Column, d: Column) -> Column:
    rest = F.substring(d, 4, 60)
    out = lambda kind, digits, reason=None: F.struct(F.lit(kind).alias("type"), digits.alias("digits"), F.lit(reason).cast("string").alias("reason"))
    balanced = F.length(F.regexp_replace(c, r"[^(]", "")) == F.length(F.regexp_replace(c, r"[^)]", ""))
    foreign = c.startswith("+") & F.length(d).between(8, 15) & balanced
    abroad = (
        F.when(rest.rlike(f"^({_MOBILE})"), F.when(F.length(rest) == 10, out("mobile", rest)).otherwise(out("invalid", d, "INCOMPLETE_MOBILE")))
        .when(rest.startswith("01"), F.when(F.length(rest) == 9, out("landline", F.substring(rest, 2, 60))).otherwise(out("invalid", d, "INCOMPLETE_LANDLINE")))
        .when(rest.startswith("1"), F.when(F.length(rest) == 8, out("landline", rest)).otherwise(out("invalid", d, "INCOMPLETE_LANDLINE")))
        .when(rest.rlike(f"^({_AREA})[0-9]{{6}}$"), out("landline", rest))
        .when(foreign, out("international", d))
        .otherwise(out("invalid", d, "INVALID_STRUCTURE"))
    )
    home = (
        F.when(d.rlike(f"^({_MOBILE})"), F.when(F.length(d) == 10, out("mobile", d)).otherwise(out("invalid", d, "INCOMPLETE_MOBILE")))
        .when(d.rlike(f"^0(1[0-9]{{7}}|({_AREA})[0-9]{{6}})$"), out("landline", F.substring(d, 2, 60)))
        .when(d.rlike(f"^(1[0-9]{{7}}|({_AREA})[0-9]{{6}})$"), out("landline", d))
        .when(foreign, out("international", d))
        .when(d.rlike("^(01|1)"), out("invalid", d, "INCOMPLETE_LANDLINE"))
        .otherwise(out("invalid", d, "INVALID_STRUCTURE"))
    )
    return (
        F.when(c == "", out("invalid", F.lit(""), "EMPTY"))
        .when(d0 == "", out("invalid", F.lit(""), "NO_DIGITS"))
        .when(F.trim(raw).rlike(r"\b\d{1,3}\.\d{4,8}\b"), out("invalid", d0, "COORDINATE_FLOAT"))
        .when(F.length(d) > 15, out("invalid", d, "TOO_LONG"))
        .when(d.startswith("977"), abroad)
        .otherwise(home)
    )


def display(kind: Column, digits: Column, raw: Column) -> Column:
    """Mobiles and the capital's landlines in one format; international numbers as written with a plus; others as written."""
    c = sanitize(raw)
    return (
        F.when((kind == "mobile") & (F.length(digits) == 10), F.concat(F.lit("+977-"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 20)))
        .when((kind == "landline") & (F.length(digits) == 8) & digits.startswith("1"), F.concat(F.lit("+977-01-"), F.substring(digits, 2, 20)))
        .when(kind == "international", F.when(c.startswith("+"), c).otherwise(F.concat(F.lit("+"), c)))
        .otherwise(F.coalesce(raw, digits))
    )


def extract(text: Column) -> Column:
    """Candidates in a text, international first, then mobiles and landlines; distinct, in order."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), g) for p, g in ((INTERNATIONAL_TEXT, 0), (MOBILE_TEXT, 1), (LANDLINE_TEXT, 1))))
    return F.array_distinct(F.transform(found, lambda v: F.trim(v)))


def expand_slashes(x: Column) -> Column:
    """``01-5363501/511`` as one number each: what follows a slash replaces as many last digits."""
    parts = F.split(x, r"\s*/\s*")
    head = parts[0]
    return F.transform(parts, lambda p, i: F.when((i == 0) | (F.length(p) >= F.length(head)), p).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - F.length(p)), p)))


def overlap(a: Column, b: Column) -> Column:
    """Do two numbers agree: the digits of one, seven at least, equal or held in the other's."""
    return (F.length(a) >= 7) & (F.length(b) >= 7) & (F.contains(a, b) | F.contains(b, a))
