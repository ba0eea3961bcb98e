"""Kinds of business, as expressions: what a name or a site says it is, and queries that depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of each kind of business, and the kinds it cannot be at the same time (fixed values).
KINDS = {
    "travel": ("tours travel trekking expedition adventure holiday vacation trip journey", "hotel"),
    "hotel": ("hotel lodge resort accommodation hostel motel inn stay lodging", "travel restaurant"),
    "restaurant": ("restaurant cafe coffee food dining kitchen bakery bar", "hotel"),
    "retail": ("shop store mart market retail emporium trading", "hotel restaurant"),
    "healthcare": ("hospital clinic medical health pharmacy dental doctor", "hotel restaurant travel"),
    "education": ("school college university academy institute education educational", "hotel restaurant travel"),
}
#: Words that decide the line of business before all others, then those that decide otherwise (fixed values).
FIRST_WORDS = {
    "driving": "driving driver drivers motor motors license licence vehicle vehicles trial",
    "furniture": "furniture furnishing furnishings interior interiors sofa wood wooden decor mattress",
    "dental": "dental dentist dentistry orthodontic oral",
    "beauty": "beauty salon parlour parlor hair spa cosmetic makeup barber barbershop unisex",
    "hardware": "hardware machinery tools sanitary tiles paint paints cement construction steel metal pipe pipes plywood",
    "fitness": "gym fitness workout",
    "venue": "banquet venue reception palace party hall",
}
THEN_WORDS = {
    "medical": "clinic hospital pharmacy medical",
    "education": "school college academy institute",
    "hospitality": "hotel resort restaurant cafe",
    "legal": "law lawyer advocate legal attorney",
    "retail": "store shop mart kirana grocery",
    "services": "service repair cleaning plumbing",
}
#: Searches that are for education (fixed values).
EDUCATION = ("schools", "school", "colleges", "college", "universities", "university", "education", "educational", "institutes", "institute")


def kind_of(text: Column, glued: bool = False) -> Column:
    """The one kind of business that ``text`` has words of; null for none and for several. ``glued``: words count inside others, as in hosts."""
    said = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    held = lambda w: F.contains(said, F.lit(w if glued else f" {w} "))

    def any_of(words: str) -> Column:
        out = F.lit(False)
        for w in words.split():
            out = out | held(w)
        return out

    hits = F.array_compact(F.array(*(F.when(any_of(words), k) for k, (words, _) in KINDS.items())))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def kinds_conflict(a: Column, b: Column) -> Column:
    """Can a business of the one kind not be one of the other; false where either is null. Symmetric."""
    pairs = [f"{k} {c}" for k, (_, against) in KINDS.items() for c in against.split()]
    return F.coalesce(F.concat_ws(" ", a, b).isin(*pairs) | F.concat_ws(" ", b, a).isin(*pairs), F.lit(False)) & a.isNotNull() & b.isNotNull()


def line_of_business(contexts: Column) -> Column:
    """The line of business of an array of texts: the first word, text by text, that decides; of the words that decide first, else of the others; else services."""
    words = F.flatten(F.transform(F.filter(contexts, lambda c: c.isNotNull()), lambda c: F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+")))

    def first(table: dict[str, str]) -> Column:
        flat = [w for ws in table.values() for w in ws.split()]
        known = F.get(F.filter(words, lambda w: w.isin(*flat)), F.lit(0))
        out = F.lit(None).cast("string")
        for k, ws in table.items():
            out = F.when(known.isin(*ws.split()), k).otherwise(out)
        return out

    return F.coalesce(first(FIRST_WORDS), first(THEN_WORDS), F.lit("services"))


def is_education(title: Column, category: Column, searched: Column) -> Column:
    """Is a place for education: by the kind its title and category say, or because education was searched for."""
    return F.coalesce(F.lower(F.trim(searched)).isin(*EDUCATION), F.lit(False)) | F.coalesce(kind_of(F.concat_ws(" ", title, category)) == "education", F.lit(False))


def second_query(title: Column, phone: Column, category: Column, location: Column, searched: Column) -> Column:
    """The one refined query of a place that a first search found no site for: name and phone, else name and location on education's suffix or with "official"; null without a name."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name, tel, at = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(phone, F.lit(""))), F.trim(F.coalesce(location, F.lit("")))
    base = F.when(at != "", F.concat(q(name), F.lit(" "), q(at))).otherwise(q(name))
    return F.when(name == "", None).when(F.length(tel) >= 6, F.concat(q(name), F.lit(" "), q(tel))).otherwise(F.concat(base, F.when(is_education(title, category, searched), " site:.edu.np").otherwise(" official")))
