"""Names, addresses, keys and plain text, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal words of a name that don't tell businesses apart (fixed values).
LEGAL = ("pvt", "ltd", "llc", "inc", "co", "corp", "the", "and")
#: Entities decoded in names, in this order (fixed values).
ENTITIES = (("&amp;", "&"), ("&#38;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
#: Words of names that are common to a kind of business (fixed values; pass others to ``distinctive_tokens``).
GENERIC = (
    "dental", "clinic", "hospital", "medical", "hall", "pharmacy", "school", "secondary", "college", "academy", "sports", "education", "educational", "consultancy",
    "law", "chamber", "legal", "associates", "gym", "fitness", "club", "cafe", "coffee", "restaurant", "hotel", "guest", "house", "party", "palace", "travel", "travels",
    "trekking", "agency", "international", "hair", "salon", "saloon", "photo", "studio", "book", "centre", "center", "hardware", "store", "motor", "workshop", "cleaning",
    "service", "services", "eye", "care", "nepal", "private", "limited", "sons", "shree", "dr", "adv",
)


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up on the binary value, as ``floor(x * 10^n + 0.5) / 10^n``."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def name_key(x: Column) -> Column:
    """Lower case words without punctuation and legal words; '' for null."""
    words = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\w\s]", " ")
    return squeeze(F.regexp_replace(words, r"\b(" + "|".join(LEGAL) + r"|p\s*ltd)\b", " "))


def decode_entities(x: Column) -> Column:
    """The common HTML entities of names."""
    return reduce(lambda c, e: F.regexp_replace(c, "(?i)" + e[0], e[1]), ENTITIES, F.coalesce(x, F.lit("")))


def name_key_lenient(x: Column) -> Column:
    """``name_key`` after ``decode_entities``."""
    return name_key(decode_entities(x))


def address_key(x: Column) -> Column:
    """Lower case words without punctuation; '' for null."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\w\s]", " "))


def locality_string(x: Column) -> Column:
    """Lower case, with comma, hyphen, underscore and slash as spaces."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[,\-_/]", " "))


def query_key(x: Column) -> Column:
    """Trimmed, lower case, single spaces; '' for null."""
    return squeeze(F.lower(F.coalesce(x, F.lit(""))))


def canonical_key(name: Column, location_key: Column) -> Column:
    """``name:<key>|<location>``, or '' for a name without a key; an absent location is ``unknown-location``."""
    place = F.coalesce(F.nullif(location_key, F.lit("")), F.lit("unknown-location"))
    return F.when(name_key(F.trim(name)) == "", "").otherwise(F.concat(F.lit("name:"), name_key(F.trim(name)), F.lit("|"), place))


def cache_key(provider: Column, query: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``provider::query``."""
    return F.substring(F.sha2(F.concat_ws("::", provider, query), 256), 1, 16)


def slug(x: Column, most: int = 50) -> Column:
    """Lower case letters and digits with single hyphens between, at most ``most`` characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.substring(s, 1, most)


def tokens(key: Column, least: int = 2) -> Column:
    """Distinct words of a key of at least ``least`` letters, in order."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: F.length(t) >= least))


def distinctive_tokens(name: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Words of the lenient key that aren't generic; of a name of generic words only, none."""
    return F.array_except(tokens(name_key_lenient(name)), F.array(*map(F.lit, generic)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two keys' words of two letters or more; 0 if either has none."""
    x, y = tokens(a), tokens(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(x, y)))


def names_align(a: Column, b: Column) -> Column:
    """Do two names agree in their distinctive words: half or all of one's, at least one of four letters or both single."""
    x, y, ka, kb = distinctive_tokens(a), distinctive_tokens(b), name_key_lenient(a), name_key_lenient(b)
    both = F.array_intersect(x, y)
    held = (ka != "") & (kb != "") & (F.contains(ka, kb) | F.contains(kb, ka))
    strong = F.exists(both, lambda t: F.length(t) >= 4) | ((F.size(x) == 1) & (F.size(y) == 1))
    enough = (F.size(both) * 2 >= F.size(F.array_union(x, y))) | (F.size(both) == F.size(x)) | (F.size(both) == F.size(y))
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit("")))
        .when((F.size(x) == 0) & (F.size(y) == 0), held | (ka == kb))
        .when((F.size(x) == 0) | (F.size(y) == 0) | (F.size(both) == 0), False)
        .otherwise(held | (strong & enough))
    )


def names_align_for_evidence(a: Column, b: Column, phone_matches: Column, domain_matches: Column, modifiers: tuple[str, ...] = ()) -> Column:
    """``names_align`` with two shared brand words, or one and a matching phone, domain or containing name.

    ``modifiers`` (surnames, places, lines of business) are no brand words unless a name has nothing else.
    """
    ka, kb = name_key(a), name_key(b)
    drop = lambda x: F.array_except(x, F.array(*map(F.lit, modifiers)).cast("array<string>"))
    brand = lambda x: F.when(F.size(drop(x)) > 0, drop(x)).otherwise(x)
    shared = F.size(F.array_intersect(brand(distinctive_tokens(a)), brand(distinctive_tokens(b))))
    contains = (ka != "") & (kb != "") & (F.contains(ka, kb) | F.contains(kb, ka))
    plain = (F.size(distinctive_tokens(a)) == 0) | (F.size(distinctive_tokens(b)) == 0)
    return names_align(a, b) & F.when(plain, (ka != "") & (ka == kb)).otherwise((shared >= 2) | ((shared == 1) & (phone_matches | domain_matches | contains)))


def clean_array(x: Column) -> Column:
    """Trimmed, without nulls and empty strings, distinct in order; [] for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))


def strip_html(x: Column) -> Column:
    """Text without scripts, styles, comments and tags, entities decoded, white space squeezed."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return squeeze(decode_entities(F.regexp_replace(t, r"<[^>]+>", " ")))


def strip_noise(x: Column) -> Column:
    """Text without images, links, dates and times; numbers of ``tel:`` and ``wa.me`` links are kept at the end."""
    kept = F.array_join(F.regexp_extract_all(x, F.lit(r"(?:tel:|wa\.me/)(\+?[0-9][0-9 -]{5,})"), 1), " ")
    t = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)|https?://[^\s)]+|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}:\d{2}(?:\s*[ap]m)?\b", " ")
    return squeeze(F.concat_ws(" ", t, kept))


def trailing_punctuation(x: Column) -> Column:
    """Without closing punctuation at the end."""
    return F.regexp_replace(x, r"[.,;:!?)\]]+$", "")


def context_around(x: Column, needle: Column, reach: int = 150) -> Column:
    """The text around the first occurrence of ``needle``, ``reach`` characters to either side; '' if there is none."""
    at = F.instr(x, needle)
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substring(x, start, at - start + F.length(needle) + reach)).otherwise("")


def content_summary(pages: Column) -> Column:
    """The first 200 characters of the first three pages, joined, at most 600."""
    return F.substring(F.array_join(F.transform(F.slice(pages, 1, 3), lambda p: F.substring(p, 1, 200)), " "), 1, 600)


def hours_text(hours: Column) -> Column:
    """A map of day to time as ``day: time, day: time``."""
    return F.array_join(F.transform(F.map_entries(hours), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")


def required_overlap(n: Column) -> Column:
    """A strict majority of ``n``, two at least; 0 of none and 1 of one."""
    return F.when(n <= 0, 0).when(n == 1, 1).otherwise(F.greatest(F.lit(2), F.floor(n / 2) + 1)).cast("int")


def parse_json_rows(x: Column, schema: str) -> Column:
    """Rows of a JSON array in a text that may be fenced, have bare keys or closing commas; null if it can't be read."""
    body = F.regexp_extract(F.regexp_replace(x, "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    quoted = F.regexp_replace(F.regexp_replace(body, r",\s*([\]}])", "$1"), r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')
    return F.from_json(quoted, schema, {"mode": "PERMISSIVE"})


def brand_segment(name: Column) -> Column:
    """What stands before the first colon, bar or dash between spaces, if that has two letters; else the name."""
    first = F.trim(F.get(F.split(name, r"\s*[:|]\s*|\s+[-–—]\s+"), F.lit(0)))
    return F.when(F.length(first) >= 2, first).otherwise(name)


#: Who made a website, as pages say it: comments and author tags, then phrases before a name in capitals (fixed patterns).
VENDOR_MARKS = (r"(?i)<!--\s*(?:powered|built|designed|developed)\s+by[^>]{0,60}-->", r"(?i)<meta\s[^>]*name=[\"']author[\"'][^>]*>")
VENDOR_LEADS = (r"(?:[Ww]ebsite\s+)?(?:[Dd]eveloped|[Dd]esigned(?:\s+&\s+[Dd]eveloped)?)\s+by", r"\b[Bb]uilt\s+by", r"\b[Pp]owered\s+by", r"\b[Bb]uilt\s+with", r"\b[Cc]reated\s+with")


def without_vendor(x: Column) -> Column:
    """Text without the lines in which a site's maker signs, spaces squeezed and empty lines single; '' for null."""
    out = F.coalesce(x, F.lit(""))
    for mark in VENDOR_MARKS:
        out = F.regexp_replace(out, mark, " ")
    for lead in VENDOR_LEADS:
        out = F.regexp_replace(out, lead + r"\s+[A-Z][A-Za-z0-9\s.&'-]{1,40}(?=\.|\n|$|<)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\S\r\n]+", " "), r"\n\s*\n", "\n\n"))


def union_of(*arrays: Column) -> Column:
    """The distinct non-empty values of several arrays, in order of appearance; null arrays hold none."""
    return clean_array(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))
