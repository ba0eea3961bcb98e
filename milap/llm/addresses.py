"""Parts of a typed address: street, house number, ward and the words that name the place."""

from __future__ import annotations

import re

from milap.llm.forms import plain_text, sound

#: Words of addresses by what they mean (fixed values).
STREET = "marga|marg|mg|road|rd|street|st|sadak|lane|galli"
COUNTRY = frozenset("nepal np".split())
TOWN = frozenset("municipality mun metropolitan metro city rural sub rm mc m nagarpalika gaunpalika".split())
FILLER = frozenset("the of and address location at in new get direction directions house ghar no number ward wd w h block shop floor".split())
_NOISE = re.compile(
    r"!\[[^\]]*\]\([^)]*\)|https?://\S+|\bget directions?\b|\baddress:|"
    r"\b(?:near|opp|opposite|behind|beside|next to|in front of|close to)\b\.?\s+(?:the\s+)?(?:old\s+|new\s+)?(?:[a-z]+\s+)??(?:chowk|bank|pump|park|temple|mandir|school|hospital|bridge|gate|office|market|stand|campus|hall|tower)\b|"
    r"\b(?:ground|first|second|third|top|\d+(?:st|nd|rd|th))\s+(?:floor|fl)\b|\b(?:\d+|g)/f\b|\bfloor\s+\d+\b|"
    r"\b(?:shop|block|room|flat|suite|unit)\s*(?:no\.?|number|#)?\s*[-.]?\s*(?:\d+[a-z]?|[a-z])\b"
)
_POST = re.compile(r"\b\d{5}\b")
_WARD = re.compile(r"\b(?:ward|wd|w)\b\.?\s*(?:no\b\.?|number)?\s*[-.:#]*\s*(\d{1,2})\b")
_N = r"(\d{1,4}(?:/\d{1,3})?[a-z]?)"
_HOUSE = re.compile(rf"(?:\bh\.?\s*no\b\.?|\bhouse\s*(?:no\b\.?|number)?|\bghar\s*(?:no\b\.?|number)?|\bno\b\.?|#)\s*[-.:#]*\s*{_N}\b")
_STREET = re.compile(rf"(?:\b{_N}\s*[,/]?\s+)?\b([a-z]{{2,}})\s+(?:{STREET})\b\.?(?:\s*[-,#]?\s*(?:no\b\.?\s*)?{_N}\b)?")
_BESIDE = re.compile(r"\s*[,]?\s*([a-z]{3,})")
_TYPE = re.compile(rf"^(?:{STREET})$")
_NUMBERED = re.compile(r"\b([a-z]{3,})\s*-?\s*(\d{1,2})\b")
_PLAIN = re.compile(rf"(?:^|,)\s*{_N}\s*,?\s+([a-z]{{3,}})\s*(?=,|$)")
_ALONE = re.compile(rf"(?:^|,)\s*{_N}\s*(?=,|$)")
_WORD = re.compile(r"[a-z]{2,}")
_BESIDE_NUMBER = re.compile(r"\b([a-z]{3,})(?=\s*[-,#]?\s*\d{1,4}[a-z]?\b)|(?<![\d-])\b\d{1,4}[a-z]?\s*,?\s+([a-z]{3,})\b")
_LAND = re.compile(r"\b(?:" + "|".join(sorted(COUNTRY)) + r")\b\.?")
_SEP = re.compile(r"[\n;|·]+| - ")


def parse_address(text: str | None) -> tuple[str, str, str, str, list[str]]:
    """``(street, number, ward, postcode, places)`` of an address, '' where not stated; words by sound.

    ``places`` are the remaining words, in order. Floors, shops, landmarks, links and the country are left out. A number after a place's
    name is its ward; one beside the street or after "house no", "ghar no", "no" or "#" is the house's.
    """
    if not text:
        return "", "", "", "", []
    t = _LAND.sub(" , ", _SEP.sub(" , ", _NOISE.sub(" ", plain_text(text))))
    post = _POST.search(t)
    if post:
        t = _POST.sub(" , ", t)
    ward = ""
    if m := _WARD.search(t):
        ward, t = m[1], t[: m.start()] + " , " + t[m.end() :]
    number = street = ""
    if m := _HOUSE.search(t):
        number = m[1]
        t = t[: m.start()] + " @ " + t[m.end() :]
    if m := _STREET.search(t):
        street = m[2]
        if not number:
            number = m[3] or m[1] or ""
            # with a number on either side, the one before is a ward of what precedes it
            t = t[: m.start(2) if m[3] else m.start()] + " , " + t[m.end() :]
        else:
            # a number before the street may still be a ward of what precedes it
            t = t[: m.start(2)] + " , " + (t[m.start(3) : m.end(3)] if m[3] else "") + t[m.end() :]
    elif number:
        # no word for the street: the word beside the house number, after it or else before
        at = t.index("@")
        after, before = _BESIDE.match(t, at + 1), re.search(r"([a-z]{3,})\s*,?\s*$", t[:at])
        hit = after or before
        if before and re.search(r",\s*@", t[: at + 1]) is None and (after is None or "," in t[at : after.start(1)]):
            hit = before
        if hit:
            street = hit[1]
            t = t[: hit.start(1)] + " , " + t[hit.end(1) :]
    t = t.replace("@", ",")
    if not street and not number and (m := _PLAIN.search(t)):
        # a number with a word and nothing else between commas: the house and its street
        number, street = m[1], m[2]
        t = t[: m.start()] + " , " + t[m.end() :]
    if not ward and (m := _NUMBERED.search(t)) and m[1] not in FILLER and not _TYPE.match(m[1]):
        ward = m[2]
        t = t[: m.start(2)] + " " + t[m.end(2) :]
    if m := _ALONE.search(t):
        if street and not number:
            number = m[1]
        elif not ward and m[1].isdigit():
            ward = m[1]
    places = [sound(w) for w in _WORD.findall(t) if w not in COUNTRY and w not in TOWN and w not in FILLER and not _TYPE.match(w)]
    return sound(street) if street not in FILLER else "", number.lstrip("0"), ward.lstrip("0"), post[0] if post else "", places


def other_readings(text: str | None) -> list[tuple[str, str, str, str, list[str]]]:
    """Readings of an address without a marked street: each of its words beside a number taken for the street, with that number."""
    plain = plain_text(text or "")
    out = []
    for m in _BESIDE_NUMBER.finditer(plain):
        word = m[1] or m[2]
        if word in FILLER or word in TOWN or word in COUNTRY or _TYPE.match(word):
            continue
        at = m.end(1) if m[1] else m.end(2)
        read = parse_address(plain[:at] + " street" + plain[at:])
        if read[0] and read[1] and read not in out:
            out.append(read)
    return out
