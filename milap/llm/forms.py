"""Forms of business names: brand words by sound, and the trade the name states."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

#: Words that state a trade, by trade; first those that decide, then those that only hint (fixed values).
TRADES = {
    "dental": ("dental dntl dentist", "clinic cl"),
    "eye": ("eye", "hospital hosp hsptl"),
    "medical": ("medical med pharmacy medico", "hall"),
    "education": ("education educational edu consultancy cons", ""),
    "school": ("school secondary sec", ""),
    "fitness": ("fitness fit gym", ""),
    "law": ("law legal lawyer associates", "chamber chmbr"),
    "cleaning": ("cleaning cleaners", "service services srv svc"),
    "motor": ("motor motors auto workshop wshop", ""),
    "books": ("book books", "centre center ctr"),
    "sports": ("sports sprts", "academy acad"),
    "trekking": ("trekking trek treks", "agency"),
    "hardware": ("hardware hdwr", "store stores strs"),
    "guest": ("guest guesthouse ghouse lodge", "house"),
    "photo": ("photo foto", "studio std"),
    "party": ("party partypalace banquet", "palace plc"),
    "travel": ("travel travels", "international intl int"),
    "hair": ("hair barber salon saloon sln", ""),
    "cafe": ("cafe caffe caf coffee", ""),
    "food": ("restaurant resturant restro rest", ""),
}
#: Words of names that are neither brand nor trade: legal forms, titles, politeness, page furniture (fixed values).
PLAIN = frozenset("pvt ltd private limited co company sons and the shree shri ms dr adv er prof new official page home contact about us care shop unknown name untitled welcome na none null test business".split())
_STRONG = {w: t for t, (strong, _) in TRADES.items() for w in strong.split()}
_WEAK = {w: t for t, (_, weak) in TRADES.items() for w in weak.split()}
#: Short forms that punctuation would break up (fixed values).
SHORT = (("w/shop", "wshop"), ("g. house", "ghouse"), ("g/h", "ghouse"), ("int'l", "intl"))
_FURNITURE = re.compile(r"\bm/s\b|\bp\.? ?ltd\b|\bn/a\b|\bbest in \w+")
_TOKEN = re.compile(r"[a-z0-9]+")
#: Spellings of one sound, replaced in this order (fixed values).
SOUNDS = (("x", "ksh"), ("f", "ph"), ("chh", "ch"), ("w", "v"), ("bh", "b"), ("v", "b"), ("z", "j"), ("ee", "i"), ("oo", "u"), ("sh", "s"))
_TWICE = re.compile(r"(.)\1+")
_DOUBLED = re.compile(r"([bcdfghjklmnpqrstvwxyz])\1+")


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """One spelling for the spellings of a word: long vowels short, doubled letters single, look-alike consonants one."""
    word = _DOUBLED.sub(r"\1", word)
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return _TWICE.sub(r"\1", word)


def plain_text(text: str) -> str:
    """Lower case ASCII with entities decoded and accents dropped."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c if c.isascii() else ("" if unicodedata.combining(c) else " ") for c in text)
    return text.lower()


def parse_name(name: str | None) -> tuple[tuple[str, ...], str]:
    """Brand words by sound, in the order of the name, and the trade or ''. No brand words: the name means nothing.

    What follows a bar, a bracket or a dash between spaces is left out if two brand words precede it. A word of one letter is an initial.
    """
    if not name:
        return (), ""
    text = _FURNITURE.sub(" ", plain_text(name))
    for a, b in SHORT:
        text = text.replace(a, b)
    brand: list[str] = []
    strong = weak = ""
    for k, part in enumerate(re.split(r"\||\(|\)| - ", text)):
        if k and len(brand) >= 2:
            break
        for w in _TOKEN.findall(part):
            if w in _STRONG:
                strong = strong or _STRONG[w]
            elif w in _WEAK:
                weak = weak or _WEAK[w]
            elif w not in PLAIN:
                brand.append(sound(w))
    return tuple(brand), strong or weak
