"""Verification of websites and the confidence of listings, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from milap.functions.text import js_round

#: Weights of the signs that a website is the business's (fixed values).
SIGNS = {"gate": 0.15, "domain": 0.05, "name": 0.25, "phone": 0.25, "address": 0.15, "email": 0.10, "social": 0.05}
#: How far evidence of a website counts, by its relation to the business; others count 0.1 (fixed values).
RELATIONS = {"first_party": 1.0, "corporate_parent": 0.9, "related_entity": 0.7, "directory": 0.3, "service_platform": 0.25, "marketplace": 0.2, "unverified": 0.1, "unrelated": 0.05}
#: What is left of the confidence in a conflict (fixed values).
PENALTIES = {"SHARED_OFFICE": 0.9, "RELATED_BRAND": 0.85, "POSSIBLY_SAME_ENTITY": 0.75, "DUPLICATE_MAPS_LISTING": 0.65}


def token_coverage(key: Column, content: Column) -> Column:
    """Share of the key's words of three letters or more that the content holds; 0 of none."""
    words = F.filter(F.split(key, " "), lambda t: F.length(t) >= 3)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda t: F.contains(content, t))) / F.size(words))


def verification(signs: dict[str, Column], has_pages: Column) -> Column:
    """Struct ``(status, confidence)``: failed without gate or pages, verified by name and phone or name, address and domain, partial by two signs, else weak."""
    s = {k: F.coalesce(signs[k], F.lit(False)) for k in SIGNS}
    n = sum((s[k].cast("int") for k in ("name", "phone", "address", "email", "social")), F.lit(0))
    status = F.when(~(s["gate"] & has_pages), "failed").when(s["name"] & (s["phone"] | (s["address"] & s["domain"])), "verified").when(n >= 2, "partial").otherwise("weak")
    total = sum((F.when(s[k], w).otherwise(0.0) for k, w in SIGNS.items()), F.lit(0.0))
    return F.struct(status.alias("status"), F.when(status == "failed", 0.0).otherwise(F.least(F.lit(1.0), js_round(total, 2))).alias("confidence"))


def maps_confidence(is_maps: Column, ratings: Column, place_id: Column, gps: Column, address: Column) -> Column:
    """0.8 for a map hit, more for many ratings, a place id, a position and an address."""
    r = F.coalesce(ratings, F.lit(0))
    bonus = F.when(r >= 200, 0.15).when(r >= 50, 0.10).otherwise(0.0) + sum((F.when(F.coalesce(c, F.lit(False)), 0.05).otherwise(0.0) for c in (place_id, gps, address)), F.lit(0.0))
    return F.when(is_maps, js_round(F.least(F.lit(0.8) + bonus, F.lit(1.0)), 2)).otherwise(0.0)


def website_confidence(verified: Column, relation: Column) -> Column:
    """The verification's confidence times what the relation counts; 0 without evidence."""
    m = F.lit(0.1)
    for k, v in RELATIONS.items():
        m = F.when(relation == k, v).otherwise(m)
    return F.coalesce(js_round(F.least(verified * m, F.lit(1.0)), 2), F.lit(0.0))


def contact_confidence(phone_matches: Column, email: Column, address: Column, n_phones: Column) -> Column:
    """0.4 for a matching phone, 0.3 for an e-mail, 0.2 for the address, 0.1 for two phones or more."""
    parts = ((phone_matches, 0.4), (email, 0.3), (address, 0.2), (n_phones >= 2, 0.1))
    return js_round(F.least(sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in parts), F.lit(0.0)), F.lit(1.0)), 2)


def conflict_penalty(kind: Column) -> Column:
    """Factor of the confidence in a conflict; 1 without one."""
    p = F.lit(1.0)
    for k, v in PENALTIES.items():
        p = F.when(kind == k, v).otherwise(p)
    return p


def overall_confidence(maps: Column, website: Column, contact: Column, penalty: Column, maps_only: Column) -> Column:
    """Maps 0.3, website and contacts 0.35 each; of map hits alone, maps 0.65 and a base of 0.5; times the penalty, in hundredths."""
    raw = F.when(maps_only, maps * 0.65 + 0.175).otherwise(maps * 0.3 + website * 0.35 + contact * 0.35)
    return js_round(F.least(raw * penalty, F.lit(1.0)), 2)
