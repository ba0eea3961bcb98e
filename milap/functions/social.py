"""Profiles on social networks, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from milap.functions.text import distinctive_tokens
from milap.functions.urls import domain_of, path_of

#: Networks by their domain's first label (fixed values).
PLATFORMS = ("facebook", "instagram", "tiktok", "linkedin", "youtube", "twitter", "x")
#: Path segments that are no profile (fixed values).
ACTIONS = ("share", "sharer", "sharer.php", "dialog", "plugins", "login", "home", "watch", "hashtag", "search", "explore", "events", "groups", "help", "policies", "privacy", "intent", "tr")


def platform_of(url: Column) -> Column:
    """The network of a profile's URL, '' for other URLs."""
    with_scheme = F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    label = F.regexp_extract(F.regexp_replace(domain_of(with_scheme), r"^(m|web|mobile)\.", ""), r"^([a-z]+)\.", 1)
    return F.when(label.isin(*PLATFORMS), F.when(label == "x", "twitter").otherwise(label)).otherwise("")


def handle_of(url: Column) -> Column:
    """The profile's handle: the first path segment, the slug without id under ``people`` and ``p``, the id of ``profile.php``; '' if the URL is no profile."""
    with_scheme = F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    seg = F.filter(F.split(path_of(with_scheme), "/"), lambda s: s != "")
    first, second = F.lower(F.coalesce(F.get(seg, F.lit(0)), F.lit(""))), F.lower(F.coalesce(F.get(seg, F.lit(1)), F.lit("")))
    h = (
        F.when(first == "profile.php", F.regexp_extract(url, r"[?&]id=([0-9]+)", 1))
        .when(first.isin("people", "pages", "p", "pg", "in", "company", "channel", "c", "user"), F.regexp_replace(second, "-[0-9]{5,}$", ""))
        .when(first.isin(*ACTIONS), "")
        .otherwise(F.regexp_replace(first, "^@", ""))
    )
    return F.when(platform_of(url) == "", "").otherwise(F.regexp_replace(h, "[^a-z0-9._-]", ""))


def canonical_social(url: Column) -> Column:
    """``https://<network>/<handle>``, '' for no profile."""
    return F.when(handle_of(url) == "", "").otherwise(F.concat(F.lit("https://"), platform_of(url), F.lit("/"), handle_of(url)))


def classify_social(url: Column, name: Column) -> Column:
    """Struct ``(platform, handle, profile_type, status, reason)``.

    Accepted is a profile whose handle holds a distinctive word of the name, four letters at least, or all of them; a numeric handle is held for corroboration.
    """
    p, h = platform_of(url), handle_of(url)
    words = F.filter(distinctive_tokens(name), lambda t: F.length(t) >= 4)
    flat = F.regexp_replace(h, "[^a-z0-9]", "")
    named = F.exists(words, lambda t: F.contains(flat, t))
    kind = F.when(F.lower(url).rlike("/(people|in)/"), "personal_profile").when(F.lower(url).rlike("/groups/"), "group").when(h == "", "no_profile").otherwise("page")
    status = F.when((p == "") | (h == ""), "rejected").when(h.rlike("^[0-9]+$"), "uncertain").when(named, "accepted").otherwise("rejected")
    reason = F.when(p == "", "NOT_SOCIAL").when(h == "", "NO_PROFILE").when(h.rlike("^[0-9]+$"), "NUMERIC_ID").when(named, "NAME_IN_HANDLE").otherwise("BUSINESS_NAME_MISMATCH")
    return F.struct(p.alias("platform"), h.alias("handle"), kind.alias("profile_type"), status.alias("status"), reason.alias("reason"))
