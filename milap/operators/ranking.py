"""Scored top-k, stable in every tie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milap.functions import text, urls
from milap.operators.matching import SHARED_HOSTS

#: Points of the ranking of official websites, and the least score of one that is selected (fixed values).
POINTS = {"name": 12, "all": 10, "location": 10, "location_host": 4, "best": 12, "good": 8, "generic": 4, "other": 2, "short": 6, "contact": 4, "deep": -6, "third": -100, "unrelated": -40}
LEAST = 40


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; a group's rank window keeps only ``n`` rows per partition before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def website_score(url: Column, title: Column, name: Column, location: Column, listed: tuple[str, ...] = SHARED_HOSTS) -> tuple[Column, Column]:
    """``(score, eligible)`` of a URL as the official website of a named business.

    Points for the name's distinctive words in host or text, the location, the top-level domain and a short path; off for deep paths, articles and third parties.
    Eligible is a first-party host with a word of the name in it and a strict majority of the words in host or text.
    """
    host, said = urls.domain_or_host(url), F.lower(F.concat_ws(" ", url, title))
    words, places = text.distinctive_tokens(name), F.filter(F.split(text.locality_string(location), " "), lambda t: F.length(t) > 3)
    in_text = lambda t: F.regexp_instr(said, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), t)) > 0
    matched = F.size(F.filter(words, lambda t: F.contains(host, t) | in_text(t)))
    in_host = F.size(F.filter(words, lambda t: F.contains(host, t)))
    here = F.exists(places, in_text)
    segments, tier = urls.path_segments(url), urls.tld_tier(host)
    third = urls.third_party(host, listed) | (url.rlike(urls.DIRECTORY_PATH) & (in_host == 0))
    p = POINTS
    give = lambda c, k: F.when(c, p[k]).otherwise(0)
    score = (
        matched * p["name"] + give((F.size(words) > 0) & (in_host == F.size(words)), "all") + give(here, "location") + give(here & F.exists(places, lambda t: F.contains(host, t)), "location_host")
        + F.when(tier == "best", p["best"]).when(tier == "good", p["good"]).when(tier == "generic", p["generic"]).otherwise(p["other"])
        + F.when(segments <= 1, p["short"]).when(url.rlike(r"(?i)/(contact|about|enquiry|reach-us|get-in-touch)\b"), p["contact"]).otherwise(0)
        + give((segments >= 3) | url.rlike(urls.ARTICLE), "deep") + give(third, "third") + give((F.size(words) > 0) & (matched == 0) & ~here, "unrelated")
    )
    eligible = ~third & (in_host > 0) & (matched >= text.required_overlap(F.size(words)))
    return score, eligible


def lookup_score(phone: Column, address: Column, rating: Column, count: Column) -> Column:
    """How much is known of a place: a point each for phone and address, and for rating and number of ratings up to one."""
    has = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1.0).otherwise(0.0)
    return has(phone) + has(address) + F.coalesce(rating, F.lit(0.0)) / 5 + F.least(F.coalesce(count, F.lit(0)), F.lit(500)) / 500


def budget(mode: str, explicit: float | None, eligible: int, production: int = 10, ceiling: int = 50) -> int:
    """Lookups of a run: the explicit number, else ``production`` or in mode ``benchmark`` all, within ``ceiling`` and what is eligible.

    A negative or undefined explicit number counts as none given in production; unknown modes are production.
    """
    whole = explicit is not None and explicit == explicit and explicit >= 0
    wanted = int(explicit) if whole else (eligible if mode == "benchmark" else production)
    return max(0, min(wanted, ceiling, eligible))
