"""Gates that label every row instead of dropping it, so that each outcome can be audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milap.functions.text import distinctive_tokens, name_key
from milap.functions.urls import ARTICLE, DIRECTORY_PATH, third_party
from milap.operators.matching import SHARED_HOSTS
from milap.session import stage

#: Names that are titles of pages and no businesses (fixed values).
GENERIC_PAGES = ("home", "homepage", "contact", "contact us", "about", "about us", "services", "gallery", "welcome", "untitled", "index", "official", "unknown name", "page not found")
ARTIFACT = r"(?i)^(top|best)\s+\d+|\b(near me|list of|in nepal \d{4}|things to do|how to|what is)\b|^\d+\s+best\b"
#: Phrases by which a page says that it is somebody else's (fixed patterns).
PORTAL = r"(?i)\b(claim (this|your) (listing|business)|add your business|write a review|business directory|compare prices)\b"


def relevance(said: Column, positive: Column, form: Column, excluded: Column) -> Column:
    """Struct ``(label, confidence)``: irrelevant by an excluded word (0.95), relevant by a wanted and a form word (0.90), by a wanted one (0.85), else ambiguous (0.30; 0 without wanted words).

    ``said`` is a key of words; the others are arrays of words.
    """
    words = F.split(said, " ")
    has = lambda terms: F.arrays_overlap(words, terms)
    out = lambda label, c: F.struct(F.lit(label).alias("label"), F.lit(c).alias("confidence"))
    return (
        F.when(F.coalesce(F.size(positive), F.lit(0)) < 1, out("ambiguous", 0.0)).when(has(excluded), out("irrelevant", 0.95)).when(has(positive) & has(form), out("relevant", 0.90)).when(has(positive), out("relevant", 0.85)).otherwise(out("ambiguous", 0.30))
    )


def artifact_name(name: Column) -> Column:
    """Is the name a list's, an article's or a page's title, or nothing."""
    k = name_key(name)
    return (k == "") | k.isin(*GENERIC_PAGES) | F.coalesce(name.rlike(ARTIFACT), F.lit(False))


def relationship(host: Column, url: Column, name: Column, text: Column, listed: tuple[str, ...] = SHARED_HOSTS) -> Column:
    """What a website is to a business: unverified without host, service_platform or directory by host, path or phrases, first_party by a distinctive word in the host, related_entity by none to tell, else unrelated."""
    words = distinctive_tokens(name)
    return (
        F.when(host == "", "unverified").when(host.rlike(r"\.(sitehost|weebpage|wixsite|blogspot|wordpress)\."), "service_platform").when(third_party(host, listed) | url.rlike(DIRECTORY_PATH) | F.coalesce(text.rlike(PORTAL), F.lit(False)), "directory")
        .when(F.exists(words, lambda t: (F.length(t) >= 4) & F.contains(host, t)), "first_party").when(F.size(words) == 0, "related_entity").otherwise("unrelated")
    )


def lifecycle(relation: Column, fetched: Column) -> Column:
    """absent, discovered, fetched or first_party_owned; the last only for first parties."""
    return F.when(relation == "unverified", "absent").when(~fetched, "discovered").when(relation == "first_party", "first_party_owned").otherwise("fetched")


def official(url: Column, host: Column, name: Column, listed: tuple[str, ...] = SHARED_HOSTS) -> Column:
    """May a URL be a business's website: absolute, no third party, no article; on news-like hosts only with a word of the name in it."""
    words = F.filter(F.split(name_key(name), " "), lambda t: F.length(t) >= 3)
    odd = host.rlike(r"(pulse|news)|\.(info|org)$") & (F.size(words) > 0) & ~F.exists(words, lambda t: F.contains(host, t))
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)) & (host != "") & ~third_party(host, listed) & ~F.coalesce(url.rlike(ARTICLE), F.lit(False)) & ~odd


def expand_queries(category: Column, location: Column, terms: Column, most: int = 6) -> Column:
    """The category as asked and its further terms, each with the location unless it holds it; distinct, the first ``most``."""
    at = lambda q: F.when((location == "") | F.contains(F.lower(q), F.lower(location)), q).otherwise(F.concat_ws(" ", q, location))
    return F.slice(F.array_distinct(F.transform(F.concat(F.array(category), F.coalesce(terms, F.array().cast("array<string>"))), lambda q: at(F.trim(q)))), 1, most)


def approved(candidates: DataFrame, approvals: DataFrame | None, on: str) -> DataFrame:
    """Candidates that a reviewer approved; all of them without a review."""
    return candidates if approvals is None else candidates.join(approvals.select(on).distinct(), on, "left_semi")


def one_to_one(pairs: DataFrame, left: str, right: str, order: str, max_rounds: int = 60) -> DataFrame:
    """Greedy one-to-one assignment: pairs in ``order``, ties by left, then right, each side used once.

    Equal to walking all pairs in order: in each round those pairs are taken that come first for both their sides, and what they use is removed. Rounds are few unless preferences form long chains.
    """
    rest = stage(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right, order), "pairs")
    done = None
    for _ in range(max_rounds):
        key = F.struct(order, left, right)
        first = lambda c: rest.groupBy(c).agg(F.min(key).alias(f"_{c}"))
        both = rest.withColumn("_k", key).join(first(left), left).join(first(right), right)
        won = stage(both.where((F.col("_k") == F.col(f"_{left}")) & (F.col("_k") == F.col(f"_{right}"))).select(left, right, order).distinct(), "won")
        if not won.limit(1).count():
            return done if done is not None else rest
        done = won if done is None else done.unionByName(won)
        rest = stage(rest.join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti"), "rest")
    raise RuntimeError(f"assignment is not done after {max_rounds} rounds")
