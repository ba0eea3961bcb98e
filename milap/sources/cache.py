"""Recorded responses: a key-value cache with an age limit, and the fallback from one provider to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milap.functions.text import cache_key

#: Error messages by what they say, the first that occurs decides (fixed values).
ERRORS = (("timeout", "timeout|timed out"), ("rate_limited", "429|rate limit|quota"), ("unauthorized", "401|403|api key"), ("server_error", "5[0-9]{2}|server error"), ("client_error", "4[0-9]{2}"), ("network", "econn|network|fetch failed"))


def classify_error(message: Column) -> Column:
    """The kind of a provider's error; unknown if no pattern occurs or the message is null."""
    out = None
    for kind, pattern in ERRORS:
        hit = F.lower(message).rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def read_fresh(entries: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The latest entry of each key that is younger than ``days``; entries ``(provider, query, stored_at, payload)``."""
    w = Window.partitionBy("key").orderBy(F.col("stored_at").desc(), F.col("payload"))
    return entries.withColumn("key", cache_key(F.col("provider"), F.col("query"))).where(F.col("stored_at") > now - F.expr(f"INTERVAL {days} DAYS")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append(entries: DataFrame, path: str) -> None:
    """Store entries; empty payloads are never stored. The latest of a key wins when read."""
    entries.where("payload is not null and payload <> '' and payload <> '[]'").write.mode("append").parquet(path)


def with_fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Rows of the primary provider, and of the secondary for the keys where the primary has none."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"))


def stop_page(pages: DataFrame, key: str, page: str, item: str, target: int, stale: int = 2, most: int = 10) -> DataFrame:
    """Rows of the pages that a paged scan reads: until ``target`` distinct items, ``stale`` pages in a row without a new one, or page ``most``.

    A page is read if no earlier one met a reason to stop. Pages are rows ``(key, page, item)``.
    """
    first = pages.groupBy(key, item).agg(F.min(page).alias(page))
    news = pages.select(key, page).distinct().join(first.groupBy(key, page).agg(F.count("*").alias("new")), [key, page], "left").fillna(0, ["new"])
    w = Window.partitionBy(key).orderBy(page)
    run = news.withColumn("seen", F.sum("new").over(w)).withColumn("idle", (F.sum("new").over(w.rowsBetween(1 - stale, 0)) == 0) & (F.row_number().over(w) >= stale))
    stop = run.withColumn("stop", (F.col("seen") >= target) | F.col("idle") | (F.col(page) >= most)).groupBy(key).agg(F.min(F.when(F.col("stop"), F.col(page))).alias("last"))
    return pages.join(stop, key).where((F.col(page) <= F.col("last")) | F.col("last").isNull()).drop("last")


def usable_payload(payload: Column) -> Column:
    """Is a cached text an object with a non-empty array of results."""
    n = F.json_array_length(F.get_json_object(payload, "$.results"))
    return F.coalesce(n > 0, F.lit(False))
