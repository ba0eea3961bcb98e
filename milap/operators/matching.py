"""Joins that find which records are one business, by blocking on what they share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from milap.functions import phones, text, urls
from milap.session import stage

#: Hosts that belong to networks, directories and maps and identify nobody. Others are found in the data, by ``directories``.
SHARED_HOSTS = urls.SHARED


def directories(rows: DataFrame, least: int = 5) -> DataFrame:
    """``(host)`` of hosts in ``(host, name)`` rows that are nobody's own: with ``least`` named rows or more, of which no word of four letters or more is in half of the names.

    ``name`` is a key. Rows without a host or a name say nothing.
    """
    named = rows.where("host <> '' and name <> ''").select("host", F.array_except(text.tokens(F.col("name"), 4), F.array(*map(F.lit, text.GENERIC))).alias("words"))
    total = named.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    most = named.select("host", F.explode("words").alias("w")).groupBy("host", "w").agg(F.count("*").alias("k")).groupBy("host").agg(F.max("k").alias("k"))
    return total.join(most, "host", "left").where(F.coalesce("k", F.lit(0)) * 2 < F.col("n")).select("host")


def own_hosts(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two evidence views, with the hosts that both together show to be directories' left out."""
    shared = stage(directories(a.select("host", "name").unionByName(b.select("host", "name"))), "directories").withColumn("_shared", F.lit(True))
    clear = lambda df: df.join(shared, "host", "left").withColumn("host", F.when(F.col("_shared"), "").otherwise(F.col("host"))).select(*df.columns)
    return clear(a), clear(b)


def evidence_view(df: DataFrame, id_col: str, name: str, phone: str, site: str, address: str, shared: tuple[str, ...] = SHARED_HOSTS) -> DataFrame:
    """``(id, phone, host, name, address)`` in the forms that are compared; '' where nothing usable is given."""
    p, h = phones.match_digits(F.col(phone)), urls.domain_or_host(F.col(site))
    return df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.when(F.length(p) >= 7, p).otherwise("").alias("phone"), F.when(urls.third_party(h, shared) | ~F.contains(h, F.lit(".")), "").otherwise(h).alias("host"),
        text.name_key(F.col(name)).alias("name"), text.address_key(F.col(address)).alias("address"),
    )


def pair_cascade(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(a_id, b_id, method, confidence)`` of the pairs of two evidence views that match.

    Equal phones or hosts match (1.0). Otherwise, unless both have a phone or both a host and these differ, names with a Jaccard similarity of 0.85 and addresses of 0.5 match (0.85), and names of
    0.95 do (0.9). Candidates share a phone, a host, or one of the rarest words of both names: as many of them as names of 0.85 cannot all miss, so no pair is lost.
    """
    def contacts(df: DataFrame) -> DataFrame:
        return df.select("id", F.explode(F.array(F.concat(F.lit("p"), F.nullif("phone", F.lit(""))), F.concat(F.lit("h"), F.nullif("host", F.lit(""))))).alias("key")).where("key is not null")

    def words(df: DataFrame) -> DataFrame:
        return df.select("id", F.xxhash64("name").alias("v"), F.explode(text.tokens(F.col("name"))).alias("w"), F.size(text.tokens(F.col("name"))).alias("n"))

    # a name's words from rare to frequent; names that reach 0.85 share one of the first n - ceil(0.85 n) + 1, whatever the order is
    wa, wb = stage(words(a), "words_a"), stage(words(b), "words_b")
    often = stage(wa.select("w").unionByName(wb.select("w")).groupBy("w").agg(F.count("*").alias("f")), "often")
    rare = Window.partitionBy("id", "v").orderBy("f", "w")
    prefix = lambda df: df.join(often, "w").withColumn("k", F.row_number().over(rare)).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * 0.85 - 1e-9) + 1).select("id", F.concat(F.lit("n"), "w").alias("key"), "n")
    by_name = prefix(wa).select(F.col("id").alias("a_id"), "key", F.col("n").alias("na")).join(prefix(wb).select(F.col("id").alias("b_id"), "key", F.col("n").alias("nb")), "key").where((F.col("na") >= 0.85 * F.col("nb") - 1e-9) & (F.col("nb") >= 0.85 * F.col("na") - 1e-9)).select("a_id", "b_id")
    by_contact = contacts(a).select(F.col("id").alias("a_id"), "key").join(contacts(b).select(F.col("id").alias("b_id"), "key"), "key").select("a_id", "b_id")
    met = by_contact.unionByName(by_name).distinct()
    x = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns))
    y = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    pairs = met.join(x, "a_id").join(y, "b_id")
    same = lambda c: (F.col(f"a_{c}") != "") & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    apart = lambda c: (F.col(f"a_{c}") != "") & (F.col(f"b_{c}") != "") & (F.col(f"a_{c}") != F.col(f"b_{c}"))
    n, d = (text.token_jaccard(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in ("name", "address"))
    rule = F.when(same("phone"), "phone").when(same("host"), "domain").when(apart("phone") | apart("host"), "none").when((n >= 0.85) & (d >= 0.5), "name_address").when(n >= 0.95, "name").otherwise("none")
    confidence = F.when(F.col("method").isin("phone", "domain"), 1.0).when(F.col("method") == "name", 0.9).otherwise(0.85)
    return pairs.withColumn("method", rule).where("method <> 'none'").select("a_id", "b_id", "method", confidence.alias("confidence"))


def first_wins(df: DataFrame, block: str, order: str, same) -> DataFrame:
    """Rows that ``same(row, kept_row)`` calls equal to no row kept before them in their block, in order of ``order``.

    The rule isn't transitive, so a block is walked in order, in one task: blocks are to be small, as of exact keys. A null block is a block.
    """
    def walk(g: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in g.sort_values(order, kind="stable").itertuples():
            if not any(same(row, k) for k in kept):
                kept.append(row)
        return g.loc[[k.Index for k in kept]]

    return df.groupBy(block).applyInPandas(walk, df.schema)


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """Left join with the one right row that comes first in ``order``; columns of the right that clash are to be renamed before."""
    w = Window.partitionBy(*on).orderBy(order)
    return left.join(right.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"), on, "left")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the left without partner; null keys have none."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def backfill(rows: DataFrame, known: DataFrame, on: str, column: str) -> DataFrame:
    """``rows`` with missing values of ``column`` taken from the smallest known value of the same key."""
    value = known.where(F.col(on).isNotNull() & (F.coalesce(column, F.lit("")) != "")).groupBy(on).agg(F.min(column).alias("_known"))
    return rows.join(value, on, "left").withColumn(column, F.coalesce(F.nullif(column, F.lit("")), "_known")).drop("_known")


def geocoded(asked: DataFrame, registry: DataFrame, cached: DataFrame, on: str) -> DataFrame:
    """``asked`` with ``lat``, ``lng`` and ``found_in``: the registry first, then the cache, else null; one row each. A registry entry wins over a stale cached one."""
    first = lambda df, tag: df.where(f"{on} is not null and lat is not null and lng is not null").groupBy(on).agg(F.min(F.struct("lat", "lng")).alias(tag))
    both = asked.join(first(registry, "_r"), on, "left").join(first(cached, "_c"), on, "left")
    best = F.coalesce("_r", "_c")
    return both.withColumn("lat", best["lat"]).withColumn("lng", best["lng"]).withColumn("found_in", F.when(F.col("_r").isNotNull(), "registry").when(F.col("_c").isNotNull(), "cache")).drop("_r", "_c")
