"""Queries of the training-data problems on entities and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milap.llm import buildings, components, leaks, levels, mixing, names, retrieval, survivor
from milap.session import stage, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings linked by conflicts, directly or through others, with the smallest index of their group.

    A null ``conflict_type`` is not ``NO_CONFLICT`` and links.
    """
    listed = table(spark, sf_dir, "listings").select(F.col("listing_index").alias("i"))
    links = table(spark, sf_dir, "conflicts").where("conflict_type is null or conflict_type <> 'NO_CONFLICT'").select(F.col("listing_index_a").alias("a"), F.col("listing_index_b").alias("b")).where("a <> b").distinct()
    both = links.join(listed, F.col("a") == F.col("i"), "left_semi").join(listed, F.col("b") == F.col("i"), "left_semi")
    return components.hash_to_min(both, "a", "b").select(F.col("node").alias("listing_index"), "group_id")


P4_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT listing_index_a AS a, listing_index_b AS b FROM conflicts
  WHERE conflict_type IS DISTINCT FROM 'NO_CONFLICT' AND listing_index_a <> listing_index_b
    AND listing_index_a IN (SELECT listing_index FROM listings) AND listing_index_b IN (SELECT listing_index FROM listings)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.node)
SELECT CAST(node AS BIGINT) AS listing_index, CAST(min(m) AS BIGINT) AS group_id FROM r GROUP BY node
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least about half of an item's words, and the items."""
    return p7_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the words covered and each span to remove."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _mix_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = stage(mixing.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "page_type", "text"), "text"), "counted")
    return counted, mixing.mix_plan(counted, table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their share of a mix: their leaves' budgets are less than was wanted of them."""
    return mixing.of_sources(_mix_plan(spark, sf_dir)[1]).where("short").select("mix_id", "source")


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source of each mix: tokens wanted, budgeted and drawn, and the share reached."""
    counted, plan = _mix_plan(spark, sf_dir)
    got = mixing.draw(counted, plan).join(counted.select("doc_id", "n_tokens"), "doc_id").groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn"), F.max("copies").alias("most_copies"))
    plan = mixing.of_sources(plan)
    mix_total = got.groupBy("mix_id").agg(F.sum("drawn").alias("mix_drawn"))
    return plan.join(got, ["mix_id", "source"], "left").join(mix_total, "mix_id", "left").select("mix_id", "source", "target_share", "wanted", "budget", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.coalesce("drawn", F.lit(0)) / F.col("mix_drawn")).alias("share_reached"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every document that is mainly English prose."""
    return levels.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels")).select("doc_id", F.col("level").cast("int").alias("level"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each canonical key, the phone, e-mail, website and Facebook page in use."""
    return survivor.survivors(table(spark, sf_dir, "listings"), table(spark, sf_dir, "source_trust")).drop("heaviest")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings and evidence rows of one business whose names are spelt differently."""
    return names.variant_pairs(table(spark, sf_dir, "listings"), table(spark, sf_dir, "evidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and evidence rows in one building whose addresses are written differently."""
    return buildings.same_building(table(spark, sf_dir, "places"), table(spark, sf_dir, "evidence"), table(spark, sf_dir, "localities"))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and evidence rows of one business, with the confidence."""
    places = table(spark, sf_dir, "places").select(F.col("row_id").alias("id"), F.col("title").alias("name"), F.col("phone_number").alias("phone"), F.col("website").alias("web"), F.lit(None).cast("string").alias("site"), "address")
    evidence = table(spark, sf_dir, "evidence").select(F.col("evidence_id").alias("id"), "name", "phone", F.col("website").alias("web"), F.col("domain").alias("site"), "address")
    return retrieval.match(places, evidence).select(F.col("left_id").alias("row_id"), F.col("right_id").alias("evidence_id"), "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and evidence rows of one business."""
    return p5_matches(spark, sf_dir).select("row_id", "evidence_id")


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches, "p3_found": p3_found, "p2_found": p2_found, "p6_found": p6_found, "p9_found": p9_found, "p4_found": p4_found, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found, "p8_drawn": p8_drawn}
ORACLE = {"p4_found": P4_SQL}
