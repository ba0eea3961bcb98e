"""Listings and runs as tables: accumulating upserts, run snapshots and the freshness of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milap.functions.text import clean_array, query_key

#: Days for which a run may be served again, by what was searched for (fixed values).
FRESH_DAYS = {
    14: ("restaurant", "restaurants", "cafe", "cafes"),
    30: ("barber", "salon", "parlor", "parlour", "gym", "fitness", "pharmacy", "hotel", "spa sauna"),
    90: ("banquet hall", "consultancy", "consultant", "lawyer", "lawyers", "hospital", "clinic", "home cleaning", "plumber", "electrician"),
    180: ("school", "schools", "college", "colleges"),
}
DEFAULT_DAYS = 30
#: Runs that may be served again (fixed values).
SERVABLE = ("success", "empty")


def fresh_days(query: Column) -> Column:
    """Days by the whole query, else its first word, else the longest kind it contains, else the default."""
    q = query_key(query)
    days = {k: d for d, ks in FRESH_DAYS.items() for k in ks}
    exact = F.coalesce(*(F.when(q.isin(*ks), d) for d, ks in FRESH_DAYS.items()))
    first = F.coalesce(*(F.when(F.split(q, " ")[0].isin(*ks), d) for d, ks in FRESH_DAYS.items()))
    inside = F.coalesce(*(F.when(F.contains(q, F.lit(k)), days[k]) for k in sorted(days, key=lambda k: (-len(k), k))))
    return F.coalesce(exact, first, inside, F.lit(DEFAULT_DAYS))


def newest_fresh(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """For each ``(query_key, locality_key, at)`` of ``asked``, the newest servable run before ``at`` and within the query's days; one row each, run columns null if none. Null keys match nothing.

    Runs and questions of one query and locality are walked once in order of time, so a locality asked for very often is no product of runs and questions. If the newest run before is too old, all are.
    """
    asked = asked.distinct()
    r = runs.where(F.col("status").isin(*SERVABLE) & F.col("completed_at").isNotNull()).select("query_key", "locality_key", F.col("completed_at").alias("t"), F.struct("completed_at", "run_id", "listing_count").alias("run"))
    q = asked.select("query_key", "locality_key", F.col("at").alias("t"), F.lit(None).cast(r.schema["run"].dataType).alias("run"))
    # at one time the question comes before the runs, and of runs the one with the larger id last
    before = Window.partitionBy("query_key", "locality_key").orderBy(F.col("t"), F.col("run").isNotNull(), F.col("run.run_id")).rowsBetween(Window.unboundedPreceding, -1)
    walked = q.unionByName(r).withColumn("b", F.last("run", ignorenulls=True).over(before)).where("run is null")
    young = F.unix_timestamp(F.col("b.completed_at").cast("timestamp")) > F.unix_timestamp(F.col("t").cast("timestamp")) - fresh_days(F.col("query_key")) * 86400
    known = F.col("query_key").isNotNull() & F.col("locality_key").isNotNull()
    return walked.withColumn("b", F.when(young & known, F.col("b"))).select("query_key", "locality_key", F.col("t").alias("at"), F.col("b.completed_at").alias("completed_at"), F.col("b.run_id").alias("run_id"), F.col("b.listing_count").alias("listing_count"))


def accumulate(batch: DataFrame) -> DataFrame:
    """One row for each canonical key: sets of contacts, first and last seen, the first name, the number of runs.

    Written so that the partial results of runs can be folded again by ``fold``. Empty keys are skipped.
    """
    rows = batch.where("canonical_key is not null and canonical_key <> ''")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(clean_array(F.col(c)))))).alias(c)
    return rows.groupBy("canonical_key").agg(
        F.min_by("name", F.struct("ingested_at", "listing_index")).alias("first_name"), *(union(c) for c in ("phones", "mobiles", "emails", "websites")), F.min("ingested_at").alias("first_seen"), F.max("ingested_at").alias("last_seen"), F.count_distinct("run_id").alias("run_count")
    )


def fold(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store after a further accumulated batch: sets grow, first seen and first name stay, runs add up."""
    a, b = old.alias("a"), new.alias("b")
    union = lambda c: F.array_sort(F.array_union(F.coalesce(f"a.{c}", F.array().cast("array<string>")), F.coalesce(f"b.{c}", F.array().cast("array<string>")))).alias(c)
    zero = F.lit(0)
    return a.join(b, F.col("a.canonical_key") == F.col("b.canonical_key"), "full").select(
        F.coalesce("a.canonical_key", "b.canonical_key").alias("canonical_key"), F.coalesce("a.first_name", "b.first_name").alias("first_name"), *(union(c) for c in ("phones", "mobiles", "emails", "websites")),
        F.least("a.first_seen", "b.first_seen").alias("first_seen"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), (F.coalesce("a.run_count", zero) + F.coalesce("b.run_count", zero)).alias("run_count"),
    )


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the run partitions that ``df`` holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_artifact(df: DataFrame, root: str, stage_name: str, run_id: str) -> None:
    """A stage's rows as JSON: the latest, and kept under the run."""
    df.write.mode("overwrite").json(f"{root}/latest/{stage_name}")
    df.write.mode("overwrite").json(f"{root}/runs/{run_id}/{stage_name}")


def latest_first(df: DataFrame, by: str, order: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")


def status(spark, path: str) -> str:
    """connected, empty or unreachable: can the store under ``path`` be read, and does it hold rows. Never raises."""
    try:
        return "connected" if spark.read.parquet(path).limit(1).count() else "empty"
    except Exception:  # noqa: BLE001
        return "unreachable"


def write_summary(spark, summary: dict, root: str, run_id: str) -> None:
    """One row of JSON for a run's summary, under ``latest`` and under the run's history; ``timestamp`` says when it was written unless the summary has one."""
    import datetime
    import json

    row = {**summary, "timestamp": summary.get("timestamp") or datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")}
    out = spark.createDataFrame([(json.dumps(row, default=str, ensure_ascii=False),)], "value string")
    for folder in ("latest", f"history/{run_id}"):
        out.coalesce(1).write.mode("overwrite").text(f"{root}/{folder}/summary-report")
