"""The batch operators on streams: late rows, sets that grow, keys that expire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milap.sources.store import accumulate, fold


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window of ``time`` and key; rows later than the watermark are left out."""
    ts = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return ts.groupBy(F.window(time, width), by).count().select(F.col("window.start").alias("window_start"), by, "count")


def once(events: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def folding_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that folds each batch of listings into the store under ``path``.

    A batch is written as a new version, named by its id, so a batch that is run again replaces itself and a lost executor leaves the version before whole.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = accumulate(batch)
        if batch_id:
            new = fold(batch.sparkSession.read.parquet(f"{path}/v{batch_id - 1}"), new)
        new.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write
