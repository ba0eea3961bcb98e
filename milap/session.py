"""Session helpers: reading tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def settle(spark: SparkSession) -> None:
    """Turn off a union's claim to its children's partitioning.

    With it Spark 4.1 drops the exchange after a union of exchanges, while adaptive execution still coalesces each child by itself, so that
    rows of one key end up in different partitions and are lost to whatever needs them together.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, columns pruned by whatever is selected from it."""
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode (tests), removed at the end; on a cluster a ``ValueError``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="milap-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_STAGED: dict[int, str] = {}
#: Does a plan remove its own shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Input of a partition of a light plan, in bytes.
_LIGHT_PART = 1 << 17


def _light(df: DataFrame, most: int) -> dict[str, str]:
    """Settings of a plan that reads ``most`` bytes or less; none for others."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size > most:
        return {}
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // _LIGHT_PART)
    return {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(parts)}


def stage(df: DataFrame, label: str = "stage", light: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and gives the optimizer true sizes for what follows. The shuffle files of the write go as soon as it ends: no other plan reads them.
    Plans that read at most ``light`` bytes run as one job of few tasks, without adaptive execution and broadcasts. Iterations make many of them, and in the driver each broadcast takes 1 to 4 MB at once, even for a few rows, and
    each stage of an adaptive plan another plan with its metrics, which stay.
    """
    spark = df.sparkSession
    settle(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    during = {_CLEANUP: "true"} | (_light(df, light) if light else {})
    before = {k: spark.conf.get(k, None) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "lz4").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[id(out)] = path
    weakref.finalize(out, _STAGED.pop, id(out), None)
    return out


def release(*staged: DataFrame) -> None:
    """Delete tables written by ``stage`` of which nothing that is still to be computed depends: all that used them has been written itself."""
    for df in staged:
        path = _STAGED.pop(id(df), None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if staged:
        tidy(staged[0])


def tidy(df: DataFrame) -> None:
    """Let the cleaner remove the shuffle files of plans that are done: they go when the driver collects these."""
    df.sparkSession._jvm.System.gc()
