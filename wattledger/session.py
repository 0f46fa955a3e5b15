"""Session settings and the shared-storage cut points used by iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime SQL settings that keep one hot key from pinning a task.  They are only
# applied where the caller left the engine default in place.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder of this application's cut points, below the cluster's ``spark.checkpoint.dir``.

    Where the session names none, a one-machine session uses a folder beside its
    warehouse; on a cluster that is an error, since executors would each write to a disk
    of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-cuts"
    return f"{configured.rstrip('/')}/{spark.sparkContext.applicationId}"


def clear_cuts(spark: SparkSession) -> None:
    """Delete this application's cut points; call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize_with(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` that also returns aggregates collected while writing (no extra job)."""
    seen = Observation()
    named = [c.alias(name) for name, c in metrics.items()]
    return materialize(df.observe(seen, *named), label), seen.get


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage of iterative jobs, survives executor loss, and gives the
    planner true sizes, so the next join is broadcast only when its measured
    size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
