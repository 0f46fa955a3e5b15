"""Structured Streaming forms of the two inputs that arrive continuously."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattledger import schemas
from wattledger.operators.ingest import ingest_consumption
from wattledger.streaming.keyed_log import KeyedLog


def consumption_log(spark: SparkSession, target: str) -> KeyedLog:
    """Bronze consumption as a log: a bill that comes again for a meter and period replaces the earlier one.

    Bills without a known meter, feeder or period stand for themselves.
    """
    known = "customer_unit_id IS NOT NULL AND feeder_id IS NOT NULL AND year_month RLIKE '^[0-9]{4}-[0-9]{2}$'"
    return KeyedLog(spark, target, "consumption", schemas.schema("consumption"), ("customer_unit_id", "year_month"), known)


def stream_bronze(
    source: DataFrame, customers: DataFrame, target: str, checkpoint: str, field_map: dict[str, str] | None = None
) -> StreamingQuery:
    """Arriving billing files, each micro-batch a batch of ``consumption_log``.

    A batch that is run again after a failure replaces itself, and readers of the log see a
    corrected bill once, with its latest values.
    """
    log = consumption_log(customers.sparkSession, target)

    def land(batch: DataFrame, batch_id: int) -> None:
        log.land(ingest_consumption(batch, customers, field_map), batch_id)

    return (
        source.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def outage_windows(events: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Energy not supplied per feeder and time window; late events beyond the watermark drop.

    Duplicated deliveries of an event count once.
    """
    energy: Column = F.col("duration_h") * F.col("affected_kw")
    stream = events.where(F.col("motivo") == "falla").withWatermark("timestamp", lateness)
    once = stream.dropDuplicatesWithinWatermark(["event_id"])
    return (
        once.groupBy(F.window("timestamp", window).alias("w"), "feeder_id")
        .agg(F.sum(energy).alias("ens_kwh"), F.count(F.lit(1)).alias("n_faults"))
        .select("feeder_id", F.col("w.start").alias("window_start"), "ens_kwh", "n_faults")
    )


def stream_outages(events: DataFrame, target: str, checkpoint: str, window: str = "1 day", lateness: str = "2 days") -> StreamingQuery:
    """Windows as they change, the open ones at the feed's end included.

    Every micro-batch goes to its own ``batch_id`` partition, replaced on retry; ``outages``
    reads the last state of each window.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    return (
        outage_windows(events, window, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def outages(spark: SparkSession, target: str) -> DataFrame:
    """Latest state of every window over all landed batches."""
    values = F.struct("batch_id", "ens_kwh", "n_faults")
    last = spark.read.parquet(target).groupBy("feeder_id", "window_start").agg(F.max(values).alias("v"))
    return last.select("feeder_id", "window_start", "v.ens_kwh", "v.n_faults")
