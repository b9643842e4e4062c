"""An extension: the snapshot operators over a stream of events, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.analytics import latest_by_source


def latest_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's latest snapshot per site and source to ``out``; a batch that is run again writes its own folder again."""
    def put(batch: DataFrame, number: int) -> None:
        latest_by_source(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The latest snapshot per site and source of all batches that ``latest_stream`` has written so far."""
    return latest_by_source(spark.read.parquet(out).drop("batch"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and revenue per hour and source, with a watermark for late rows."""
    return events.withWatermark("captured_at", late).groupBy(F.window("captured_at", "1 hour"), "source").agg(F.count(F.lit(1)).alias("events"), F.sum("revenue").alias("revenue"))
