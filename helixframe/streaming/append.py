"""Continuous append: files of JSON lines that arrive in a directory are added to a table, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.catalog.database import Database
from helixframe.sources import ndjson


def stream_append(database: Database, table: str, directory: str, checkpoint: str, target: str, available_now: bool = False) -> StreamingQuery:
    """Parse arriving lines and append them to Parquet at ``target``; the checkpoint makes each file count once.

    The batch id names each batch's folder, so a batch that is run again replaces what it wrote before.
    """
    own = database.tables[table]

    def add(batch: DataFrame, number: int) -> None:
        rows = ndjson.parsed(batch.where(F.trim("value") != ""), own.fields, own.references)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    source = database.spark.readStream.format("text").load(directory)
    writer = source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="2 seconds").start()


def counts_by_window(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Rows of a stream by time window and key; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("count"))
