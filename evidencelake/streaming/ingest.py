"""Continuous ingest of page files, and of event counts, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidencelake.operators.pages import page_records


def pages(spark: SparkSession, path: str, schema: str = "document_id string, pdf_page int, text string, images int", files: int = 100) -> DataFrame:
    """Page records of Parquet files as they come."""
    return page_records(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path))


def into(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Start a query that gives each micro-batch to ``write`` with its number, which makes a repeated batch recognisable."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that puts each batch into a folder of its number: a batch that is given again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their total value of each window and key; events later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("events"), F.round(F.sum(value), 6).alias("total")).select(F.col("window.start").alias("start"), key, "events", "total")
