"""Loaders of the driver tables and adapters to the engine's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Tables of long texts, by their unique key, and the size of ids that are sent to all tasks.
TEXTS, SENT_BYTES = {"documents": "doc_id", "pages": "page_id"}, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; texts that come in fewer splits than there are cores are dealt out by their key first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, TEXTS[name]) if name in TEXTS else rows


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a scan, dealt out by a unique key if its splits are fewer than the cores; a scan of many splits stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as pages: a source is a document, its rows by doc_id are its pages."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a source may hold most rows: its ids alone are put in order, its texts stay where they are
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    numbered = documents.select("doc_id", F.col("source").alias("document_id"), page.alias("pdf_page"))
    numbered = F.broadcast(numbered) if documents.count() * 48 < SENT_BYTES else numbered.hint("shuffle_hash")
    return spread(documents.select("doc_id", "text"), "doc_id").join(numbered, "doc_id").select("document_id", "pdf_page", "doc_id", "text", F.lit(0).alias("images"))


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as source events: a user is a person, a day the start; errors are rejected."""
    day = F.date_format("ts", "yyyy-MM-dd")
    confidence = F.least(F.col("value") / 100.0, F.lit(1.0))
    status = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "confirmed").otherwise("unreviewed")
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("person_id"), "event_type", day.alias("start_value"), confidence.alias("confidence"), status.alias("review_status"), F.pmod("event_id", F.lit(7)).alias("document_id"), "props")
