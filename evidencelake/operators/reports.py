"""Summaries of builds with the digests that tell whether their artifacts are still the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a chunk may be to the research scope.
SCOPES = ("in_scope", "mixed", "out_of_scope", "unknown")


def artifact_digests(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``group`` and sha256 of each artifact: the digest of the digests of its records, all their columns, in ``order``.

    A record is hashed where it is, so an artifact's task holds 64 bytes a record.
    """
    record = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    each = rows.select(group, F.struct(*order, record.alias("h")).alias("r"))
    return each.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), "\n"), 256).alias("sha256"))


def digest_of(artifacts: DataFrame, group: str) -> DataFrame:
    """One row, sha256: the digest of all artifacts' names and digests, by name."""
    named = F.struct(F.col(group).cast("string").alias("n"), "sha256")
    return artifacts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda a: F.concat_ws(" ", a["n"], a["sha256"])), "\n"), 256).alias("sha256"))


def chunk_build(pages: DataFrame, chunks: DataFrame, structure: DataFrame) -> DataFrame:
    """What a chunk build made of each document, and a row of totals (document_id null).

    pages has document_id and effective (whether the page has a text); chunks has document_id, chunk_id,
    text and scope_status; structure has document_id, one row an entry.  Returns effective_pages,
    skipped_pages, structure_entries, chunks, characters, a column for each of ``SCOPES`` (any other
    scope counts as unknown), and sha256, the digest of the document's chunks, of all documents' in the totals.
    """
    sums = ["effective_pages", "skipped_pages", "structure_entries", "chunks", "characters", *SCOPES]
    read = pages.groupBy("document_id").agg(F.count_if("effective").alias("effective_pages"), F.count_if(~F.col("effective")).alias("skipped_pages"))
    scope = F.when(F.col("scope_status").isin(*SCOPES), F.col("scope_status")).otherwise(SCOPES[-1])
    made = chunks.withColumn("__scope", scope).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"), *(F.count_if(F.col("__scope") == s).alias(s) for s in SCOPES))
    headings = structure.groupBy("document_id").agg(F.count("*").alias("structure_entries"))
    digests = artifact_digests(chunks, "document_id", ["chunk_id"])
    rows = read.join(made, "document_id", "left").join(headings, "document_id", "left").join(digests, "document_id", "left")
    filled = rows.select("document_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums), "sha256")
    totals = filled.agg(*(F.sum(c).alias(c) for c in sums)).crossJoin(F.broadcast(digest_of(digests, "document_id"))).withColumn("document_id", F.lit(None).cast(dict(filled.dtypes)["document_id"]))
    return filled.unionByName(totals.select(*filled.columns))


def build_warnings(builds: DataFrame, digest: DataFrame) -> DataFrame:
    """warning of the latest of ``builds`` (run_id, finished_at, whole, sha256) against the ``digest`` (sha256) of the artifacts as they are."""
    last = builds.withColumn("__n", F.row_number().over(Window.orderBy(F.desc("finished_at"), F.desc("run_id")))).where("__n = 1")
    both = digest.select(F.col("sha256").alias("now")).join(F.broadcast(last.select("run_id", "whole", F.col("sha256").alias("then"))), how="left")
    said = F.array_compact(F.array(F.when(F.col("run_id").isNull(), "no_build"), F.when(~F.col("whole"), "partial_build"), F.when(F.col("now") != F.col("then"), "artifacts_changed")))
    return both.select(F.explode(said).alias("warning"))
