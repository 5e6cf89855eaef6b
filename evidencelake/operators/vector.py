"""Exact cosine search of query vectors in all points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators.best import Best

#: Query vectors that are shared with the executors at a time.
BLOCK = 4096
#: Queries and points whose cosines a task holds at a time.
TILE = (512, 1024)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _nearest(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shared.value
        best = Best(len(names), k)
        for batch in batches:
            for low in range(0, len(batch) if len(wanted) else 0, TILE[1]):
                part = batch.slice(low, TILE[1])
                points, ids = _unit(_matrix(part.column("vector"))), part.column("id").to_numpy()
                for first in range(0, len(wanted), TILE[0]):
                    cosine = np.round(wanted[first : first + TILE[0]] @ points.T, 6)
                    best.add(first, np.where(np.isnan(cosine), -np.inf, cosine), ids)
        yield from best.batches(names, ("query_id", "id", "score"))

    return run


def search(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest ``points`` (id, vector) of each of ``queries`` (query_id, vector): query_id, id, score, rank.

    The score is the cosine, rounded to six places; ties go to the smaller id.
    Vectors without length or of another dimension than the first query are left
    out.  Queries go out in blocks of bounded size, each block meets every point
    once in tiles of bounded size, and only each task's best leave it.
    """
    spark = points.sparkSession
    held = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
    size, width = held.agg(F.count("*"), F.max(F.size("vector"))).first()
    ready = points.where(F.size("vector") == F.lit(width or 0)).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    blocks = max(1, -(-size // BLOCK))
    found = None
    for i in range(blocks):
        rows = held.where((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) & (F.size("vector") == F.lit(width or 0))).orderBy("query_id").collect()
        names, wanted = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
        share = spark.sparkContext.broadcast((names, _unit(wanted) if len(wanted) else wanted))
        part = ready.mapInArrow(_nearest(share, k), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def two_tier(ranked: DataFrame, preferred: str, k: int) -> DataFrame:
    """The first ``k`` of ``ranked`` (query_id, rank, ...) with the preferred first, otherwise in the order they had."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(preferred), "rank"))
    return ranked.withColumn("base_rank", F.col("rank")).withColumn("rank", rank).where(F.col("rank") <= k)


def widened(k: int) -> int:
    """Candidates to take before a preference is applied."""
    return min(500, max(100, 20 * k))
