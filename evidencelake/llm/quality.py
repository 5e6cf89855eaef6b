"""Quality by importance resampling of hashed n-grams.

Words are runs of anything but white space, so that marks stuck to words count.
Two bags of hashed unigrams and bigrams are counted over all texts: the target's
and the raw corpus's.  A text's log importance weight is the sum of the log
ratios of the two smoothed distributions over its n-grams; with ``per`` set, it is
the mean log ratio times so many n-grams, so that length counts for nothing.  The resample is the Gumbel top-k: the k
rows of the largest weight plus Gumbel noise, which are k draws without
replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm import _text
from evidencelake.llm._store import cut
from evidencelake.llm.ngrams import counted, totals


@dataclass(frozen=True)
class Resampling:
    """Buckets of the hashed n-grams, n-grams that every text counts as having (None: its own), the share of rows drawn, the seed, rows ranked in one task at most."""

    buckets: int = 10_000
    per: float | None = None
    share: float = 0.5
    seed: int = 7
    ranked: int = 100_000


def _grams(hashes: np.ndarray, row: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of all pairs of neighbours, and their rows."""
    inside = row[1:] == row[:-1]
    two = _text.mix(hashes[:-1] * _text.U64(0xD6E8FEB86659FD93) + hashes[1:])[inside]
    return (np.concatenate([hashes, two]) % _text.U64(buckets)).astype(np.int64), np.concatenate([row, row[1:][inside]])


def ratios(rows: DataFrame, r: Resampling = Resampling()) -> np.ndarray:
    """log of target over raw probability of each bucket, from ``rows`` (text, target); the raw corpus is all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(batches, lambda hashes, row: _grams(hashes, row, r.buckets), _text.NON_SPACE)

    n = np.ones((2, r.buckets))
    for x in totals(rows, run).collect():  # at most one row a bucket
        n[:, x["key"]] += x["n"], x["n_target"]
    p = n / n.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def _weigher(ratio: np.ndarray, r: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, first in _text.tokens(batch.column("text"), _text.NON_SPACE):
                row = np.searchsorted(first[1:], np.arange(len(hashes)), side="right")
                grams, own = _grams(hashes, row, r.buckets)
                n = np.bincount(own, minlength=high - low)
                weight = np.bincount(own, weights=ratio[grams], minlength=high - low)
                if r.per is not None:
                    weight = weight / np.maximum(n, 1) * r.per
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high].cast(pa.int64()), batch.column("h")[low:high], pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "h", "n_grams", "weight"])

    return run


def weights(docs: DataFrame, ratio: np.ndarray, r: Resampling = Resampling()) -> DataFrame:
    """doc_id, h (a hash of the text), n_grams and weight of each row of ``docs`` (doc_id, text); without words the weight is 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(_weigher(ratio, r), "doc_id long, h long, n_grams long, weight double")


def gumbel_top(weighted: DataFrame, k: int, r: Resampling = Resampling()) -> DataFrame:
    """``weighted`` (doc_id, h, weight, ...) with key, the noisy weight, and selected, for exactly the k largest keys.

    Ties go to the smaller doc_id, then h, then any of equal rows.  The least key
    selected is closed in on by counts of ever finer bins, until one bin holds few
    enough rows to be ranked in a task; nothing else is sorted.
    """
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(r.seed), "doc_id", "h"), 12) + F.lit(0.5)) / float(1 << 52)
    rows = cut(weighted.withColumn("key", F.col("weight") - F.log(-F.log(unit))), "keys")
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n or k <= 0 or k >= n:
        return rows.withColumn("selected", F.lit(bool(n and k >= n)))
    above, width = 0, (high - low) or 1.0
    top = high
    for _ in range(12):
        inside = rows.where((F.col("key") >= low) & (F.col("key") <= top))
        bins = {b: c for b, c in inside.groupBy(F.least(F.floor((F.col("key") - F.lit(low)) * F.lit(256.0 / width)), F.lit(255)).alias("b")).count().collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b] >= k:
                break
            above += bins[b]
        size = bins[b]
        cell = F.least(F.floor((F.col("key") - F.lit(low)) * F.lit(256.0 / width)), F.lit(255))
        low, top = inside.where(cell == b).agg(F.min("key"), F.max("key")).first()
        width = top - low
        if size <= r.ranked or not width:
            break
    edge = rows.where((F.col("key") >= low) & (F.col("key") <= top))
    picked = edge.withColumn("place", F.row_number().over(Window.orderBy(F.desc("key"), F.asc_nulls_last("doc_id"), "h"))).withColumn("selected", F.col("place") <= k - above).drop("place")
    rest = rows.where((F.col("key") < low) | (F.col("key") > top)).withColumn("selected", F.col("key") > top)
    return rest.unionByName(picked)


def resample(docs: DataFrame, target: DataFrame, r: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_grams, weight, key and selected of each row of ``docs``; ceil(share * rows) rows are selected.

    ``target`` has doc_id, text and target, see ``ngrams.flagged``.  Null or wordless
    texts have weight 0; a null doc_id takes part like any other.  Repeated rows
    have one key, so they are drawn together but for a tie at the edge.  Other
    columns are not looked at.
    """
    weighted = cut(weights(docs, ratios(target, r), r), "weights")
    return gumbel_top(weighted, math.ceil(r.share * weighted.count()), r).select("doc_id", "n_grams", "weight", "key", "selected")
