"""Hashed n-gram counts of whole corpora, gathered in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import _text


def flagged(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text and target (whether ``chosen`` has the doc_id) of each row of ``docs``."""
    _text.small_batches(docs.sparkSession)
    ids = chosen.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = rows.select("doc_id").distinct().join(ids, "doc_id", "left_semi").withColumn("target", F.lit(True))
    # only ids are dealt out; texts stay where they are if the chosen ids are few enough to share
    if marks.count() * 24 < 64 << 20:
        marks = F.broadcast(marks)
    return rows.join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def counted(batches: Iterator[pa.RecordBatch], keys, words: np.ndarray = _text.ALNUM) -> Iterator[pa.RecordBatch]:
    """(key, n, n_target) of each step; ``keys`` turns the words of a step and their rows into keys and their rows, ``words`` are the bytes of words."""
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False)
        data, offsets = _text.buffers(batch.column("text"))
        for low, high in _text.steps(offsets, 8 * _text.STEP_BYTES):
            part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            starts, ends, first = _text.spans(part, at, words)
            row = np.searchsorted(first[1:], np.arange(len(starts)), side="right")
            found, row = keys(_text.word_hashes(part, starts, ends), row)
            own = target[low:high][row]
            values, inverse, n = np.unique(found, return_inverse=True, return_counts=True)
            n_target = np.bincount(inverse[own], minlength=len(values)) if len(values) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(n_target.astype(np.int64))], names=["key", "n", "n_target"])


def totals(rows: DataFrame, run) -> DataFrame:
    """Sums of what ``run`` (see ``counted``) yields, by key."""
    return rows.select("text", "target").mapInArrow(run, "key long, n long, n_target long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
