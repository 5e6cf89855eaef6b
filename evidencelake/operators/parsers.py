"""Comparison of what several parsers read on the same pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text as T

#: Characters of a preview.
PREVIEW = 160
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashed:
    """The code points of a text with sums that give a hash of any stretch."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(self.codes)
        powers = np.full(n + 1, _BASE, np.uint64)
        inverse = np.full(n + 1, _INVERSE, np.uint64)
        powers[:1] = inverse[:1] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        x = (self.codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        np.cumsum((x ^ (x >> np.uint64(29))) * np.multiply.accumulate(powers)[:n], out=self.sums[1:])

    def stretches(self, low: int, high: int, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` between two places, by where they begin."""
        return (self.sums[low + size : high + 1] - self.sums[low : high + 1 - size]) * self.inverse[low : high + 1 - size]


def _longest(a: _Hashed, b: _Hashed, block: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """Places and size of the longest common stretch inside a block; of several, the first in a, then in b."""
    a_low, a_high, b_low, b_high = block
    good, bad = 0, min(a_high - a_low, b_high - b_low) + 1
    while bad - good > 1:
        size = (good + bad) // 2
        if np.isin(a.stretches(a_low, a_high, size), b.stretches(b_low, b_high, size)).any():
            good = size
        else:
            bad = size
    if not good:
        return a_low, b_low, 0
    mine, theirs = a.stretches(a_low, a_high, good), b.stretches(b_low, b_high, good)
    i = int(np.flatnonzero(np.isin(mine, theirs))[0])
    return a_low + i, b_low + int(np.flatnonzero(theirs == mine[i])[0]), good


def similarity(one: str, two: str) -> float:
    """Twice the characters in common blocks over all characters; 1 for two empty texts.

    The blocks are the longest common stretch and, again, those on either side of it.
    """
    if not one and not two:
        return 1.0
    a, b, common = _Hashed(one), _Hashed(two), 0
    todo = [(0, len(one), 0, len(two))]
    while todo:
        a_low, a_high, b_low, b_high = block = todo.pop()
        if a_low == a_high or b_low == b_high:
            continue
        i, j, n = _longest(a, b, block)
        if n:
            common += n
            todo += [(a_low, i, b_low, j), (i + n, a_high, j + n, b_high)]
    return 2.0 * common / (len(one) + len(two))


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(batch.column("base").to_pylist(), batch.column("body").to_pylist(), strict=True))
        known = {p: None if p[1] is None else round(similarity(p[0] or "", p[1]), 4) for p in set(pairs)}
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([known[p] for p in pairs], pa.float64())], names=["key", "similarity"])


def compare_parsers(readings: DataFrame, baseline: str) -> DataFrame:
    """What each parser read of a page, and how like that is to what ``baseline`` read.

    readings has document_id, pdf_page, parser, text and error, one row each.  Returns those
    keys, status (ok, or failed for a row with an error or without a text), error, character_count,
    cjk_character_count, replacement_character_count (of the text without white space), preview,
    and similarity, to four places, null for a failed reading; a page that the baseline did not
    read compares with an empty text.  Whole texts are compared, whatever their length.
    """
    keys = ["document_id", "pdf_page", "parser"]
    read = readings.select(*keys, "text", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("text").isNull(), "no text").alias("error"))
    plain = read.withColumn("body", F.when(F.col("error").isNull(), T.compact(T.for_storage("text"))))
    base = plain.where(F.col("parser") == baseline).select("document_id", "pdf_page", F.col("body").alias("base"))
    both = plain.join(base, ["document_id", "pdf_page"], "left")
    key = both.select(F.struct(*keys).alias("key"), "base", "body")
    alike = key.mapInArrow(_similarities, f"key {key.schema['key'].dataType.simpleString()}, similarity double").select("key.*", "similarity")
    count = lambda c: F.when(F.col("error").isNull(), c).cast("long")
    facts = plain.select(
        *keys,
        F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"),
        "error",
        count(F.length("body")).alias("character_count"),
        count(F.regexp_count("body", F.lit(T.CJK))).alias("cjk_character_count"),
        count(F.regexp_count("body", F.lit("�"))).alias("replacement_character_count"),
        F.when(F.col("error").isNull(), F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, PREVIEW)).alias("preview"),
    )
    return facts.join(alike, keys)
