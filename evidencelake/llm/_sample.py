"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(rows: DataFrame, label: str, most: int | dict, salt: int = 11) -> list:
    """Up to ``most`` rows of each label (or as many as it says for that label), those of the smallest hash of doc_id, by label and hash.

    ``rows`` has doc_id and the label.  A row stays only under a hash limit that about
    twice ``most`` ids of its label pass, and rows of one id and label are merged (the least of
    each other column) before they come to the driver, so that what comes is bounded
    by labels times ``most``.  Two scans, however many labels there are.
    """
    ids = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in ids.groupBy(label).agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    if not counts:
        return []
    limit = (lambda v: most[v]) if isinstance(most, dict) else (lambda v: most)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    shares = rows.sparkSession.createDataFrame([(v, min(1.0, (2 * limit(v) + 64) / n)) for v, n in counts.items()], ids.select(label).schema.add("__share", "double"))
    others = [c for c in ids.columns if c not in (label, "doc_id")]
    few = ids.withColumn("__place", place).join(F.broadcast(shares), label).where("__place <= __share")
    found = few.groupBy(label, "doc_id", "__place").agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in others)).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(found, key=lambda r: (str(r[label]), r["__place"], r["doc_id"])):
        if taken[r[label]] < limit(r[label]):
            taken[r[label]] += 1
            out.append(r)
    return out
