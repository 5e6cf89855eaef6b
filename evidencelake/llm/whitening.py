"""Whitening of embeddings from an exact scatter matrix in residue numbers.

An entry c becomes the integer x = floor(64 c) + 1,000,000.  Every partition multiplies
its block of rows, with a column of ones before it, by itself modulo several
primes.  A residue is at most half a prime of 21 bits, so a product of 4,096 rows stays
below 2 ** 52 and an ordinary matrix product of doubles is exact.  The products are added
by prime and matrix row on the cluster; Chinese remaindering of the sums gives the number
of rows n, the sums S and the scatter G as exact integers.  The covariance
(n G - S S') / n ** 2 is rounded once, entry by entry, and its eigenvectors are taken in
double precision.  There are as many primes as the row count and the largest entry ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block that one exact product takes, and the limit of its primes.
BLOCK, PRIME_LIMIT = 1 << 12, 1 << 21
SCALE, SHIFT = 64.0, 1_000_000
#: floor(64 c) is held within these bounds, so that x is a long whatever c is.
LARGEST = float(1 << 62)
COMPONENTS = 32


def primes(bound: int) -> list[int]:
    """The largest primes below ``PRIME_LIMIT`` whose product is over ``2 * bound``, so that integers up to ``bound`` of either sign have residues of their own."""
    found, product, candidate = [], 1, PRIME_LIMIT
    while product <= 2 * bound:
        candidate -= 1
        if all(candidate % f for f in range(2, int(candidate**0.5) + 1)):
            found.append(candidate)
            product *= candidate
    return found


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size that leaves ``residues``."""
    x, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return x - product if 2 * x > product else x


def as_integers(c: np.ndarray) -> np.ndarray:
    """x of entries ``c``."""
    return np.floor(SCALE * np.clip(c, -LARGEST / SCALE, LARGEST / SCALE)).astype(np.int64) + SHIFT


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column of equally long lists of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(d: int, moduli: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((len(moduli), d + 1, d + 1), np.int64), False
        for batch in batches:
            rows = as_integers(_matrix(batch.column("vector"), d))
            for low in range(0, len(rows), BLOCK):
                seen, x = True, np.hstack([np.ones((len(rows[low : low + BLOCK]), 1), np.int64), rows[low : low + BLOCK]])
                for k, p in enumerate(moduli):
                    r = np.mod(x, p)
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    sums[k] = np.mod(sums[k] + (r.T @ r).astype(np.int64), p)
        if seen:
            yield _table(sums.reshape(-1, d + 1), pa.int64())

    return run


def _table(rows: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Numbered rows of a matrix."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))], names=["line", "cells"])


def _added(width: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the cells of equal lines; a task holds one sum for each of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, cells in zip(batch.column("line").to_pylist(), _matrix(batch.column("cells"), width), strict=True):
                sums[line] = sums[line] + cells if line in sums else cells.copy()
        if sums:
            rows = _table(np.array(list(sums.values())), pa.int64() if kind == "long" else pa.float64())
            yield rows.set_column(0, "line", pa.array(list(sums), pa.int32()))

    return run


def _summed(parts: DataFrame, lines: int, width: int, kind: str) -> np.ndarray:
    """The sums of the matrices that the partitions of ``parts`` hold: ``lines`` rows of ``width`` cells, added on the cluster."""
    added = parts.repartition("line").mapInArrow(_added(width, kind), f"line int, cells array<{kind}>").collect()
    out = np.zeros((lines, width), np.int64 if kind == "long" else np.float64)
    for r in added:
        out[r["line"]] += np.array(r["cells"])
    return out


@dataclass(frozen=True)
class Whitening:
    """Exact n and sums, and the components: columns of vectors, eigenvalues and their shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float]
    #: The largest absolute deviation n x - S of any entry.
    reach: int


def usable(embeddings: DataFrame, vector: str) -> DataFrame:
    """The rows of ``embeddings`` whose vector has entries, all of them finite, in the commonest length (the longest of equally common ones)."""
    entries = F.col(vector).cast("array<double>")
    fine = entries.isNotNull() & (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(fine)
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    return rows.where(F.size(vector) == (lengths[0]["d"] if lengths else 0))


def learn(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors of ``rows``, which ``usable`` has passed; None if no component has any variance.

    Three jobs: the row count and the range of entries, the scatter, and its sum.
    What comes to the driver is one matrix of residues for each prime.
    """
    largest = F.col(vector).cast("array<double>")
    found = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d"), F.min(F.array_min(largest)).alias("low"), F.max(F.array_max(largest)).alias("high")).first()
    if not found["n"]:
        return None
    n, d, ends = found["n"], found["d"], as_integers(np.array([found["low"], found["high"]]))
    moduli = primes(n * max(1, *(int(x) ** 2 for x in ends)))
    doubles = rows.select(largest.alias("vector"))
    residues = _summed(doubles.mapInArrow(_products(d, moduli), "line int, cells array<long>"), len(moduli) * (d + 1), d + 1, "long").reshape(len(moduli), d + 1, d + 1)
    exact = [[remaindered([int(r) % p for r, p in zip(residues[:, i, j], moduli, strict=True)], moduli) for j in range(i, d + 1)] for i in range(d + 1)]
    assert exact[0][0] == n, "rows changed between two scans"
    sums = exact[0][1:]
    spread = {(i, j): n * exact[i + 1][j - i] - sums[i] * sums[j] for i in range(d) for j in range(i, d)}
    covariance = np.array([[float(Fraction(spread[min(i, j), max(i, j)], n * n)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # a value that rounding alone could make is no direction of its own
    kept = int(np.sum(values[:components] > d * np.finfo(float).eps * max(values[0], 0.0)))
    if not kept:
        return None
    trace = Fraction(sum(spread[i, i] for i in range(d)), n * n)
    reach = max(abs(n * int(x) - s) for x in ends for s in sums)
    return Whitening(n, sums, vectors[:, :kept], values[:kept], [float(Fraction(float(e)) / trace) for e in values[:kept]], reach)


def _projected(model: Whitening, c: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The exact squared deviations of rows ``c``, and their whitened coordinates."""
    x, d = as_integers(c), c.shape[1]
    if model.reach**2 * d < 1 << 63 and model.n * max(1, int(np.abs(x).max(initial=0))) < 1 << 62:
        apart = model.n * x - np.array(model.sums, np.int64)
    else:  # integers of any size
        apart = model.n * x.astype(object) - np.array(model.sums, object)
    return [int(s) for s in (apart * apart).sum(axis=1)], (apart / model.n).astype(np.float64) @ model.vectors / np.sqrt(model.values)


def _measured(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        sums, seen = np.zeros((k + 1, k + 1)), False
        for batch in batches:
            rows = _matrix(batch.column("vector"), len(model.sums))
            if len(rows):
                w = np.hstack([np.ones((len(rows), 1)), _projected(model, rows)[1]])
                seen, sums = True, sums + w.T @ w
        if seen:
            yield _table(sums, pa.float64())

    return run


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, measured by one more scan.

    Whitened rows are centred on the exact mean before they are multiplied; what rounding leaves of their mean is taken off.
    """
    k = len(model.values)
    doubles = rows.select(F.col(vector).cast("array<double>").alias("vector"))
    sums = _summed(doubles.mapInArrow(_measured(model), "line int, cells array<double>"), k + 1, k + 1, "double")
    mean = sums[0, 1:] / model.n
    return float(np.abs(sums[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _whitener(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            rows = _matrix(batch.column("vector"), len(model.sums))
            deviations, w = _projected(model, rows)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([str(x) for x in deviations], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))], names=["row", "deviation", "whitened"])

    return run


def whiten(embeddings: DataFrame, vector: str = "embedding", carry: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The whitened rows of ``embeddings`` and the model: row (a struct of ``carry``), deviation (decimal text), whitened (an array, component 1 first).

    Left out are rows whose vector is null, empty or holds null, NaN or infinite
    entries, and vectors of another length than the commonest.  Rows that repeat, and
    rows of one or no id, each count and come back.  Entries so large that 64 c is over
    2 ** 62 count as that.  Directions without variance have no component: there are at
    most as many components as the covariance has rank, and no rows at all if all
    vectors are equal, there is one, or the table is empty.  Other columns are not looked at.
    """
    rows = usable(embeddings, vector)
    model = learn(rows, vector, components)
    given = rows.select(F.struct(*carry).alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    kind = f"row {given.schema['row'].dataType.simpleString()}, deviation string, whitened array<double>"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], kind), None
    return given.mapInArrow(_whitener(model), kind), model


def by_component(whitened: DataFrame, model: Whitening | None, error: float | None) -> DataFrame:
    """One line a row and component: the carried columns, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    deviation is a long, null where the exact value, which deviation_exact has in digits, does not fit.
    """
    shares = F.array(*(F.lit(x) for x in model.explained)) if model else F.array(F.lit(None).cast("double"))
    whole: Column = F.col("deviation").try_cast("long")
    each = whitened.select("row.*", whole.alias("deviation"), F.col("deviation").alias("deviation_exact"), F.posexplode("whitened").alias("at", "whitened"))
    carried = [c for c in each.columns if c not in ("deviation", "deviation_exact", "at", "whitened")]
    return each.select(*carried, (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact")
