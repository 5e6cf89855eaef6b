"""Cross-entropy difference of two bigram models that share a vocabulary.

The target model counts the target documents, the background model all of them;
both have the same vocabulary (every word of all documents, and one token for
words that are not among them), order and smoothing.  A document's score is the
mean, over its tokens, of the background's log probability less the target's: the
lower, the more the document is like the target.

Counts cover every document, word and bigram.  A bigram's probability is
(c(v, w) + k P(w)) / (c(v) + k) with P the smoothed unigram model.

Plan.  Documents are dealt into ``steps`` of some megabytes.  Every step sends the
distinct keys of its words, contexts and bigrams, with how often it has them, to
the ``slices`` of the key space, packed as one row for each slice.  A slice adds up
what all steps have of its keys and answers each of them.  A step meets its texts
again (their exchange is reused) with the answers and adds up the terms.  So a key
travels once for each step that holds it, whatever number of documents does, and no
model is gathered anywhere.  Terms are whole multiples of 1 / ``UNIT``, so that sums
do not depend on the order of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import _text
from evidencelake.llm._store import cut

#: Parts of a nat in which terms are counted.
UNIT = 10**9
#: Turns the key of a word into its key as a context.
_CONTEXT = _text.U64(0x5851F42D4C957F2D)
_ORDER = _text.U64(0xD6E8FEB86659FD93)
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double"


@dataclass(frozen=True)
class Plan:
    """The weight k of the unigram model, and bytes of text of a step and of what a slice is meant for; results depend on k only."""

    backing: float = 4.0
    step: int = 8 << 20
    slice: int = 8 << 20


def pair_keys(hashes: np.ndarray) -> np.ndarray:
    """Key of each word with the next."""
    return _text.mix(hashes[:-1] * _ORDER + hashes[1:])


@dataclass
class _Step:
    """The tokens of some rows: hashes, the row of each, places whose next token is of the same row, and tokens of each row."""

    hashes: np.ndarray
    row: np.ndarray
    followed: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, texts: pa.ChunkedArray) -> _Step:
        found = [(words, np.diff(first)) for _, _, words, first in _text.tokens(texts, _text.ALNUM)]
        hashes = np.concatenate([x[0] for x in found]) if found else np.zeros(0, _text.U64)
        n = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(n)), n)
        return cls(hashes, row, np.flatnonzero(row[1:] == row[:-1]), n)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all words, contexts and bigrams, one after the other, and their rows."""
        keys = np.concatenate([self.hashes, self.hashes[self.followed] ^ _CONTEXT, pair_keys(self.hashes)[self.followed]])
        return keys, np.concatenate([self.row, self.row[self.followed], self.row[self.followed]])


def _sliced(keys: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each key: as many equal parts of the key space."""
    return ((keys >> _text.U64(32)) * _text.U64(slices)) >> _text.U64(32)


def _small(counts: np.ndarray) -> bytes:
    """Counts of a byte each; 255 stands for a larger one, which follows behind them all."""
    large = counts[counts >= 255]
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def _large(held: bytes) -> np.ndarray:
    size = int.from_bytes(held[:8], "little")
    counts = np.frombuffer(held, np.uint8, size, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(held, "<i8", offset=8 + size)
    return counts


def _planes(keys: np.ndarray) -> bytes:
    """Ascending keys, byte by byte: first bytes of neighbours are alike and compress well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _keys(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(_text.U64)


def _asker(slices: int):
    """What one step has of each slice: its distinct keys, ascending, and their counts in counted rows and in target rows."""

    def run(table: pa.Table) -> pa.Table:
        step = _Step.of(table.column("text"))
        keys, row = step.keys()
        counted, target = (table.column(c).to_numpy() for c in ("counted", "target"))
        values, inverse = np.unique(keys, return_inverse=True)
        n, own = (np.bincount(inverse, weights=w[row], minlength=len(values)).astype(np.int64) for w in (counted, counted & target))
        cuts = np.searchsorted(_sliced(values, slices), np.arange(slices + 1).astype(_text.U64))
        some = np.flatnonzero(np.diff(cuts))
        parts = [slice(cuts[i], cuts[i + 1]) for i in some]
        number = table.column("step")[0].as_py()
        return pa.table(
            [pa.array(some, pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array([_planes(values[p]) for p in parts], pa.binary()), pa.array([_small(n[p]) for p in parts], pa.binary()), pa.array([_small(own[p]) for p in parts], pa.binary())],
            names=["slice", "step", "keys", "n", "n_target"],
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each step that asks a slice, the counts of its keys in all steps."""
    asked = [_keys(x) for x in table.column("keys").to_pylist()]
    values, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    cuts = np.cumsum([len(x) for x in asked])[:-1]
    found = []
    for c in ("n", "n_target"):
        total = np.bincount(inverse, weights=np.concatenate([_large(x) for x in table.column(c).to_pylist()]), minlength=len(values)).astype(np.int64)
        found.append([_small(x) for x in np.split(total[inverse], cuts)])
    return pa.table([table.column("step"), table.column("slice"), pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary())], names=["step", "slice", "n", "n_target"])


def _units(nats: np.ndarray) -> np.ndarray:
    return np.rint(nats * UNIT).astype(np.int64)


def _scorer(totals: tuple[float, float], k: float):
    """The losses of the rows of a step, from its texts and the answers of all slices."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        step = _Step.of(texts.column("text"))
        values, inverse = np.unique(step.keys()[0], return_inverse=True)
        answers = answers.sort_by("slice")
        words, contexts, pairs = np.split(inverse, np.cumsum([len(step.hashes), len(step.followed)]))
        losses = []
        for c, total in zip(("n_target", "n"), totals[::-1], strict=True):
            counts = np.concatenate([np.zeros(0, np.int64), *(_large(x) for x in answers.column(c).to_pylist())])
            assert len(counts) == len(values)
            own = _units(np.log(counts[words] + 1.0))
            w = counts[words[step.followed + 1]] + 1.0
            own[step.followed + 1] += _units(-np.log1p(counts[contexts] / k)) + _units(np.log1p(counts[pairs] * total / (w * k)))
            sums = np.concatenate([[0], np.cumsum(own)])
            ends = np.cumsum(step.n)
            none = step.n == 0
            losses.append(pa.array(math.log(total) - (sums[ends] - sums[ends - step.n]) / UNIT / np.maximum(step.n, 1), mask=none))
        return pa.table([texts.column("doc_id"), pa.array(step.n.astype(np.int64)), *losses], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    return run


def _words(batches):
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False)
        for low, high, words, first in _text.tokens(batch.column("text"), _text.ALNUM):
            own = np.repeat(target[low:high], np.diff(first))
            values, inverse, n = np.unique(words, return_inverse=True, return_counts=True)
            n_target = np.bincount(inverse[own], minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(n_target)], names=["word", "n", "n_target"])


def totals(rows: DataFrame) -> tuple[float, float]:
    """Denominators of the smoothed unigram models of the background and the target: tokens, distinct words of all ``rows`` (text, target), and one."""
    found = rows.select("text", "target").mapInArrow(_words, "word long, n long, n_target long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    known, *held = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    return tuple(float(n + known + 1) for n in held)


def score_documents(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and difference of each row of ``rows`` (doc_id, text, target).

    Both models count ``rows``, the target's those with target.  If there is a
    column counted, rows where it is false are scored but not counted.

    A null or wordless text has no tokens and null losses.  Repeated rows come back
    alike; other columns are not looked at.  Without target documents the target
    model is uniform; without rows there is no result.  A null target or counted
    is false.
    """
    spark = rows.sparkSession
    _text.small_batches(spark)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c)
    counted = flag("counted") if "counted" in rows.columns else F.lit(True).alias("counted")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), flag("target"), counted)
    both = totals(rows.where("counted"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    steps, slices = size // plan.step + 1, size // plan.slice + 1
    # the partition spreads rows that repeat
    dealt = rows.withColumn("step", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(steps)))
    asked = dealt.select("step", "text", "target", "counted", "doc_id").groupBy("step").applyInArrow(_asker(slices), "slice long, step long, keys binary, n binary, n_target binary")
    answers = asked.groupBy("slice").applyInArrow(_answer, "step long, slice long, n binary, n_target binary")
    scored = dealt.select("step", "text", "target", "counted", "doc_id").groupBy("step").cogroup(answers.groupBy("step")).applyInArrow(_scorer(both, plan.backing), _SCORES)
    return cut(scored, "losses").withColumn("difference", F.col("target_loss") - F.col("background_loss"))
