"""The best of each query over what a task sees, in memory that grows with neither the points nor the batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that leave a task in one batch.
ROWS = 65536


class Best:
    """The ``k`` points of the largest score of each of ``queries`` queries; ties go to the smaller id.

    Scores have to be rounded as they are ranked: a point is dropped only for ``k`` others that
    come before it in that very order.
    """

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.full((queries, k), -np.inf), np.zeros((queries, k), dtype=np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in points ``ids``, whose scores for the queries from ``first`` on are the rows of ``scores``; -inf is no hit."""
        least = self.score[first : first + len(scores), -1]
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        touched, row_of = np.unique(row, return_inverse=True)
        held = self.score[first + touched]
        old, place = np.nonzero(held > -np.inf)
        rows = np.concatenate([old, row_of.ravel()])
        score = np.concatenate([held[old, place], scores[row, column]])
        found = np.concatenate([self.id[first + touched[old], place], ids[column]])
        order = np.lexsort((found, -score, rows))
        rows, score, found = rows[order], score[order], found[order]
        at = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = at < self.k
        rows, at = first + touched[rows[kept]], at[kept]
        self.score[rows, at], self.id[rows, at] = score[kept], found[kept]

    def batches(self, names: np.ndarray, labels: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
        """What is held: the query of ``names``, the point and its score, under ``labels``."""
        step = max(1, ROWS // self.k)
        for low in range(0, len(self.score), step):
            score = self.score[low : low + step]
            row, place = np.nonzero(score > -np.inf)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(names[low + row]), pa.array(self.id[low + row, place]), pa.array(score[row, place])], names=list(labels))
