"""What sets of two rows have in common, for all pairs of a task's rows, in memory that grows with the rows alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of rows that are counted at once, times that a product of matrices is cheaper a pair than a list, and cells of a table of membership.
CELLS, CHEAPER, TABLE = 1 << 20, 1000, 1 << 26


class Sets:
    """The sets of some rows: the distinct codes of row r are ``code[start[r] : start[r + 1]]``, in order, each below ``width``."""

    def __init__(self, row: np.ndarray, code: np.ndarray, rows: int, width: int):
        self.width = max(int(width), 1)
        self.key = np.unique(row.astype(np.int64) * self.width + code)
        self.row, self.code = np.divmod(self.key, self.width)
        self.size = np.bincount(self.row, minlength=rows)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self._table: np.ndarray | None = None

    def where(self, kept: np.ndarray) -> Sets:
        """The sets without codes for which ``kept`` is false."""
        held = kept[self.code]
        return Sets(self.row[held], self.code[held], len(self.size), self.width)

    def holds(self, row: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether each row's set has the code beside it."""
        key = row * self.width + code
        if len(self.size) * self.width > TABLE:
            at = np.searchsorted(self.key, key)
            return self.key[np.minimum(at, len(self.key) - 1)] == key if len(self.key) else np.zeros(len(key), dtype=bool)
        if self._table is None:
            self._table = np.zeros(len(self.size) * self.width, dtype=bool)
            self._table[self.key] = True
        return self._table[key]

    def common(self, rows: np.ndarray, other: Sets, others: np.ndarray) -> np.ndarray:
        """How many codes each of ``rows`` has in common with the row of ``other`` beside it."""
        many = self.size[rows]
        pair = np.repeat(np.arange(len(rows)), many)
        at = np.arange(len(pair)) - (np.cumsum(many) - many)[pair] + self.start[rows][pair]
        return np.bincount(pair[other.holds(others[pair], self.code[at])], minlength=len(rows))


def numbered(values: pa.Array) -> np.ndarray:
    """Numbers of ``values`` in their order, equal ones alike and nulls -1."""
    coded = values.dictionary_encode()
    place = np.empty(len(coded.dictionary) + 1, dtype=np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)] = np.arange(len(coded.dictionary))
    place[-1] = -1
    return place[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]


def sets(*lists: pa.Array) -> tuple[list[Sets], pa.Array]:
    """The sets of columns of lists of text without nulls, in one numbering, and the values by their number."""
    flat = [v.flatten() for v in lists]
    values = pc.unique(pa.concat_arrays(flat)).drop_null()
    values = values.take(pc.sort_indices(values))
    found = []
    for column, each in zip(lists, flat, strict=True):
        row = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        code = pc.index_in(each, value_set=values)
        there = code.is_valid().to_numpy(zero_copy_only=False)
        found.append(Sets(row[there], code.drop_null().to_numpy(zero_copy_only=False), len(column), len(values)))
    return found, values


def character_pairs(texts: pa.Array) -> Sets:
    """The pairs of neighbouring characters of each text; a text of one character has that."""
    texts = texts.fill_null("")
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), length)
    letter = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    follows = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, dtype=bool)
    pair = (letter << 21) | np.where(follows, np.append(letter[1:], 0), 0) if len(row) else letter
    kept = follows | (length[row] == 1)
    values, code = np.unique(pair[kept], return_inverse=True)
    return Sets(row[kept], code.ravel(), len(texts), len(values))


class Meeting:
    """Counts of common codes between rows ``low`` to ``middle`` and rows ``right`` to ``high`` of ``held``.

    Codes that many rows have are counted by a product of matrices, and the others by lists of the rows that have each.
    """

    def __init__(self, held: Sets, low: int, middle: int, right: int, high: int):
        self.low, self.right, self.columns = low, right, high - right
        of = lambda a, b: slice(held.start[a], held.start[b])
        a, b = of(low, middle), of(right, high)
        often = np.bincount(held.code[a], minlength=held.width).astype(float) * np.bincount(held.code[b], minlength=held.width)
        dense = often * CHEAPER > (middle - low) * self.columns
        column = np.cumsum(dense) - 1

        def matrix(part: slice, first: int, rows: int) -> np.ndarray:
            out, many = np.zeros((rows, int(dense.sum())), dtype=np.float32), dense[held.code[part]]
            out[held.row[part][many] - first, column[held.code[part][many]]] = 1
            return out

        self.a = matrix(a, low, middle - low)
        self.b = self.a if (low, middle) == (right, high) else matrix(b, right, self.columns)
        rare = (often > 0) & ~dense
        mine, theirs = rare[held.code[a]], rare[held.code[b]]
        self.row, self.code = held.row[a][mine] - low, held.code[a][mine]
        code, row = held.code[b][theirs], held.row[b][theirs] - right
        order = np.argsort(code, kind="stable")
        self.posted, self.first = row[order], np.searchsorted(code[order], np.arange(held.width + 1))

    def counts(self, low: int, high: int, right: int) -> np.ndarray:
        """The counts of rows ``low`` to ``high`` of the left (rows) with those from ``right`` on of the right (columns)."""
        out = self.a[low - self.low : high - self.low] @ self.b[right - self.right :].T
        some = slice(*np.searchsorted(self.row, [low - self.low, high - self.low]))
        code, row = self.code[some], self.row[some] - (low - self.low)
        many = self.first[code + 1] - self.first[code]
        if many.sum():
            entry = np.repeat(np.arange(len(code)), many)
            column = self.posted[np.arange(len(entry)) - (np.cumsum(many) - many)[entry] + self.first[code][entry]] - (right - self.right)
            there = column >= 0
            np.add.at(out.reshape(-1), row[entry][there] * out.shape[1] + column[there], np.float32(1))
        return out
