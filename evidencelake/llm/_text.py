"""Vectorised byte-level tokenising and hashing of Arrow string columns.

Words are found on the UTF-8 bytes of whole Arrow buffers: every separator of
the tokenisers used here is ASCII, so a byte table decides exactly what a
code-point class would.  A word's hash is a polynomial over its bytes, taken
from prefix sums, and then mixed; sequences of words hash alike.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEQ = U64(0xD6E8FEB86659FD93)

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch: texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Anything but ASCII white space.
NON_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ASCII digits and letters (either case), and every non-ASCII byte.
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix: a bijection that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values() -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64) * _BASE)
    v[0x41:0x5B] = v[0x61:0x7B]  # A-Z count as a-z
    return v


_VALUES = _byte_values()
#: The same with A-Z apart from a-z.
EXACT = mix(np.arange(1, 257, dtype=U64) * _BASE)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, STEP_BYTES)
        for name, base in (("p", _BASE), ("q", _BASE_INVERSE)):
            out = np.full(size, base, dtype=U64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    p, q = _POWERS["p"], _POWERS["q"]
    if len(p) > 8 * STEP_BYTES:
        _POWERS.clear()  # made for one very long document
    return p[:n], q[:n]


def small_batches(spark) -> None:
    """Let the session hand texts to Python in batches of at most ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Give freed memory back to the system: the driver, and Python workers between tasks, live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(run):
    """``run`` on the batches of a task, with the memory given back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``pool[start : start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased unless ``values`` holds other numbers for the bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    p, q = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((_VALUES if values is None else values)[data] * p, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts])


def tokens(column: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, index of each row's first word and the total) step by step."""
    data, offsets = buffers(column)
    for low, high in steps(offsets):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = spans(part, at, inside)
        yield low, high, word_hashes(part, starts, ends), first


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words of one row; with fewer words, of them all as one."""
    n = len(words)
    if not n:
        return words
    m = min(k, n)
    out = words[: n - m + 1].copy()
    for i in range(1, m):
        out = out * _SEQ + words[i : n - m + 1 + i]
    return mix(out + U64(m))


def rows_of_binary(column: pa.Array) -> np.ndarray:
    """A column of equally long, non-null binary values as a matrix of bytes."""
    if not len(column):
        return np.zeros((0, 0), np.uint8)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].reshape(len(column), -1)
