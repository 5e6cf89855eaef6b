"""Benchmark passages in training texts, by a distributed positional inverted index.

The index is a stored table with one row per block of about a megabyte of text.
A row holds its documents and, for each term of the test set, the ascending
positions of its postings in the block; documents are set apart so far that no
phrase spans two.  Every window of a test item is then looked up in every block:
starting from the posting list of the term that is rarest in all training texts,
lists shifted by their terms' offsets are intersected, rarest first, until none
is left.  What remains are exact phrases.  A proximity match needs every term of
the window within ``reach`` words of an occurrence of the rarest.

Only the test set is broadcast, in slices of bounded size; each slice is one
pass over the texts.  Blocks are independent, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import _text
from evidencelake.llm._store import cut

_INDEX = "rows array<struct<doc_id: bigint, at: int, n: int>>, terms array<int>, counts array<int>, positions binary"
_FOUND = "block bigint, place int, doc_id bigint, n_words bigint, hits array<struct<low: int, high: int>>, items array<bigint>, near array<bigint>"


@dataclass(frozen=True)
class Matching:
    """Words in a window, words that a proximity match may be away, and words of test items in a slice."""

    words: int = 10
    reach: int = 20
    slice_words: int = 2_000_000


@dataclass
class TestSet:
    """Terms (sorted hashes) and distinct windows of a slice: term numbers (-1 after the end), and the items of each."""

    terms: np.ndarray
    windows: np.ndarray
    items: list[np.ndarray]

    @classmethod
    def of(cls, ids: list[int], texts: list[str], m: Matching) -> TestSet:
        rows, owners = [], []
        for low, high, words, first in _text.tokens(pa.array(texts, pa.string()), _text.ALNUM):
            for i in range(high - low):
                w = words[first[i] : first[i + 1]]
                size = min(m.words, len(w))
                for k in range(len(w) - size + 1 if size else 0):
                    rows.append(w[k : k + size])
                    owners.append(ids[low + i])
        terms = np.unique(np.concatenate(rows)) if rows else np.zeros(0, _text.U64)
        windows = np.full((len(rows), m.words), -1, dtype=np.int32)
        for i, w in enumerate(rows):
            windows[i, : len(w)] = np.searchsorted(terms, w)
        if not rows:
            return cls(terms, windows, [])
        distinct, inverse = np.unique(windows, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        cuts = np.searchsorted(inverse.ravel()[order], np.arange(1, len(distinct)))
        return cls(terms, distinct, [np.unique(x) for x in np.split(np.array(owners)[order], cuts)])


def _indexer(shared, m: Matching):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        low16 = _text.U64(0xFFFF)
        maybe = np.zeros(1 << 16, bool)
        maybe[terms & low16] = True
        gap = max(m.words, m.reach) + 1
        for batch in batches:
            for low, high, words, first in _text.tokens(batch.column("text"), _text.ALNUM):
                n = np.diff(first)
                at = first[:-1] + gap * np.arange(len(n))
                found = np.flatnonzero(maybe[words & low16])
                if len(terms):
                    place = np.minimum(np.searchsorted(terms, words[found]), len(terms) - 1)
                    hit = terms[place] == words[found]
                    found, place = found[hit], place[hit]
                else:
                    found, place = found[:0], found[:0]
                position = found + gap * np.searchsorted(first[1:], found, side="right")
                order = np.argsort(place, kind="stable")
                own, counts = np.unique(place, return_counts=True)
                rows = pa.StructArray.from_arrays([batch.column("doc_id")[low:high].cast(pa.int64()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "at", "n"])
                one = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([own.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([position[order].astype(np.int32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(one, names=["rows", "terms", "counts", "positions"])

    return run


def _inside(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among ``sorted_values``."""
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == wanted


def _matches(block: tuple, tests: TestSet, order: np.ndarray, rare: np.ndarray, m: Matching) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(window, its length, starts of exact phrases, places of the rarest term in proximity matches) in one block."""
    terms, counts, positions = block
    where = np.full(len(tests.terms) + 1, -1)
    where[terms] = np.arange(len(terms))
    where[-1] = len(terms)  # the padding of short windows is always there
    ends = np.cumsum(counts)
    alive = np.flatnonzero((where[tests.windows] >= 0).all(axis=1)) if len(terms) else []
    for w in alive:
        window = tests.windows[w]
        size = int((window >= 0).sum())
        lists = {}
        starts = None
        for offset in order[w][:size]:
            t = window[offset]
            if t not in lists:
                k = where[t]
                lists[t] = positions[ends[k] - counts[k] : ends[k]]
            shifted = lists[t] - offset
            starts = shifted if starts is None else starts[_inside(shifted, starts)]
            if not len(starts):
                break
        close = np.zeros(0, np.int32)
        if m.reach:
            close = lists[window[rare[w]]]
            for t in set(window[order[w][:size]].tolist()) - {window[rare[w]]}:
                k = where[t]
                other = positions[ends[k] - counts[k] : ends[k]]
                at = np.searchsorted(other, close - m.reach)
                near = at < len(other)
                near[near] = other[at[near]] <= close[near] + m.reach
                close = close[near]
                if not len(close):
                    break
        if len(starts) or len(close):
            yield w, size, starts, close


def _searcher(shared, m: Matching):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, frequency = shared.value
        padded = np.append(frequency, np.iinfo(np.int64).max)
        order = np.argsort(padded[tests.windows], axis=1, kind="stable")
        rare = order[:, 0] if len(order) else np.zeros(0, np.int64)
        for batch in batches:
            for block, rows, terms, counts, raw in zip(batch.column("block").to_pylist(), batch.column("rows"), batch.column("terms"), batch.column("counts"), batch.column("positions"), strict=True):
                rows = rows.values
                at, n = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
                number = len(at)
                hits, items, near = [[[] for _ in range(number)] for _ in range(3)]
                held = (terms.values.to_numpy(), counts.values.to_numpy().astype(np.int64), np.frombuffer(raw.as_buffer(), dtype=np.int32))
                for w, size, starts, close in _matches(held, tests, order, rare, m):
                    for start, row in zip(starts, np.searchsorted(at, starts, side="right") - 1, strict=True):
                        hits[row].append((int(start - at[row]), int(start - at[row]) + size))
                        items[row].extend(tests.items[w].tolist())
                    for row in np.unique(np.searchsorted(at, close, side="right") - 1):
                        near[row].extend(tests.items[w].tolist())
                hits = [[{"low": a, "high": b} for a, b in _union(x)] for x in hits]
                pairs = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * number, pa.int64()), pa.array(np.arange(number, dtype=np.int32)), rows.field("doc_id"), pa.array(n), pa.array(hits, pairs), pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())), pa.array([sorted(set(x)) for x in near], pa.list_(pa.int64()))],
                    names=["block", "place", "doc_id", "n_words", "hits", "items", "near"],
                )

    return run


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [[{"low": a, "high": b} for a, b in _union([(r["low"], r["high"]) for r in x])] for x in batch.column("hits").to_pylist()]
        at = batch.schema.get_field_index("hits")
        yield batch.set_column(at, batch.schema.field(at), pa.array(hits, batch.column("hits").type))


def test_items(benchmark: DataFrame, m: Matching) -> Iterator[TestSet]:
    """Slices of the items with an id and a text, each of bounded size."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    slices = -(-size // m.slice_words) or 1
    for i in range(slices):
        rows = sorted((r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).collect())
        yield TestSet.of([r[0] for r in rows], [r[1] for r in rows], m)


def find_passages(docs: DataFrame, benchmark: DataFrame, m: Matching = Matching()) -> DataFrame:
    """For each row of ``docs`` (doc_id, text), what it holds of the items of ``benchmark`` (item_id, text).

    Returns doc_id, n_words, hits (ranges of words inside exact windows, merged),
    items (ids with an exact window) and near (ids with a proximity match, exact
    ones among them).  Words are runs of ASCII letters and digits and of all
    non-ASCII characters, A-Z lower-cased.  An item of fewer words than a window is
    one window.  Null or wordless texts and items have no words and match nothing;
    items without an id are left out; an id that repeats stands for all its texts.
    Repeated documents each come back.  Other columns are not looked at.
    """
    _text.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for tests in test_items(benchmark, m):
        index = cut(texts.mapInArrow(_text.releasing(_indexer(spark.sparkContext.broadcast(tests), m)), _INDEX).withColumn("block", F.monotonically_increasing_id()), "postings")
        counted = index.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("n")).collect()
        frequency = np.zeros(len(tests.terms), np.int64)
        for r in counted:
            frequency[r["terms"]] = r["n"]
        found.append(index.mapInArrow(_text.releasing(_searcher(spark.sparkContext.broadcast((tests, frequency)), m)), _FOUND))
    if len(found) == 1:
        return found[0].drop("block", "place")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # slices read the same files in the same order, but blocks are numbered by partition: rows meet by document and place
    one = every.groupBy("block", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return one.mapInArrow(_merge, _FOUND).drop("block", "place")


def contamination(docs: DataFrame, benchmark: DataFrame, m: Matching = Matching()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near; see ``find_passages``."""
    found = find_passages(docs, benchmark, m)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, r: total + (r.high - r.low))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))
