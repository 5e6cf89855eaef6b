"""Near-duplicate classes of texts: MinHash, banding, verification, components.

Plan.  One pass hashes every text to its set of word shingles and keeps a
digest of the set, ``bands`` keys of ``rows`` minima each, and one byte of each
minimum.  Texts with equal sets form a class, of which one member goes on.
Within a small bucket of one band all classes meet, within a crowded one each
meets the bucket's hub.  Pairs whose signatures agree well
enough are confirmed on the full sets.  Links are first confirmed for one
partner per class; later pairs are looked at only where they would join two
components, and buckets that still hold several components are taken up again
by an exact rule (see ``NearDuplicates.rest``).  Nothing is gathered per group: hot classes and buckets are
skewed join keys on the side that adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import _text
from evidencelake.llm._store import cut
from evidencelake.llm.components import connected_components

U32 = np.uint32
#: Keys of fewer bytes than this may be broadcast, after they have been counted.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Similarity:
    """Which texts are near duplicates and how they are found.

    words: words in a shingle.  percent: least Jaccard similarity, in hundredths.
    rows: minima in a band.  miss: most chance that a pair at the least similarity
    shares no band; it sets the number of bands.  together: buckets of up to so
    many classes form all their pairs at once.  common: classes that hold a common
    shingle, see ``NearDuplicates.rest``.
    """

    words: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    together: int = 8
    common: int = 64

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def least_agreement(self) -> float:
        """Six standard errors under the least similarity."""
        p, n = self.percent / 100, self.bands * self.rows
        return p - 6 * math.sqrt(p * (1 - p) / n)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` universal hash functions a * x + b modulo 2**32 with odd a."""
    seeds = _text.mix(np.arange(1, n + 1, dtype=_text.U64) * _text.U64(0xA24BAED4963EE407))
    return (seeds >> _text.U64(32)).astype(U32) | U32(1), seeds.astype(U32)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(_text.shingles(words, k))


def digest(shingle_hashes: np.ndarray) -> tuple[int, int]:
    """Two sums of mixed hashes that stand for the whole set."""
    one, two = _text.mix(shingle_hashes), _text.mix(shingle_hashes * _text.U64(0xD1342543DE82EF95) + _text.U64(7))
    return int(one.sum(dtype=_text.U64).astype(np.int64)), int(two.sum(dtype=_text.U64).astype(np.int64))


def minima(shingle_hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each function over a non-empty set."""
    x = (shingle_hashes >> _text.U64(32)).astype(U32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=U32)
    for low in range(0, len(x), 1024):
        block = np.multiply.outer(a, x[low : low + 1024])
        block += b[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"


def _signer(p: Similarity):
    bands, rows, k = p.bands, p.rows, p.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(bands * rows)
        index = np.arange(bands, dtype=_text.U64) * _text.U64(0x9FB21C651E98DF25)
        weights = np.arange(1, rows + 1, dtype=_text.U64) * _text.U64(0xC2B2AE3D27D4EB4F) | _text.U64(1)
        for batch in batches:
            for low, high, words, first in _text.tokens(batch.column("text"), _text.NON_SPACE):
                n, d1, d2, keys, signs = [], [], [], [], []
                for i in range(high - low):
                    s = shingle_set(words[first[i] : first[i + 1]], k)
                    n.append(len(s))
                    if not len(s):
                        d1.append(0), d2.append(0), keys.append(None), signs.append(None)
                        continue
                    x, y = digest(s)
                    d1.append(x), d2.append(y)
                    m = minima(s, a, b)
                    key = _text.mix((m.reshape(bands, rows).astype(_text.U64) * weights).sum(axis=1, dtype=_text.U64) + index)
                    keys.append(key.astype(np.int64))
                    signs.append((m >> U32(8)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low:high].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "signature"],
                )

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimated similarity of each pair: equal bytes, less those expected by chance."""
    for batch in batches:
        a, b = (_text.rows_of_binary(batch.column(c)) for c in ("x", "y"))
        same = (a == b).mean(axis=1) if len(a) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((same - 1 / 256) / (1 - 1 / 256))], names=["a", "b", "agreement"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, d1, d2 = (batch.column(c).to_pylist() for c in ("cid", "d1", "d2"))
            for low, high, words, first in _text.tokens(batch.column("text"), _text.NON_SPACE):
                rows = [shingle_set(words[first[i] : first[i + 1]], k) for i in range(high - low)]
                own = [i for i, s in enumerate(rows) if digest(s) == (d1[low + i], d2[low + i])]
                yield pa.RecordBatch.from_arrays([pa.array([cid[low + i] for i in own], pa.int64()), pa.array([rows[i].astype(np.int64) for i in own], pa.list_(pa.int64()))], names=["cid", "shingles"])

    return run


def _meet(pairs: DataFrame, values: DataFrame, crowd: int = 64) -> DataFrame:
    """``pairs`` (a, b) with ``x`` and ``y``, the values (cid, value) of both ends.

    An end ``a`` with over ``crowd`` partners meets them in several groups, for
    each of which its value is sent once more.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / crowd).alias("fan"))
    dealt = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fan")).alias("part"))
    left = values.select(F.col("cid").alias("a"), F.col("value").alias("x")).join(fan, "a").select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("part"))
    return dealt.join(left, ["a", "part"]).select("a", "b", "x").join(values.select(F.col("cid").alias("b"), F.col("value").alias("y")), "b").select("a", "b", "x", "y")


class NearDuplicates:
    """The steps of ``near_duplicates``; each returns a DataFrame."""

    def __init__(self, docs: DataFrame, p: Similarity):
        _text.small_batches(docs.sparkSession)
        self.docs, self.p = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), p

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """One row per text with its class, and one row per class with what finds its partners."""
        signed = cut(self.docs.mapInArrow(_text.releasing(_signer(self.p)), _SIGNED), "signed")
        same = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        classes = cut(same.withColumn("cid", F.monotonically_increasing_id()), "classes")
        members = signed.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "cid", "rep"), ["d1", "d2"], "left")
        return members, classes

    def fits(self):
        """Whether two set sizes, n and m, allow the similarity."""
        return F.least("n", "m") * 100 >= F.greatest("n", "m") * self.p.percent

    def candidates(self, placed: DataFrame, buckets: DataFrame, crowded: DataFrame) -> DataFrame:
        """Pairs of classes that share a bucket: all of a small one, and each of a crowded one with its hub.

        The hub is the member that is in the most and largest crowded buckets, so
        that the buckets of one group of copies agree on a few hubs near its middle.
        """
        weight = crowded.groupBy("cid").agg(F.sum("size").alias("weight"))
        hubs = crowded.join(weight, "cid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("cid")).alias("last"), "n")).alias("hub")).select("key", (-F.col("hub.last")).alias("hub"), F.col("hub.n").alias("m"))
        star = crowded.join(hubs, "key").where("cid <> hub").where(self.fits()).select(F.col("hub").alias("a"), F.col("cid").alias("b"))
        few = placed.join(buckets.where(F.col("size") <= self.p.together).select("key"), "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cid", "n"))).alias("g"))
        inside = F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.struct(x.cid.alias("a"), y.cid.alias("b"), x.n.alias("n"), y.n.alias("m"))))
        return star.unionByName(few.select(F.inline(F.flatten(inside))).where(self.fits()).select("a", "b")).distinct()

    def agreeing(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs whose signatures allow the similarity."""
        both = _meet(pairs, classes.select("cid", F.col("signature").alias("value")))
        return both.mapInArrow(_agreement, "a long, b long, agreement double").where(F.col("agreement") >= self.p.least_agreement).select("a", "b")

    def sets(self, cids: DataFrame, classes: DataFrame) -> DataFrame:
        """The full sets of classes, each from the text of one member."""
        ids = cut(cids.distinct().join(classes, "cid").select("rep", "cid", "d1", "d2"), "wanted")
        if ids.count() * 32 < BROADCAST_BYTES:
            ids = F.broadcast(ids)
        found = self.docs.join(ids, F.col("doc_id") == F.col("rep")).select("cid", "d1", "d2", "text").mapInArrow(_text.releasing(_sets(self.p.words)), "cid long, shingles array<long>")
        return cut(found.groupBy("cid").agg(F.first("shingles").alias("value")), "sets")

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that the full sets confirm, as edges."""
        common = F.size(F.array_intersect("x", "y"))
        both = _meet(pairs, sets).select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("all"))
        return both.where(F.col("i") * 100 >= F.col("all") * self.p.percent).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components so far."""
        one = pairs.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        two = one.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return two.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def unsettled(self, crowded: DataFrame, labels: DataFrame) -> DataFrame:
        """Members (key, cid, n, component) of crowded buckets that hold several components."""
        large = crowded.drop("size").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        mixed = large.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        return cut(large.join(mixed, "key"), "unsettled")

    def rest(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Every pair of ``members`` that could still link two components.

        Members of a crowded bucket met only its hub.  Among them a
        shingle is common if ``common`` or more hold it.  Two sets that overlap
        enough either share a shingle that is not common, and meet on it in a list
        shorter than ``common``, or have no more in common than the smaller count of
        common shingles c, so that (100 + percent) * c >= percent * (n + m).  Sets with
        so few other shingles meet in their buckets, where the ones outside the most
        frequent component meet all others.
        """
        p, common = self.p, self.p.common
        own = members.select("cid", "n", "component").distinct()
        items = cut(own.join(sets, "cid").select("cid", "n", "component", F.explode("value").alias("item")), "items")
        often = items.groupBy("item").agg(F.count("*").alias("held")).where("held > 1")
        shared = cut(items.join(often, "item"), "shared")
        rare = shared.where(F.col("held") < common)
        left, right = (rare.select("item", *(F.col(c).alias(f"{c}{side}") for c in ("cid", "n", "component"))) for side in "12")
        fits = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * p.percent
        meet = left.join(right, "item").where((F.col("cid1") < F.col("cid2")) & (F.col("component1") != F.col("component2")) & fits).select(F.col("cid1").alias("a"), F.col("cid2").alias("b"))
        counts = shared.where(F.col("held") >= common).groupBy("cid").agg(F.count("*").alias("c"))
        poor = members.join(counts, "cid").where(F.col("c") * 100 >= F.col("n") * p.percent)
        main = poor.groupBy("key").agg(F.mode("component", True).alias("main"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "main")
        poor = poor.join(main, "key")
        odd, every = (poor.select("key", *(F.col(c).alias(f"{c}{side}") for c in ("cid", "n", "component", "c", "main"))) for side in "12")
        bound = F.least("c1", "c2") * (100 + p.percent) >= (F.col("n1") + F.col("n2")) * p.percent
        others = odd.where("component1 <> main1").join(every, "key").where((F.col("component1") != F.col("component2")) & fits & bound).select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b"))
        return meet.unionByName(others).distinct()

    def run(self) -> DataFrame:
        members, classes = self.classes()
        placed = classes.select("cid", "n", F.explode("bands").alias("key"))
        buckets = cut(placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
        crowded = cut(placed.join(buckets.where(F.col("size") > self.p.together), "key"), "crowded")
        pairs = cut(self.agreeing(self.candidates(placed, buckets, crowded), classes), "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(crowded.select("cid")), classes)
        first = pairs.groupBy("b").agg(F.min("a").alias("a"))
        edges = cut(self.linked(first, sets), "links")
        labels = connected_components(edges, rounds=1)  # enough to leave most pairs aside
        others = self.apart(pairs.join(first, ["a", "b"], "left_anti"), labels)
        edges = edges.unionByName(cut(self.linked(others, sets), "links"))
        labels = connected_components(edges)
        unsettled = self.unsettled(crowded, labels)
        if not unsettled.isEmpty():
            rest = self.agreeing(cut(self.rest(unsettled, sets), "rest"), classes)
            last = cut(self.linked(rest, sets), "links")
            if not last.isEmpty():
                labels = connected_components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(last))
        reps = classes.select(F.col("cid").alias("node"), "rep").join(labels, "node")
        least = reps.groupBy("component").agg(F.min("rep").alias("least"))
        named = reps.select("node", "component").join(least, "component").select(F.col("node").alias("cid"), "least")
        out = members.join(named, "cid", "left").withColumn("component_id", F.coalesce("least", "rep", "doc_id"))
        return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """Class of each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text's
    set holds its distinct runs of ``similarity.words`` words, or with fewer words
    the one run of them all.  Texts are linked if the Jaccard similarity of their
    sets is at least ``similarity.percent`` / 100, and component_id is the smallest
    doc_id that links reach.

    Defined cases: a null or wordless text has no shingle, is linked with nothing
    and is its own component.  Repeated rows each come back and share a
    component; if a doc_id repeats with different texts, each row has the
    component of its own text.  A null doc_id is linked with nothing, has a null
    component and counts as kept.  Other columns are not looked at.
    """
    return NearDuplicates(docs, similarity).run()
