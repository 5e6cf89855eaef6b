"""Fingerprints of weighted terms by consistent weighted sampling, in DataFrame functions only.

Terms are words, told apart by 64-bit hashes, weighted by their count.  For
slot i and term k there are fixed samples r, c ~ Gamma(2, 1) and b ~ U(0, 1); with
weight S, t = floor(ln S / r + b), ln y = r (t - b) and ln a = ln c - ln y - r.  The
slot keeps (k, t) of the term with the least a.  Two texts agree in a slot with a
probability equal to the generalised Jaccard similarity of their weighted terms,
so the share of equal slots estimates it.

The samples come from a table of fixed size, broadcast: a term takes r and b from the
bucket that some bits of its hash name, and c from the one that others name.  A slot
names the term by its own hash, so terms that share buckets stay apart; two terms
share both with a probability of 2^-26.  Everything about one text stays
in the task that has the text: texts are dealt out by key once, and the counts,
the minima and the join with the next document's opening all keep that layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.llm._store import cut

BUCKETS = 1 << 13
SLOTS = 64
#: Low bits of a slot that name the sampled term and its t; the bits above hold a.
_NAME_BITS = 31
_NAME = (1 << _NAME_BITS) - 1
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEY = ["k", "h"]
#: A key with more than this share of all rows is merged before texts are dealt out.
CROWD = 256
#: Stands for a null doc_id in keys.
_NO_ID = -(1 << 63)


def _uniform(bucket: str, i: Column, which: int) -> Column:
    """A number in (0, 1), fixed for the bucket, the slot and the purpose."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(bucket), i, F.lit(which)), 12)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _packed(part: Column) -> Column:
    """A summand of a, over -100, in the high bits of a slot."""
    return F.shiftleft(((part + 100.0) * 1e6).cast("long"), _NAME_BITS)


def sampling_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """bucket with arrays of all slots (r, 1 / r, b and packed r (b - 1)), and other with the array of packed ln c."""

    def gamma(i: Column, one: int) -> Column:
        return -F.log(_uniform("bucket", i, one)) - F.log(_uniform("bucket", i, one + 1))

    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    buckets = spark.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    rb = buckets.select("bucket", F.transform(slots, lambda i: gamma(i, 1)).alias("r"), F.transform(slots, lambda i: _uniform("bucket", i, 5)).alias("b"))
    rb = rb.select("*", F.transform("r", lambda r: 1.0 / r).alias("over_r"), F.zip_with("r", "b", lambda r, b: _packed(r * (b - 1.0))).alias("single"))
    return rb, buckets.select(F.col("bucket").alias("other"), F.transform(slots, lambda i: _packed(F.log(gamma(i, 3)))).alias("lnc"))


def _slot(i: int) -> Column:
    """The packed sample of slot ``i``: a in the high bits, the name of (term, t) in the low ones.

    A term that occurs once has ln S = 0 and t = 0.
    """
    at = lambda c: F.get(c, F.lit(i))
    t = F.floor(F.col("ln_s") * at("over_r") + at("b"))
    name = (F.col("name") + t * F.lit(40503)).bitwiseAND(F.lit(_NAME))
    return F.when(F.col("ln_s") == 0.0, at("single") + at("lnc") + F.col("name")).otherwise(_packed(at("r") * (at("b") - 1.0 - t)) + at("lnc") + name)


def _sorted_hashes(text: Column) -> Column:
    """The hashes of a text's words, ascending; a text without words has the one term ''."""
    words = F.filter(F.split(F.lower(text), _SEPARATORS), lambda w: w != "")
    return F.sort_array(F.transform(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(""))), lambda w: F.xxhash64(w)))


def _ends(hashes: str) -> Column:
    """Places after the last of each run of equal hashes."""
    n = F.size(hashes)
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(hashes, i) != F.get(hashes, i - 1)))


def _terms(which: int) -> Column:
    """The terms of text ``which``, each with its count."""
    hashes, ends = F.col(f"hashes{which}"), F.col(f"ends{which}")
    return F.transform(ends, lambda e, j: F.struct(F.lit(which).alias("which"), F.get(hashes, e - 1).alias("term"), (e - F.coalesce(F.get(ends, j - 1), F.lit(0))).alias("s")))


def signatures(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys``, which and signature (array of SLOTS ints) of the text in each of ``columns``; the keys are unique.

    A text's words are sorted and counted in its own row; only its distinct terms
    become rows, and those never leave the task if ``texts`` is already dealt out by
    some of the keys.
    """
    number = range(len(columns))
    hashed = texts.select(*keys, *(_sorted_hashes(F.col(c)).alias(f"hashes{i}") for i, c in enumerate(columns)))
    ended = hashed.select("*", *(_ends(f"hashes{i}").alias(f"ends{i}") for i in number))
    counts = ended.select(*keys, F.inline(F.concat(*(_terms(i) for i in number))))
    bits = lambda low: F.shiftrightunsigned("term", low).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    terms = counts.select(*keys, "which", F.log("s").alias("ln_s"), bits(51).alias("bucket"), bits(38).alias("other"), F.col("term").bitwiseAND(F.lit(_NAME)).alias("name"))
    rb, c = sampling_tables(texts.sparkSession)
    drawn = terms.join(F.broadcast(rb), "bucket").join(F.broadcast(c), "other")
    least = drawn.groupBy(*keys, "which").agg(*(F.min(_slot(i)).alias(f"s{i}") for i in range(SLOTS)))
    return least.select(*keys, "which", F.array(*(F.col(f"s{i}").bitwiseAND(F.lit(_NAME)).cast("int") for i in range(SLOTS))).alias("signature"))


def likeness(a: str, b: str) -> Column:
    """Share of equal slots of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x) / float(SLOTS)


def as_text(signature: str) -> Column:
    """A signature as hexadecimal digits, eight a slot."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")), ""))


def neighbours(rows: DataFrame) -> DataFrame:
    """Keys (k, h) of the distinct ``rows`` (k, h, n) with their count m and size n, and the key and size of the next and previous one.

    The order is descending k, then h; after the last comes the first.  Keys are
    sorted by range; only the ends of all ranges are looked at together.
    """
    own = rows.groupBy(*_KEY).agg(F.count("*").alias("m"), F.min("n").alias("n"))
    place = (F.bitwise_not("k"), F.col("h"))
    ranged = cut(own.repartitionByRange(*place).withColumn("range", F.spark_partition_id()), "keys")
    row = F.struct("k", "h", "n")
    inside = Window.partitionBy("range").orderBy(*place)
    near = ranged.withColumn("next", F.lead(row).over(inside)).withColumn("previous", F.lag(row).over(inside))
    position = F.struct(*(p.alias(f"p{i}") for i, p in enumerate(place)))
    ends = ranged.groupBy("range").agg(F.min_by(row, position).alias("first"), F.max_by(row, position).alias("last"))
    across = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lead("first").over(across), F.first("first").over(whole)).alias("after"), F.coalesce(F.lag("last").over(across), F.last("last").over(whole)).alias("before"))
    return near.join(F.broadcast(ends), "range").select(*_KEY, "m", "n", F.coalesce("next", "after").alias("next"), F.coalesce("previous", "before").alias("previous"))


def without_crowds(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` with one row of each key (k, h) that has over a ``CROWD``-th of all rows.

    There are fewer than ``CROWD`` such keys, so they are broadcast, and equal rows are
    merged before they leave their tasks.
    """
    total = keys.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    crowds = F.broadcast(keys.where(F.col("m") * CROWD > F.greatest(F.lit(total), F.lit(CROWD))).select(*_KEY))
    return texts.join(crowds, _KEY, "left_anti").unionByName(texts.join(crowds, _KEY, "left_semi").groupBy(*_KEY).agg(F.max("text").alias("text")).select(*texts.columns))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, its edited text's, and how alike they and the next document's are.

    ``docs`` has doc_id and text (null: empty).  The edited text has the last
    floor(n / 2) of the n code points replaced by the first as many, or all, of the
    next document in descending doc_id; after the last comes the first.  Rows that
    repeat whole each come back, with one next document; rows of one doc_id with
    different texts follow one another in the order of a hash; a null doc_id comes
    last.  An only document is its own next one.  Other columns are not looked at.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = cut(neighbours(texts.select(*_KEY, F.length("text").alias("n"))), "neighbours")
    held = without_crowds(texts, keys)
    # texts are the streamed side of both joins: they are dealt out once and never sorted
    beside = lambda rows: rows.hint("shuffle_hash")
    opening = held.join(beside(keys.select(*_KEY, "previous")), _KEY).select(F.col("previous.k").alias("k"), F.col("previous.h").alias("h"), F.left("text", F.floor(F.col("previous.n") / 2).cast("int")).alias("opening"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    one = opening.groupBy(*_KEY).agg(F.max("opening").alias("opening"))  # rows that repeat have one
    pair = held.join(beside(one), _KEY).select(*_KEY, "text", F.concat(F.left("text", n - half), F.left("opening", half)).alias("edited"))
    signed = signatures(pair.withColumn("sha", F.unhex(F.sha2("edited", 256))), [*_KEY, "sha"], ["text", "edited"])
    own = lambda which: F.max(F.when(F.col("which") == which, F.col("signature")))
    rows = cut(signed.groupBy(*_KEY).agg(own(0).alias("own"), own(1).alias("edited"), F.max("sha").alias("sha")), "fingerprints")
    following = rows.select("k", "h", F.col("own").alias("following")).join(keys.select("k", "h", F.col("previous.k").alias("to_k"), F.col("previous.h").alias("to_h")), _KEY).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), "following")
    every = rows.join(keys.select(*_KEY, "m", "n"), _KEY).join(following, _KEY).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    doc_id = F.when(F.col("k") != _NO_ID, F.col("k"))
    return every.select(doc_id.alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("edited").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"), likeness("own", "following").alias("near_next"))
