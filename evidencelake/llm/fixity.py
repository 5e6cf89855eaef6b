"""WARC records, Merkle trees over their files, and audits of replicas.

A file's leaves are its records in the order of their offsets.  A node covers
neighbours of the level below, and so a range of offsets.  Which record opens a node
is decided by a hash of the record's name alone: at level l one record in ``FAN`` ** l
opens a node.  So a lost or added record changes the nodes around it and no others.
A node hashes the offsets, sizes and hashes of its children, and beside it their
hashes alone.  An audit compares the roots of two replicas and then only
the children of nodes that differ, level by level, down to records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.llm._store import cut

FAN = 16


def record(identity: str, url: str, body: str) -> Column:
    """A response record as text: headers, body, and two line ends."""
    size = F.octet_length(F.coalesce(F.col(body), F.lit("")))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), F.coalesce(F.col(identity).cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.regexp_replace(url, "[\r\n]", ""), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, F.coalesce(F.col(body), F.lit("")), F.lit("\r\n\r\n"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            at, rows = 0, []
            while at < len(content):
                head = content.find(b"\r\n\r\n", at)
                fields = dict(line.split(b": ", 1) for line in content[at:head].split(b"\r\n")[1:] if b": " in line) if head >= 0 else {}
                size = fields.get(b"Content-Length", b"").strip()
                end = head + 4 + int(size) + 4 if size.isdigit() else len(content)
                rows.append((path, at, min(end, len(content)) - at, hashlib.sha256(content[at:end]).hexdigest(), fields.get(b"WARC-Record-ID", b"").decode("utf-8", "replace"), fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), content[head + 4 : end - 4] if size.isdigit() else None))
                at = end
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "offset", "size", "hash", "record_id", "url", "body"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed WARC files: file, offset, size, hash, record_id, url, body.

    ``path`` is the folder of a replica; file is relative to it.  What follows a header
    that cannot be read is one record with a null body.  A file is one row in memory, so
    files are to be of a usual size (1 GB).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index(F.col("path"), path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(name.alias("path"), "content").mapInArrow(_records, "file string, offset long, size long, hash string, record_id string, url string, body binary")


def lay_out(records: DataFrame, files: int) -> DataFrame:
    """file, offset, size, hash and record_id of ``records`` (record_id, place, size, hash), dealt over ``files`` files.

    A record goes to the file that its id, its place (a number that does not depend
    on its content) and, for repeated records, the number of the copy choose; in a
    file records follow one another by these.  A file's rows are sorted together,
    so ``files`` must grow with the records.
    """
    copies = records.groupBy("record_id", "place", "size", "hash").agg(F.count("*").alias("m"))
    each = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).withColumn("file", F.pmod(F.xxhash64("record_id", "place", "copy"), F.lit(files)).cast("long"))
    inside = Window.partitionBy("file").orderBy("record_id", "place", "copy", "hash").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("file", (F.sum("size").over(inside) - F.col("size")).alias("offset"), "size", "hash", "record_id")


class Tree:
    """The levels of the trees of all files of one replica (file, offset, size, hash, record_id).

    Level 0 holds the records, the last one root a file.  Every row has the id of its node and,
    as up, that of its node one level higher.  A record's id stands for its record_id
    and, if a file has several of that name, its number among them; an unnamed record
    counts as named ''.  An empty replica has no rows at any level.
    """

    def __init__(self, laid: DataFrame):
        same = Window.partitionBy("file", "record_id").orderBy("offset", "hash")
        named = laid.select("file", "offset", "size", "hash", F.coalesce("record_id", F.lit("")).alias("record_id")).withColumn("copy", F.row_number().over(same))
        records = cut(named.withColumn("id", F.xxhash64("record_id", "copy")), "records")
        most = records.groupBy("file").count().agg(F.max("count")).first()[0] or 1
        height = max(1, math.ceil(math.log(most, FAN) - 1e-9))
        before = Window.partitionBy("file").orderBy("offset", "id").rowsBetween(Window.unboundedPreceding, 0)
        # every node above level 0 is named for the record that opens it, the first one 0; the root is 0 too
        opens = lambda level: F.coalesce(F.last(F.when(F.pmod("id", F.lit(FAN**level)) == 0, F.col("id")), True).over(before), F.lit(0).cast("long"))
        ups = [f"up{level}" for level in range(1, height)]
        inner = cut(records.select("*", *(opens(level).alias(f"up{level}") for level in range(1, height)), F.col("hash").alias("contents")), "leaves")
        inner = inner.withColumn("hash", F.sha2(F.concat_ws(":", "offset", "size", "hash"), 256))
        self.levels = [inner.select("file", "id", (F.col(ups[0]) if ups else F.lit(0).cast("long")).alias("up"), "offset", "size", "hash", "contents", "record_id")]
        for level in range(1, height + 1):
            above = ups[level:]
            key = F.col(f"up{level}") if level < height else F.lit(0).cast("long")
            children = F.array_sort(F.collect_list(F.struct("offset", "size", "hash", "contents")))
            nodes = inner.groupBy("file", key.alias("id"), *above).agg(children.alias("children"), F.min("offset").alias("offset"), (F.max(F.col("offset") + F.col("size")) - F.min("offset")).alias("size"))
            joined = lambda *c: F.sha2(F.array_join(F.transform("children", lambda x: F.concat_ws(":", *(x[n] for n in c))), "|"), 256)
            inner = cut(nodes.select("file", "id", *above, "offset", "size", joined("offset", "size", "hash").alias("hash"), joined("contents").alias("contents")), "nodes")
            self.levels.append(inner.select("file", "id", (F.col(above[0]) if above else F.lit(0).cast("long")).alias("up"), "offset", "size", "hash", "contents"))


def audit(one: Tree, two: Tree, offsets: bool = True) -> DataFrame:
    """The records in which two replicas differ: file, offset, size, record_id, status, hash_one and hash_two.

    status is corrupt (other contents), moved (the same at another offset, only if
    ``offsets`` count), missing (from the second) or extra (in it); offset and size are the
    first replica's if it has the record.  A lost record is missing, and those behind it in its file are
    moved.  A file that one replica lacks differs as a whole, and so does every file if
    one replica is empty.  Trees of different height have a root and their lower levels
    in common.
    """
    by = "hash" if offsets else "contents"
    common = min(len(one.levels), len(two.levels)) - 2
    steps = [(one.levels[-1], two.levels[-1]), *((one.levels[i], two.levels[i]) for i in range(common, -1, -1))]
    differing = None
    for k, pair in enumerate(steps):
        last = k == len(steps) - 1
        if differing is not None:
            # below the roots, levels that only one tree has are passed over
            up = F.lit(0).cast("long") if k == 1 else F.col("up")
            pair = [x.withColumn("up", up).join(differing.where(side).select("file", F.col("id").alias("up")), ["file", "up"], "left_semi") for x, side in zip(pair, ("in_one", "in_two"), strict=True)]
        more = ["contents", "record_id"] if last else []
        left, right = (x.select("file", "id", F.struct("offset", "size", F.col(by).alias("by"), *more).alias(n)) for x, n in zip(pair, "ab", strict=True))
        differing = left.join(right, ["file", "id"], "full_outer").where(~F.col("a.by").eqNullSafe(F.col("b.by")))
        if not last:
            differing = cut(differing.select("file", "id", F.col("a").isNotNull().alias("in_one"), F.col("b").isNotNull().alias("in_two")), "differing")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    status = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(F.col("a.contents") == F.col("b.contents"), "moved").otherwise("corrupt")
    return differing.select("file", pick("offset"), pick("size"), pick("record_id"), status.alias("status"), F.col("a.contents").alias("hash_one"), F.col("b.contents").alias("hash_two"))


def page_records(pages: DataFrame) -> DataFrame:
    """record_id, place, size and hash of the record of each row of ``pages`` (page_id, url, html); nulls are empty."""
    text = record("page_id", "url", "html")
    return pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("record_id"), F.xxhash64("url").alias("place"), F.octet_length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("hash"))
