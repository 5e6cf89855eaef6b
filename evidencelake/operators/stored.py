"""Stored tables that are published as a whole: keyword and vector indexes, and a ledger of their builds.

A build writes its tables to a folder of its own, reads them back and checks them, and only then
publishes the folder by one pointer: a small file with the next number, which the file system
creates for one writer only.  Readers follow the pointer of the largest number.  A build
that fails leaves what is published as it was, and rolling back publishes an earlier folder again.
Every build, whatever its end, leaves a record in the ledger.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import keyword

RUN = "run_id string, operation string, status string, version string, started_at timestamp, finished_at timestamp, manifest string, error string"


class BuildError(ValueError):
    """What was stored is not what should have been."""


@dataclass(frozen=True)
class Version:
    """A published folder: its pointer's number, its name and the manifest of its build."""

    number: int
    name: str
    manifest: dict


class Store:
    """The versions under ``folder``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[Version]:
        """All publications in order; a pointer that is still being written does not count."""
        files, at = self._files(), self._path("pointers")
        if not files.exists(at):
            return []
        out = []
        for status in files.listStatus(at):
            name = status.getPath().getName()
            if name.isdigit() and status.getLen():
                stream = files.open(status.getPath())
                try:
                    said = bytes(stream.readNBytes(int(status.getLen()))).decode()
                finally:
                    stream.close()
                try:
                    held = json.loads(said)
                except ValueError:
                    continue
                out.append(Version(int(name), held["version"], held["manifest"]))
        return sorted(out, key=lambda v: v.number)

    def current(self) -> Version | None:
        """The published version."""
        return max(self.versions(), key=lambda v: v.number, default=None)

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        """A table of a version, the published one if none is named."""
        version = version or self.current()
        if version is None:
            raise BuildError("nothing is published")
        return self.spark.read.parquet(f"{self.folder}/versions/{version.name}/{name}")

    def _point(self, name: str, manifest: dict) -> Version:
        """Publish a folder under the next number that no other writer takes."""
        files, number = self._files(), (v.number if (v := self.current()) else 0) + 1
        files.mkdirs(self._path("pointers"))
        while True:
            try:
                stream = files.create(self._path("pointers", f"{number:010d}"), False)
                break
            except Exception as e:  # taken by another writer
                if not files.exists(self._path("pointers", f"{number:010d}")):
                    raise e
                number += 1
        stream.write(bytearray(json.dumps({"version": name, "manifest": manifest}, sort_keys=True).encode()))
        stream.close()
        return Version(number, name, manifest)

    def build(self, operation: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], check: Callable[[dict[str, DataFrame]], dict], manifest: dict | None = None) -> Version:
        """Write ``tables`` in their order, have ``check`` look at them as they were stored, and publish them.

        A table may be a function of those stored before it.  ``check`` returns what the manifest
        is to say of the tables, and raises BuildError if they are not as they should be.
        """
        name, began = uuid.uuid4().hex, datetime.datetime.now(datetime.timezone.utc)
        try:
            stored: dict[str, DataFrame] = {}
            for table, rows in tables.items():
                made = rows(stored) if callable(rows) else rows
                made.write.parquet(f"{self.folder}/versions/{name}/{table}")
                stored[table] = self.spark.read.schema(made.schema).parquet(f"{self.folder}/versions/{name}/{table}")
            version = self._point(name, (manifest or {}) | check(stored))
        except Exception as e:
            self._record(name, operation, "failed", began, {}, str(e)[:500])
            raise
        self._record(name, operation, "published", began, version.manifest, None)
        return version

    def roll_back(self, steps: int = 1) -> Version:
        """Publish again what was published before the current version, ``steps`` different folders back."""
        names: list[Version] = []
        for v in reversed(self.versions()):
            if v.name not in {n.name for n in names}:
                names.append(v)
        if len(names) <= steps:
            raise BuildError("there is no version to go back to")
        began, back = datetime.datetime.now(datetime.timezone.utc), names[steps]
        version = self._point(back.name, back.manifest)
        self._record(back.name, "roll_back", "published", began, version.manifest, None)
        return version

    def _record(self, version: str, operation: str, status: str, began: datetime.datetime, manifest: dict, error: str | None) -> None:
        row = (uuid.uuid4().hex, operation, status, version, began, datetime.datetime.now(datetime.timezone.utc), json.dumps(manifest, sort_keys=True), error)
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def runs(self) -> DataFrame:
        """The ledger: one record for each build and roll-back."""
        files = self._files()
        return self.spark.read.schema(RUN).parquet(f"{self.folder}/runs") if files.exists(self._path("runs")) else self.spark.createDataFrame([], RUN)


def inputs(rows: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that ``rows`` are read from."""
    spark, seen = rows.sparkSession, []
    for name in sorted(rows.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append((name, int(status.getLen()), int(status.getModificationTime())))
    return uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(seen)).hex


# Keyword index


#: Stands for the tables of a keyword index and their columns.
LAYOUT = 2


def keyword_tables(chunks: DataFrame) -> dict:
    """words (chunk_id, text_sha256, length, terms, tfs), postings (term, chunk_id, tf, length), terms (term, held, words), metadata (chunk_id, text_sha256, length) and statistics (n, average) of ``chunks`` (chunk_id, text).

    Texts are split and counted once, each in its row; the other tables come from what was stored of that.
    Postings are sorted by range of term and chunk, so a common term takes many files and a
    reader of some terms skips the row groups of others.
    """
    words = keyword.counted(chunks.select("chunk_id", "text")).select("chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "length", "terms", "tfs")
    postings = lambda stored: _postings(stored["words"]).repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
    held = lambda stored: stored["postings"].groupBy("term").agg(F.count("*").alias("held"), F.sum("tf").alias("words"))
    metadata = lambda stored: stored["words"].select("chunk_id", "text_sha256", "length")
    average = lambda stored: stored["metadata"].where("length >= 0").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    return {"words": words, "postings": postings, "terms": held, "metadata": metadata, "statistics": average}


def _postings(words: DataFrame) -> DataFrame:
    each = words.select("chunk_id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("w"))
    return each.select("w.terms", "chunk_id", "w.tfs", "length").toDF("term", "chunk_id", "tf", "length")


def check_keyword(stored: dict[str, DataFrame], chunks: int | None = None) -> dict:
    """Counts of a stored keyword index; raises BuildError unless chunks, words, lengths and postings agree between its tables."""
    counted = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, b: a + b)
    held = stored["metadata"].agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("different"), F.sum("length").alias("words"), F.count("length").alias("counted")).first()
    n, average = stored["statistics"].first()
    lost = stored["words"].where(counted != F.coalesce("length", F.lit(0))).count()
    # the same rows in another order: sums of their hashes agree
    sums = [F.count("*").alias("postings"), F.sum("tf").alias("words"), F.count_if(F.col("tf") < 1).alias("bad"), F.sum(F.xxhash64("term", "chunk_id", "tf", "length").cast("decimal(20,0)")).alias("rows")]
    found, wanted = (rows.agg(*sums).first() for rows in (stored["postings"], _postings(stored["words"])))
    wrong = [
        ("chunks", chunks is not None and held["n"] != chunks),
        ("repeated chunks", held["different"] != held["n"]),
        ("statistics", n != held["counted"] or abs((average or 0.0) * n - (held["words"] or 0)) > 1e-6 * max(1, held["words"] or 0)),
        ("words", (found["words"] or 0) != (held["words"] or 0) or found["bad"] > 0 or lost > 0),
        ("postings", found != wanted),
    ]
    if bad := [name for name, is_bad in wrong if is_bad]:
        raise BuildError("the stored keyword index is wrong in: " + ", ".join(bad))
    return {"chunks": held["n"], "postings": found["postings"], "words": found["words"] or 0}


def build_keyword(store: Store, chunks: DataFrame, manifest: dict | None = None) -> Version:
    """Store and publish the keyword index of ``chunks`` (chunk_id, text)."""
    return store.build("keyword_index", keyword_tables(chunks), lambda stored: check_keyword(stored, chunks.count()), manifest)


def stored_keyword(store: Store, version: Version | None = None) -> keyword.Index:
    """A published keyword index, as ``keyword.scores`` takes it."""
    return keyword.Index(store.table("postings", version), store.table("statistics", version), store.table("terms", version).select("term", "held"), store.table("words", version))


# Vector index


def build_vectors(store: Store, points: DataFrame, chunks: DataFrame | None = None, manifest: dict | None = None) -> Version:
    """Store and publish ``points`` (id, vector and any payload); with ``chunks`` (chunk_id) there has to be one point for each.

    All vectors have to be of one length, not null and of finite entries.
    """

    def check(stored: dict[str, DataFrame]) -> dict:
        fine = F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        rows = stored["points"].agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count_if(~fine).alias("bad")).first()
        wrong = [("repeated ids", rows["different"] != rows["n"]), ("sizes", rows["low"] != rows["high"]), ("entries", rows["bad"] > 0)]
        if chunks is not None:
            same = chunks.select(F.col("chunk_id").alias("id")).join(stored["points"].select("id"), "id", "full_outer").count()
            wrong.append(("chunks", same != rows["n"] or chunks.count() != rows["n"]))
        if bad := [name for name, is_bad in wrong if is_bad]:
            raise BuildError("the stored vectors are wrong in: " + ", ".join(bad))
        return {"points": rows["n"], "dimension": rows["high"]}

    return store.build("vector_index", {"points": points}, check, manifest)


def embedding_text(title: Column, section_path: Column, text: Column) -> Column:
    """What is embedded of a chunk: its title, its section path and its text in lines, without white space around them."""
    parts = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(F.array_join(section_path, " > "), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.regexp_replace(parts, r"^\s+|\s+$", "")
