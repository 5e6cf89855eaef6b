"""Files in and out: catalogs, JSON lines, manifests, artifacts and directories of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.operators.pages import last_record
from evidencelake.sources import schemas


def _exploded(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of one array of a JSON document."""
    held = spark.read.schema(f"`{field}` array<struct<{schema_of(schema)}>>").option("mode", "FAILFAST").json(path, multiLine=True)
    return held.select(F.inline(field))


def schema_of(ddl: str) -> str:
    """Top-level ``name type`` pairs as the ``name: type`` of a struct."""
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += c
    return ", ".join(out)


def document_catalog(spark: SparkSession, path: str) -> DataFrame:
    return _exploded(spark, path, "documents", schemas.DOCUMENT)


def relation_types(spark: SparkSession, path: str) -> DataFrame:
    return _exploded(spark, path, "relation_types", schemas.RELATION_TYPE)


def person_catalog(spark: SparkSession, path: str) -> DataFrame:
    """People of a catalog; a plain map of names to aliases becomes people ``legacy_person_1`` and so on, by name."""
    text = spark.read.text(path, wholetext=True)
    people = F.from_json("value", f"people array<struct<{schema_of(schemas.PERSON)}>>")["people"]
    kept = text.select(people.alias("people"), F.from_json("value", "map<string, array<string>>").alias("names"))
    listed = kept.where("people IS NOT NULL").select(F.inline("people"))
    old = kept.where("people IS NULL").select(F.posexplode(F.array_sort(F.map_entries("names"))).alias("i", "e"))
    alias = F.transform("e.value", lambda n: F.struct(n.alias("name"), F.lit("alias").alias("alias_type"), F.lit(None).cast("string").alias("notes")))
    legacy = old.select(F.concat(F.lit("legacy_person_"), (F.col("i") + 1).cast("string")).alias("person_id"), F.col("e.key").alias("canonical_name"), F.lit(None).cast("string").alias("description"), alias.alias("aliases"))
    return listed.unionByName(legacy)


def name_forms(people: DataFrame) -> DataFrame:
    """person_id, name (canonical) and form of every canonical name and alias."""
    forms = F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce(F.transform("aliases", lambda a: a["name"]), F.array().cast("array<string>"))))
    return people.select("person_id", F.col("canonical_name").alias("name"), F.explode(forms).alias("form"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON-lines files; blank lines are skipped, and a line that is no record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and at, its place in the file: the start of its split, then its number in the split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("at", F.struct("block", F.monotonically_increasing_id().alias("n"))).drop("block")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (from 1) and text of the lines of JSON-lines files that are neither blank nor records of ``schema``.

    A line's number is its number in its split plus the lines of the splits before it.
    """
    rows = _lines(spark, path)
    first = rows.groupBy("file", F.col("at.block").alias("block")).agg(F.count("*").alias("size"), F.min("at.n").alias("low"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = first.select("file", "block", "low", F.coalesce(before, F.lit(0)).alias("before"))
    read = F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    wrong = rows.where(F.trim("value") != "").withColumn("r", read).where(F.col("r").isNull() | F.col("r.__bad").isNotNull())
    placed = wrong.withColumn("block", F.col("at.block")).join(starts, ["file", "block"])
    return placed.select("file", (F.col("at.n") - F.col("low") + F.col("before") + 1).alias("line"), F.col("value").alias("text"))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Page records; of several of one page the one on the last line, the files being in order of their names."""
    rows = _lines(spark, path).where(F.trim("value") != "")
    record = F.from_json("value", schemas.PAGE, {"mode": "FAILFAST"})
    last = rows.select(record.alias("r"), F.struct("file", "at").alias("place")).select("r.*", "place")
    return last_record(last, ["document_id", "pdf_page"], F.col("place")).drop("place")


def chunk_records(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of all JSON-lines files of a folder; FileNotFoundError if it has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(at) if not files.exists(at) else files.listStatus(at)
    if not found or not any(f.getLen() for f in found if not f.getPath().getName().startswith(("_", "."))):
        raise FileNotFoundError(f"no chunk records in {path}")
    return json_lines(spark, path, schemas.CHUNK)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines under ``path``: written beside it, and put in its place by renaming when they are whole.

    What was there is kept under another name until then, and comes back if the renaming fails.
    """
    spark = rows.sparkSession
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    rows.write.json(new)
    place, beside, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(place)
    if had and not files.rename(place, aside):
        files.delete(beside, True)
        raise OSError(f"{path} can't be renamed")
    if not files.rename(beside, place):
        if had:
            files.rename(aside, place)
        files.delete(beside, True)
        raise OSError(f"{new} can't be renamed")
    if had:
        files.delete(aside, True)


def manifest(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Every document with its current, present file if there is one; arrays joined by ``; ``, columns by name."""
    current = files.where("is_current AND is_present").select("document_id", "sha256", "size_bytes")
    both = documents.join(current, "document_id", "left")
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in both.dtypes]
    return both.select(*flat).select(*sorted(both.columns))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


def scan_directory(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """filename, size_bytes and sha256 of the files of one directory, not of those below."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a hash of all ``rows`` that their order does not change, made from sums of row hashes."""
    one = F.sha2(F.to_json(F.struct(*columns)), 256)
    parts = [F.sum(F.conv(F.substring(one, i * 8 + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("fingerprint"))


def latest_run(runs: DataFrame, operation: str) -> DataFrame:
    """The last finished run of each ``operation`` column's value."""
    last = F.row_number().over(Window.partitionBy(operation).orderBy(F.desc("finished_at"), F.desc("run_id")))
    return runs.withColumn("__n", last).where("__n = 1").drop("__n")
