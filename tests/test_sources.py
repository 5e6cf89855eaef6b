"""Files in and out, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from evidencelake.sources import files, schemas
from evidencelake.streaming import ingest


def test_catalogs(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"documents": [{"document_id": "a_b", "filename": "a.pdf", "creators": ["x", "y"], "ocr_pages": [3], "expected_page_count": 2}, {"document_id": "B", "filename": "b.txt"}]}))
    catalog = files.document_catalog(spark, f"file://{path}")
    assert sorted(catalog.columns) == sorted(f.split()[0] for f in schemas.DOCUMENT.split(", "))
    got = sorted((r["document_id"], r["rule"]) for r in schemas.catalog_violations(catalog).collect())
    assert got == [("B", "document_id"), ("B", "filename"), ("a_b", "ocr_pages")]
    held = spark.createDataFrame([("a_b", "h", 5, True, True)], "document_id string, sha256 string, size_bytes long, is_current boolean, is_present boolean")
    rows = {r["document_id"]: r for r in files.manifest(catalog, held).collect()}
    assert rows["a_b"]["creators"] == "x; y" and rows["a_b"]["sha256"] == "h" and rows["B"]["sha256"] is None


def test_people_of_both_forms(spark, tmp_path):
    new, old = tmp_path / "new.json", tmp_path / "old.json"
    new.write_text(json.dumps({"people": [{"person_id": "p", "canonical_name": "N", "aliases": [{"name": "A"}]}]}))
    old.write_text(json.dumps({"乙": ["B"], "甲": ["A", "C"]}))
    assert sorted(r["form"] for r in files.name_forms(files.person_catalog(spark, f"file://{new}")).collect()) == ["A", "N"]
    got = {r["person_id"]: r["canonical_name"] for r in files.person_catalog(spark, f"file://{old}").collect()}
    assert got == {"legacy_person_1": "乙", "legacy_person_2": "甲"}


def test_the_last_page_record_wins(spark, tmp_path):
    path = tmp_path / "pages.jsonl"
    path.write_text('{"document_id":"d","pdf_page":1,"status":"failed","processed_at":"2024-01-01"}\n\n{"document_id":"d","pdf_page":1,"status":"extracted","processed_at":"2024-01-02"}\n')
    assert [r["status"] for r in files.page_records(spark, f"file://{path}").collect()] == ["extracted"]


def test_directories_and_fingerprints(spark, tmp_path):
    (tmp_path / "A.PDF").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    rows = files.scan_directory(spark, f"file://{tmp_path}").collect()
    assert [(r["filename"], r["size_bytes"]) for r in rows] == [("A.PDF", 3)]
    one = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    marks = [files.fingerprint(x, ["i", "t"]).first()["fingerprint"] for x in (one, one.orderBy(F.desc("i")), one.where("i = 1"))]
    assert marks[0] == marks[1] != marks[2]


def test_pages_stream_in_once(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, "text", 0), ("d", 2, "", 1)], "document_id string, pdf_page int, text string, images int")
    rows.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        ingest.into(ingest.pages(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/state", ingest.append_once(f"file://{tmp_path}/out")).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("pdf_page").collect()
    assert [r["status"] for r in got] == ["extracted", "ocr_required"]


def test_the_last_line_wins_whenever_it_was_made(spark, tmp_path):
    for name, lines in (("a", ["2024-01-03 late", "2024-01-02 last"]), ("b", ["2024-01-01 other"])):
        rows = [json.dumps({"document_id": name, "pdf_page": 1, "status": x.split()[1], "processed_at": x.split()[0]}) for x in lines]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    got = {r["document_id"]: r["status"] for r in files.page_records(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": "last", "b": "other"}


def test_bad_lines_are_told_by_number(spark, tmp_path):
    lines = [json.dumps({"i": n, "t": "x" * 50}) for n in range(400)]
    lines[3], lines[250], lines[399] = "{broken", '{"i": "text"}', "[1]"
    (tmp_path / "a.jsonl").write_text("\n".join([*lines[:10], "  ", *lines[10:]]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r["line"], r["text"]) for r in files.bad_lines(spark, f"file://{tmp_path}", "i int, t string").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(4, "{broken"), (252, '{"i": "text"}'), (401, "[1]")]


def test_json_lines_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    for n in (1, 2):
        files.write_json_lines(spark.range(n), path)
        assert spark.read.json(path).count() == n
    with pytest.raises(Exception):
        files.write_json_lines(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert spark.read.json(path).count() == 2
    files.write_json_lines(spark.read.json(path), path)  # even from itself
    assert spark.read.json(path).count() == 2


def test_folders_without_chunks(spark, tmp_path):
    for name in ("none", "empty"):
        (tmp_path / name).mkdir()
    (tmp_path / "empty/_SUCCESS").write_text("x")
    for name in ("none", "empty", "absent"):
        with pytest.raises(FileNotFoundError):
            files.chunk_records(spark, f"file://{tmp_path}/{name}")
