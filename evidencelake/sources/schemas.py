"""Schemas of the engine's records, and checks that return the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "document_id string, file_sha256 string, pdf_page int, printed_page string, status string, extraction_method string, extractor_version string, raw_text string, normalized_text string, text_sha256 string, character_count int, cjk_character_count int, replacement_character_count int, image_object_count int, quality_flags array<string>, ocr_confidence double, error string, run_id string, processed_at string"
CHUNK = "chunk_id string, document_id string, file_sha256 string, title string, filename string, creators array<string>, source_type string, edition string, volume string, verification_status string, chunk_index int, page_chunk_index int, pdf_page_start int, pdf_page_end int, printed_page_start string, printed_page_end string, section_path array<string>, text string, search_text string, character_count int, year_mentions array<int>, date_mentions array<string>, scope_status string, people array<string>, extraction_methods array<string>, content_hash string, cleaner_version string, chunker_version string, previous_chunk_id string, next_chunk_id string"
DOCUMENT = "document_id string, filename string, title string, creators array<string>, source_type string, edition string, volume string, source_series array<string>, verification_status string, enabled boolean, ocr_strategy string, expected_page_count int, ocr_pages array<int>, notes string"
PERSON = "person_id string, canonical_name string, description string, aliases array<struct<name: string, alias_type: string, notes: string>>"
RELATION_TYPE = "relation_type string, label string, object_kind string, extraction_policy string, requires_human_review boolean, requires_event boolean, description string"
QUESTION = "question_id string, question string, answerable boolean, expected_document_ids array<string>, expected_years array<int>, expected_evidence array<struct<document_id: string, pdf_pages: array<int>>>, required_fact_terms array<array<string>>, forbidden_answer_terms array<string>, semantic_criteria array<string>, tags array<string>"
#: Fixed value: the form of ids.
ID = r"^[a-z][a-z0-9_]{1,63}$"


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule of every row for which a rule is false; a null counts as kept."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def catalog_violations(documents: DataFrame) -> DataFrame:
    """Broken rules of a document catalog: ids, file names, pages of OCR."""
    rules = {
        "document_id": F.col("document_id").rlike(ID),
        "filename": F.lower("filename").endswith(".pdf") & ~F.col("filename").rlike(r"[/\\\\]"),
        "ocr_pages": F.forall("ocr_pages", lambda p: (p >= 1) & (p <= F.coalesce("expected_page_count", p))),
    }
    return violations(documents, "document_id", rules)


def event_violations(events: DataFrame) -> DataFrame:
    """Broken rules of events: confidence, and a value for each precision but unknown."""
    rules = {"confidence": F.col("extraction_confidence").between(0.0, 1.0), "start": (F.col("start.precision") == "unknown") == F.col("start.value").isNull()}
    return violations(events, "event_id", rules)
