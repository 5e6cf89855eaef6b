"""Page records, page quality and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators.lineage import cut
from evidencelake.operators.ranges import numbered

#: What an OCR pass flags, and texts of how many characters and Chinese characters count as little.
FROM_TEXT, FROM_IMAGE, LITTLE, FEW, FEW_CJK = "ocr_from_existing_text_layer", "ocr_from_image_only_page", "ocr_low_substantive_text", 20, 5


def page_records(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (document_id, pdf_page, text, images): stored text, status, flags, counts and hash."""
    stored = pages.withColumn("normalized_text", T.for_storage(F.coalesce("text", F.lit(""))))
    body = T.compact("normalized_text")
    return stored.select(
        "document_id",
        "pdf_page",
        "normalized_text",
        T.page_status("normalized_text", "images").alias("status"),
        T.page_flags("normalized_text", "images").alias("quality_flags"),
        F.when(F.length(body) > 0, "text_layer").otherwise("none").alias("extraction_method"),
        F.length(body).cast("long").alias("character_count"),
        F.regexp_count(body, F.lit(T.CJK)).cast("long").alias("cjk_character_count"),
        F.regexp_count(body, F.lit("�")).cast("long").alias("replacement_character_count"),
        F.sha2("normalized_text", 256).alias("text_sha256"),
    )


def with_ocr_policy(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """``records`` with the catalog's OCR policy (document_id, ocr_strategy, ocr_pages) applied afresh.

    Flags of an earlier policy go and the class is made again; then a document under
    ``full``, or a listed page under ``pages``, requires OCR.  Listed pages meet records as rows, so
    a record never carries or searches its document's list.
    """
    policy = ["ocr_policy_full", "ocr_policy_page"]
    # the outer form: a plain one filters by the list's size, which would be worked out for every row that the catalog is made from
    pages = catalog.where("ocr_strategy = 'pages'").select("document_id", F.explode_outer("ocr_pages").alias("pdf_page")).where("pdf_page IS NOT NULL").distinct().withColumn("__listed", F.lit(True))
    joined = records.join(catalog.select("document_id", "ocr_strategy"), "document_id", "left").join(pages, ["document_id", "pdf_page"], "left")
    full = F.coalesce(F.col("ocr_strategy") == "full", F.lit(False))
    listed = F.coalesce((F.col("ocr_strategy") == "pages") & F.col("__listed"), F.lit(False))
    base = F.array_except("quality_flags", F.array(*map(F.lit, policy)))
    again = F.when(F.col("character_count") == 0, F.when(F.array_contains(base, "image_only_page"), "ocr_required").otherwise("empty")).when(F.array_contains(base, "high_replacement_ratio"), "ocr_required").otherwise("extracted")
    flag = F.when(full, F.lit(policy[0])).when(listed, F.lit(policy[1]))
    return joined.withColumn("quality_flags", F.array_compact(F.concat(base, F.array(flag)))).withColumn("status", F.when(full | listed, "ocr_required").otherwise(again)).drop("ocr_strategy", "__listed")


def effective_pages(base: DataFrame, ocr: DataFrame) -> DataFrame:
    """One text per page: extracted base text, else OCR text where OCR was required; pages with neither go."""
    o = ocr.select("document_id", "pdf_page", F.col("status").alias("o_status"), F.col("normalized_text").alias("o_text"))
    both = base.join(o, ["document_id", "pdf_page"], "left")
    good = (F.col("status") == "extracted") & (F.length(T.compact("normalized_text")) > 0)
    read = (F.col("status") == "ocr_required") & (F.col("o_status") == "extracted") & (F.length(T.compact("o_text")) > 0)
    return both.select("document_id", "pdf_page", F.when(good, F.col("normalized_text")).when(read, F.col("o_text")).alias("text"), F.when(good, "text_layer").when(read, "ocr").alias("method")).where("text IS NOT NULL")


def quality_report(records: DataFrame) -> DataFrame:
    """Per document: pages of each status, and least, median, most and total characters of extracted pages."""
    chars = F.when(F.col("status") == "extracted", F.col("character_count"))
    of = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_pages")
    return records.groupBy("document_id").agg(F.count("*").alias("pages"), of("extracted"), of("empty"), of("ocr_required"), F.min(chars).alias("min_chars"), F.percentile(chars, F.lit(0.5)).alias("median_chars"), F.max(chars).alias("max_chars"), F.coalesce(F.sum(chars), F.lit(0)).alias("total_chars"))


def flag_counts(records: DataFrame) -> DataFrame:
    """Pages of each flag, per document."""
    return records.select("document_id", F.explode("quality_flags").alias("flag")).groupBy("document_id", "flag").agg(F.count("*").alias("pages"))


def corpus_totals(records: DataFrame) -> DataFrame:
    """One row for the whole corpus."""
    return records.agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("pages"), F.count_if(F.col("status") == "extracted").alias("extracted_pages"), F.coalesce(F.sum("character_count"), F.lit(0)).alias("characters"))


def page_ranges(pages: DataFrame, group: str, page: str) -> DataFrame:
    """Distinct pages of each group as ranges, ``1–3, 7``."""
    rows = pages.select(group, page).where(F.col(page).isNotNull()).distinct()
    island = F.col(page) - F.row_number().over(Window.partitionBy(group).orderBy(page))
    ends = rows.withColumn("island", island).groupBy(group, "island").agg(F.min(page).alias("low"), F.max(page).alias("high"))
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat(F.col("low").cast("string"), F.lit("–"), F.col("high").cast("string")))
    return ends.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", text.alias("t")))), lambda r: r.t), ", ").alias("ranges"))


def incremental_pages(wanted: DataFrame, done: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``done`` that stay, rows of ``wanted`` still to be made).

    A row stays if its file hash is current, it is of this extractor version, and it has not failed.
    """
    key = ["document_id", "pdf_page", "file_sha256"]
    valid = done.where((F.col("extractor_version") == version) & (F.col("status") != "failed"))
    return valid.join(wanted.select(*key).distinct(), key, "left_semi"), wanted.join(valid.select(*key).distinct(), key, "left_anti")


def last_record(lines: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key in the order of its lines."""
    rows = lines.groupBy(*key).agg(F.max_by(F.struct(*lines.columns), order).alias("r"))
    return rows.select("r.*")


def ocr_text(results: Column) -> Column:
    """Struct of text and confidence of OCR results (array of texts and scores): lines that are not blank, and the mean of their scores to six places."""
    lines = F.flatten(F.transform(results, lambda r: F.arrays_zip(r["texts"].alias("text"), r["scores"].alias("score"))))
    good = F.filter(F.transform(lines, lambda x: F.struct(F.trim(x["text"]).alias("text"), x["score"].alias("score"))), lambda x: F.length(x["text"]) > 0)
    scores = F.filter(F.transform(good, lambda x: x["score"]), lambda v: v.isNotNull())
    mean = F.aggregate(scores, F.lit(0.0), lambda total, v: total + v) / F.size(scores)
    return F.struct(F.array_join(F.transform(good, lambda x: x["text"]), "\n").alias("text"), F.when(F.size(scores) > 0, F.round(mean, 6)).alias("confidence"))


def ocr_pass(records: DataFrame, done: DataFrame, engine: Callable[[DataFrame], DataFrame], version: str, most: int | None = None, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records after the pass, summary of each document) of a pass that goes on where ``done`` ends.

    records has document_id, place (the order of documents), pdf_page, file_sha256, status, normalized_text,
    images and quality_flags of all pages; those that require OCR, and are among ``selected`` (document_id, pdf_page) if that
    is given, are candidates.  What ``done`` has of a candidate, from the same file by the same ``version`` and
    not failed, is used again.  Of the rest the first ``most`` by place and page, over all
    documents, go to ``engine``, which adds text, confidence and error; they are found by ranges
    of counts and not by a sort in one task.  A page with an error is a failed record.

    The records have document_id, pdf_page, file_sha256, status, normalized_text, character_count,
    ocr_confidence, quality_flags, extractor_version and error; the summary has candidate, processed, reused,
    remaining and failed pages, characters and the mean confidence to six places.
    """
    kept = ["document_id", "pdf_page", "file_sha256", "status", "normalized_text", "character_count", "ocr_confidence", "quality_flags", "extractor_version", "error"]
    wanted = records.where("status = 'ocr_required'")
    if selected is not None:
        wanted = wanted.join(selected.select("document_id", "pdf_page").distinct(), ["document_id", "pdf_page"], "left_semi")
    reused, pending = incremental_pages(wanted, done, version)
    if most is not None:
        first = numbered(pending.select("place", "document_id", "pdf_page"), "place", "document_id", "pdf_page", name="__n").where(F.col("__n") <= most)
        pending = pending.join(first.select("document_id", "pdf_page"), ["document_id", "pdf_page"], "left_semi")
    source = F.coalesce("normalized_text", F.lit(""))
    had = F.when(F.length(T.compact(source)) > 0, FROM_TEXT).otherwise(FROM_IMAGE)
    read = engine(pending.select("document_id", "pdf_page", "file_sha256", "images", F.col("quality_flags").alias("__flags"), had.alias("__had")))
    stored = read.withColumn("normalized_text", T.for_storage(F.coalesce("text", F.lit(""))))
    body = T.compact("normalized_text")
    cjk = F.regexp_count(body, F.lit(T.CJK))
    little = F.when((F.length(body) < FEW) | (cjk < FEW_CJK), LITTLE)
    failed = F.col("error").isNotNull()
    flags = F.array_distinct(F.array_compact(F.concat(T.page_flags("normalized_text", F.lit(0)), F.coalesce("__flags", F.array().cast("array<string>")), F.array(F.col("__had"), little))))
    made = stored.select(
        "document_id",
        "pdf_page",
        "file_sha256",
        F.when(failed, "failed").otherwise(T.page_status("normalized_text", F.lit(0))).alias("status"),
        F.when(failed, "").otherwise(F.col("normalized_text")).alias("normalized_text"),
        F.when(failed, 0).otherwise(F.length(body)).cast("long").alias("character_count"),
        F.when(~failed, F.col("confidence")).alias("ocr_confidence"),
        F.when(failed, F.array(F.lit("extraction_failed"))).otherwise(flags).alias("quality_flags"),
        F.lit(version).alias("extractor_version"),
        "error",
    )
    now = cut(made.withColumn("processed", F.lit(True)).unionByName(reused.select(*kept).withColumn("processed", F.lit(False))))
    counts = now.groupBy("document_id").agg(F.count_if("processed").alias("processed"), F.count_if(~F.col("processed")).alias("reused"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("character_count").alias("characters"), F.round(F.avg("ocr_confidence"), 6).alias("confidence"))
    candidates = wanted.groupBy("document_id").agg(F.count("*").alias("candidates"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    summary = candidates.join(counts, "document_id", "left").select("document_id", "candidates", *(zero(c) for c in ("processed", "reused", "failed", "characters")), "confidence")
    return now.drop("processed"), summary.withColumn("remaining", F.col("candidates") - F.col("processed") - F.col("reused"))
