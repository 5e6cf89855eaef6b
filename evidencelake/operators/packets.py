"""Packets for blind review: cases of both outcomes that do not tell which, with checksums of what must stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons that say nothing.
CASE = "intersection-blind-case-v1"
PLACEHOLDERS = ("connected", "connectred", "connection", "yes", "no", "true", "false", "有关联", "有联系", "是", "否")


def hashed(seed: str, *parts: Column | str) -> Column:
    """A rank that a seed decides: the SHA-256 of the seed and the parts, joined by bars."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)), 256)


def checksum(fields: list[str]) -> Column:
    """A digest of ``fields`` by name, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def review_packet(anchors: DataFrame, proofs: DataFrame, known: DataFrame, seed: str, pairs: int, each: int) -> DataFrame:
    """Cases of the ``pairs`` pairs of people with most candidates, ``each`` that have a proof and ``each`` that have none.

    anchors has first, second, event_id, document_id, pdf_page (where a page names both) and what else a
    case is to show, one row a pair and event; proofs has first, second, event_id, document_id,
    pdf_page and evidence_id; events of ``known`` (event_id) are left out.  Returns the
    columns of anchors with the page of the first proof where there is one, case_id, case_checksum
    and place, the order of review, which like the ids depends on the seed only.  Pairs that lack
    cases of either kind do not count; fewer pairs than asked for are all there are.
    """
    pair, fields = ["first", "second"], [c for c in anchors.columns]
    first = F.min_by(F.struct("document_id", "pdf_page"), F.struct("pdf_page", "evidence_id")).alias("proof")
    located = proofs.groupBy(*pair, "event_id").agg(first)
    joined = anchors.join(known.select("event_id").distinct(), "event_id", "left_anti").join(located, [*pair, "event_id"], "left")
    proven = F.col("proof").isNotNull()
    counts = joined.groupBy(*pair).agg(F.count("*").alias("n"), F.count_if(proven).alias("yes"), F.count_if(~proven).alias("no"))
    chosen = counts.where((F.col("yes") >= each) & (F.col("no") >= each)).orderBy(F.desc("n"), *pair).limit(pairs).select(*pair)
    rank = F.when(proven, hashed(seed, *pair, "event_id", F.lit("a"))).otherwise(hashed(seed, *pair, "event_id", F.lit("b")))
    place = F.row_number().over(Window.partitionBy(*pair, proven).orderBy(rank))
    cases = joined.join(chosen, pair, "left_semi").withColumn("__n", place).where(F.col("__n") <= each)
    at = {c: F.coalesce(F.col("proof")[c], F.col(c)) for c in ("document_id", "pdf_page")}
    case_id = F.concat(F.lit("blind-"), F.left(hashed(CASE, F.lit(seed), *pair, "event_id"), F.lit(16)))
    shown = cases.withColumns(at).withColumn("case_id", case_id).select("case_id", *fields)
    ordered = F.row_number().over(Window.orderBy(hashed(seed, "case_id", F.lit("review-order"))))  # 2 x each x pairs rows
    return shown.withColumn("case_checksum", checksum(["case_id", *fields])).withColumn("place", ordered)


def packet_errors(packet: DataFrame, fields: list[str], generic: bool = False) -> DataFrame:
    """case_id and error of each reviewed case of a ``packet`` (case_checksum, ``fields``, expected, reason, reviewed_by, reviewed_at) that can't be used.

    Content changed, label missing, reason missing, reason generic (unless ``generic`` ones are accepted), reviewer
    missing, or a date of review that is no ISO date; the first that holds.
    """
    said = lambda c: F.coalesce(F.trim(c), F.lit(""))
    bare = F.lower(F.regexp_replace(said("reason"), r"[^\p{L}\p{N}]", ""))
    dated = F.coalesce(F.try_to_date(F.left(said("reviewed_at"), F.lit(10)), "yyyy-MM-dd").isNotNull() & said("reviewed_at").rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))
    error = (
        F.when(F.col("case_checksum") != checksum(["case_id", *fields]), "content_changed")
        .when(F.col("expected").isNull(), "label_missing")
        .when(said("reason") == "", "reason_missing")
        .when(bare.isin(*PLACEHOLDERS) & F.lit(not generic), "reason_generic")
        .when((said("reviewed_by") == "") | (said("reviewed_at") == ""), "reviewer_missing")
        .when(~dated, "date_not_iso")
    )
    return packet.select("case_id", error.alias("error")).where("error IS NOT NULL")
