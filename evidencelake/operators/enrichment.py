"""Model-assisted enrichment as far as it is deterministic: candidates, budgets, validation, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T

#: Characters of evidence in a request, and the confidence that needs no second look.
EVIDENCE, SURE = 1200, 0.75
MARK = r"\[E([0-9]+)\]"


def candidates(events: DataFrame, attempts: DataFrame, limit: int) -> DataFrame:
    """Events that a model should look at, without those tried with the same request: needs review, unsure, or of no specific type."""
    wanted = events.where(F.col("review_status").isin("unreviewed", "needs_review")).where((F.col("review_status") == "needs_review") | (F.col("confidence") < SURE) | (F.col("event_type") == "activity"))
    fresh = wanted.join(attempts.select("event_id", "request_hash").distinct(), ["event_id", "request_hash"], "left_anti")
    return fresh.orderBy(F.desc(F.col("review_status") == "needs_review"), "confidence", "event_id").limit(limit)


def bounded_evidence(evidence: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """Quotes of each event in order up to ``most`` characters, the last cut to fit."""
    before = Window.partitionBy("event_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("quote")).over(before), F.lit(0))
    return evidence.withColumn("__used", used).where(F.col("__used") < most).withColumn("quote", F.substring("quote", F.lit(1), (F.lit(most) - F.col("__used")).cast("int"))).drop("__used")


def grounded(values: Column, evidence: Column) -> Column:
    """Whether every value occurs in the evidence, white space aside."""
    whole = T.compact(evidence)
    return F.forall(values, lambda v: F.contains(whole, F.regexp_replace(v, r"(?U)\s+", "")))


def merged_confidence(rule: Column, model: Column) -> Column:
    return F.least(F.round((rule + model) / 2, 4), F.lit(0.9))


def cited(answer: Column) -> Column:
    """Distinct evidence numbers that an answer marks, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(MARK), 1), lambda n: n.cast("int"))))


def citation_errors(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id and error of every paragraph without a mark and every mark without evidence.

    answers has answer_id and answer; citations has answer_id and number.  Headings and
    lines under twelve characters need no mark.
    """
    lines = answers.select("answer_id", F.posexplode(F.split("answer", "\n+")).alias("line", "text")).where(F.length(F.trim("text")) >= 12).where(~F.col("text").rlike(r"^\s*#"))
    unmarked = lines.where(~F.col("text").rlike(MARK)).select("answer_id", "line", F.lit("missing_marker").alias("error"))
    marks = lines.select("answer_id", "line", F.explode(cited(F.col("text"))).alias("number"))
    unknown = marks.join(citations.select("answer_id", "number").distinct(), ["answer_id", "number"], "left_anti").select("answer_id", "line", F.lit("unknown_marker").alias("error")).distinct()
    return unmarked.unionByName(unknown)


def used_citations(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """The citations that an answer marks."""
    marks = answers.select("answer_id", F.explode(cited(F.col("answer"))).alias("number"))
    return citations.join(marks, ["answer_id", "number"], "left_semi")


def evidence_status(hits: DataFrame) -> DataFrame:
    """query_id and status: no_evidence without a hit by words, supported if one of the first five has both ranks, else partial."""
    flags = hits.groupBy("query_id").agg(F.max(F.col("keyword_rank").isNotNull()).alias("words"), F.max((F.col("rank") <= 5) & F.col("keyword_rank").isNotNull() & F.col("vector_rank").isNotNull()).alias("both"))
    return flags.select("query_id", F.when(~F.col("words"), "no_evidence").when(F.col("both"), "supported").otherwise("partial").alias("status"))


def review_reasons(status: Column, confidence: Column, event_type: Column, model_review: Column, model_reasons: Column, error: Column) -> Column:
    """Why an event tried by a model needs a review, in order and once each; null model columns are a failed attempt."""
    rules = F.array(
        F.lit("model_assisted"),
        F.when(status == "needs_review", "source_needs_review"),
        F.when(confidence < SURE, "low_rule_confidence"),
        F.when(event_type == "activity", "generic_rule_event_type"),
        F.when(model_review, "model_requested_review"),
    )
    told = F.transform(F.coalesce(model_reasons, F.array().cast("array<string>")), lambda r: F.concat(F.lit("model_"), r))
    return F.array_distinct(F.array_compact(F.concat(rules, told, F.array(error))))


def attempt_priority(status: Column, model_review: Column) -> Column:
    """Failed attempts first, then those whose model asks for a review."""
    return F.when(~status.eqNullSafe("succeeded"), 90).when(F.coalesce(model_review, F.lit(False)), 70).otherwise(50)


def review_queue(queue: DataFrame, events: DataFrame, attempts: DataFrame, limit: int = 20) -> DataFrame:
    """The first pending rows of a queue (queue_id, event_id, source_attempt_id, priority, status, created_at) with their event and attempt."""
    if not 1 <= limit <= 200:
        raise ValueError("a review queue lists 1 to 200 rows")
    joined = queue.where("status = 'pending'").join(events, "event_id").join(attempts.withColumnRenamed("attempt_id", "source_attempt_id").withColumnRenamed("status", "attempt_status").drop("event_id"), "source_attempt_id")
    return joined.orderBy(F.desc("priority"), "created_at", "queue_id").limit(limit)
