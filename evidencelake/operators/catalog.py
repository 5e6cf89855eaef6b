"""Catalogs, source records with their children, verification and merge summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Review statuses of a timeline, years and rows of a page.
STATUSES = ("unreviewed", "needs_review", "confirmed")
YEARS, ROWS = (1, 9999), (1, 200)


def check_filters(start_year: int | None, end_year: int | None, event_types: list[str], statuses: list[str], limit: int, offset: int) -> None:
    """Raise a ValueError that names what a timeline cannot be asked for."""
    wrong = {
        "start_year": start_year is not None and not YEARS[0] <= start_year <= YEARS[1],
        "end_year": end_year is not None and not YEARS[0] <= end_year <= YEARS[1],
        "start_year after end_year": None not in (start_year, end_year) and start_year > end_year,
        "limit": not ROWS[0] <= limit <= ROWS[1],
        "offset": offset < 0,
        "event_types": not all(map(str.strip, event_types)),
        "statuses": not set(statuses) <= set(STATUSES),
    }
    if any(wrong.values()):
        raise ValueError("timeline filters out of range: " + ", ".join(n for n, bad in wrong.items() if bad))


def verification_level(status: Column) -> Column:
    return F.when(status == "confirmed", "confirmed").when(status == "needs_review", "pending_review").otherwise("automatic")


def active_person(asked: DataFrame, persons: DataFrame) -> DataFrame:
    """person_id, state (active, merged or unknown) and use_person_id of the persons asked for; persons has status and merged_into."""
    met = asked.join(persons.select("person_id", "status", "merged_into"), "person_id", "left")
    state = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "active", "active").otherwise("merged")
    return met.select("person_id", state.alias("state"), F.when(state == "merged", F.coalesce("merged_into", F.lit("unknown"))).when(state == "active", F.col("person_id")).alias("use_person_id"))


def sync_catalog(current: DataFrame, catalog: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``current`` (key, fields, is_active) after a full catalog (key, fields): new values win, what the catalog lacks stays, but inactive."""
    both = current.select(*key, F.struct(*fields).alias("old")).join(catalog.select(*key, F.struct(*fields).alias("new")), key, "full_outer")
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deactivated").when(F.col("old").eqNullSafe(F.col("new")), "kept").otherwise("updated")
    return both.select(*key, *(F.when(F.col("new").isNotNull(), F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")).alias(f) for f in fields), F.col("new").isNotNull().alias("is_active"), action.alias("action"))


def merge_proposals(proposals: DataFrame, persons: DataFrame) -> DataFrame:
    """``proposals`` (source_id, target_id) with accepted: both are active persons, and not one and the same."""
    active = persons.where("status = 'active'").select("person_id")
    known = lambda c: active.select(F.col("person_id").alias(c), F.lit(True).alias(f"{c}_known"))
    met = proposals.join(known("source_id"), "source_id", "left").join(known("target_id"), "target_id", "left")
    return met.select("source_id", "target_id", (F.col("source_id_known").isNotNull() & F.col("target_id_known").isNotNull() & (F.col("source_id") != F.col("target_id"))).alias("accepted"))


def source_load(events: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """``events`` that are not rejected and have a start, with the ids of their evidence and of its documents; those without both are left out."""
    known = evidence.join(documents.select("document_id"), "document_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.array_sort(F.collect_set("document_id")).alias("document_ids"))
    return events.where((F.col("review_status") != "rejected") & F.col("start_value").isNotNull()).join(known, "event_id")


def with_children(records: DataFrame, participants: DataFrame, persons: DataFrame, evidence: DataFrame, subject: str | None = None) -> DataFrame:
    """``records`` (record_id) with arrays of participants and evidence; records without them have empty ones.

    Participants (record_id, person_id, mention_text) meet persons (person_id, name) and come by person and mention;
    evidence (record_id, source_event_id, evidence_id, document_id, page, subject_id) comes by document, page and id,
    that of events whose subject is ``subject`` first.
    """
    people = participants.join(persons.select("person_id", "name"), "person_id").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("person_id", "mention_text", "name"))).alias("participants"))
    other = ~F.col("subject_id").eqNullSafe(F.lit(subject)) if subject is not None else F.lit(False)
    found = evidence.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(other.alias("other"), "document_id", "page", "evidence_id", "source_event_id"))).alias("evidence"))
    none = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    return records.join(people, "record_id", "left").join(found, "record_id", "left").select(*records.columns, none(people, "participants"), none(found, "evidence"))


def merge_summary(groups: DataFrame, source_events: int, compared: int) -> DataFrame:
    """One row on ``groups`` (pairs, kind): groups, pairs, those of high confidence and the uncertain ones."""
    high = F.count_if(F.col("kind") == "high_confidence")
    return groups.agg(F.lit(source_events).cast("long").alias("source_events"), F.lit(compared).cast("long").alias("compared_pairs"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("candidate_pairs"), F.count("*").alias("candidate_groups"), high.alias("high_confidence_groups"), (F.count("*") - high).alias("uncertain_groups"))


def merge_samples(groups: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` groups (component, confidence) of the highest confidence, ties by id."""
    return groups.orderBy(F.desc("confidence"), "component").limit(n)


def latest_runs(ledger: DataFrame) -> DataFrame:
    """The state of each run of an append-only ledger (run_id, operation, status, at): its last row, and the seconds since its first."""
    last = F.max_by(F.struct("status", "at"), F.struct("at", F.when(F.col("status") == "running", 0).otherwise(1)))
    return ledger.groupBy("run_id", "operation").agg(last.alias("last"), (F.max("at") - F.min("at")).alias("seconds")).select("run_id", "operation", "last.status", "seconds")


def manifest_warnings(has_report: Column, has_manifest: Column, recorded: Column, actual: Column) -> Column:
    """What an index manifest says of the chunks that it was built from; empty if they are those of the last chunk build."""
    return F.when(~has_report, "chunk build manifest is missing").when(~has_manifest, "legacy chunk report has no manifest").when(~recorded.eqNullSafe(actual), "chunk artifact changed after the latest chunk build").otherwise("")


def hit_pages(hits: DataFrame) -> DataFrame:
    """``hits`` (document_id, start, end) with a row for each page of their inclusive range."""
    return hits.where("end >= start").withColumn("page", F.explode(F.sequence("start", "end"))).drop("start", "end")


def known_relevance(required: DataFrame, relevant: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and relevance: 2 of required evidence, else the largest given."""
    return required.select(*key, F.lit(2).alias("relevance")).unionByName(relevant.select(*key, F.col("relevance").cast("int"))).groupBy(*key).agg(F.max("relevance").alias("relevance"))


def first_structure(documents: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """document_id, level, title, start, end and source of the first of ``sources`` that has entries of a document, else one entry for it all.

    documents has document_id, title and page_count; each source has document_id, level, title, start, end and source.
    """
    root = documents.select("document_id", F.lit(1).alias("level"), "title", F.lit(1).alias("start"), F.col("page_count").cast("int").alias("end"), F.lit("document_root").alias("source"))
    every = root.withColumn("place", F.lit(len(sources)))
    for i, s in enumerate(sources):
        every = every.unionByName(s.select(*root.columns).withColumn("place", F.lit(i)))
    return every.join(every.groupBy("document_id").agg(F.min("place").alias("place")), ["document_id", "place"]).drop("place")


def search_text(text: Column, title: Column, sections: Column, people: Column, years: Column) -> Column:
    """What a chunk is found by: its text, title, section path, people and years, each once in its place."""
    return F.concat_ws(" ", text, title, F.array_join(sections, " "), F.array_join(people, " "), F.array_join(F.transform(years, lambda y: F.concat(y.cast("string"), F.lit("年"))), " "))
