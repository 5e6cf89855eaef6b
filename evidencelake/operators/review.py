"""Review of generated records: transitions with their audit, and the checks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state that each decision leads to.
DECISIONS = {"confirmed": "confirmed", "rejected": "rejected", "reopened": "needs_review"}


def decide(current: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """key, before, after and error of each of ``decisions`` (key, decision) on ``current`` (key, review_status).

    Of several decisions on a record the last (by decided_at) counts.  The error is
    unknown_record, unknown_decision or unchanged; ``after`` then stays as it was.
    """
    last = decisions.groupBy(key).agg(F.max_by("decision", "decided_at").alias("decision"))
    both = last.join(current.select(key, F.col("review_status").alias("before"), F.lit(True).alias("known")), key, "left")
    states = F.create_map(*(F.lit(x) for pair in DECISIONS.items() for x in pair))
    wanted = states[F.col("decision")]
    error = F.when(F.col("known").isNull(), "unknown_record").when(wanted.isNull(), "unknown_decision").when(wanted == F.col("before"), "unchanged")
    return both.select(key, "decision", "before", F.when(error.isNull(), wanted).otherwise(F.col("before")).alias("after"), error.alias("error"))


def applied(current: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """``current`` with the state that error-free decisions lead to."""
    good = decided.where("error IS NULL").select(key, F.col("after").alias("__after"))
    return current.join(good, key, "left").withColumn("review_status", F.coalesce("__after", "review_status")).drop("__after")


def changed_evidence(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of stored evidence that ``new`` would change, which is never allowed."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return stored.select(key, digest.alias("a")).join(new.select(key, digest.alias("b")), key).where("a <> b").select(key).distinct()


def relation_violations(relations: DataFrame, kinds: DataFrame) -> DataFrame:
    """relationship_id and rule of relations that break the policy of their type.

    relations has relationship_id, relation_type, event_id, review_status,
    extraction_method, object_person_id and organization_name; kinds is the
    vocabulary.
    """
    both = relations.join(kinds, "relation_type", "left")
    rules: list[tuple[str, Column]] = [
        ("unknown_type", F.col("extraction_policy").isNull()),
        ("manual_only", (F.col("extraction_policy") == "manual_only") & (F.col("extraction_method") != "manual")),
        ("requires_event", F.col("requires_event") & F.col("event_id").isNull()),
        ("requires_review", F.col("requires_human_review") & (F.col("review_status") == "unreviewed")),
        ("no_object", F.col("object_person_id").isNull() & F.col("organization_name").isNull()),
    ]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules)))
    return both.select("relationship_id", F.explode(broken).alias("rule"))
