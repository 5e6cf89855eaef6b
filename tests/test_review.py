"""Review transitions, policies and answer metrics on small rows with known results."""

from pyspark.sql import functions as F

from evidencelake.operators import evaluation, resolve, review


def test_decisions(spark):
    current = spark.createDataFrame([("a", "unreviewed"), ("b", "confirmed"), ("c", "rejected")], "id string, review_status string")
    wanted = spark.createDataFrame([("a", "rejected", 1), ("a", "confirmed", 2), ("b", "confirmed", 1), ("c", "reopened", 1), ("x", "confirmed", 1)], "id string, decision string, decided_at int")
    decided = review.decide(current, wanted, "id")
    assert {r["id"]: (r["after"], r["error"]) for r in decided.collect()} == {"a": ("confirmed", None), "b": ("confirmed", "unchanged"), "c": ("needs_review", None), "x": (None, "unknown_record")}
    assert {r["id"]: r["review_status"] for r in review.applied(current, decided, "id").collect()} == {"a": "confirmed", "b": "confirmed", "c": "needs_review"}


def test_policies(spark):
    kinds = spark.createDataFrame([("led", "manual_only", True, False), ("met", "rule", False, True)], "relation_type string, extraction_policy string, requires_human_review boolean, requires_event boolean")
    schema = "relationship_id int, relation_type string, event_id string, review_status string, extraction_method string, object_person_id string, organization_name string"
    rows = spark.createDataFrame([(1, "led", None, "confirmed", "rule", None, "o"), (2, "met", None, "unreviewed", "rule", "p", None), (3, "met", "e", "unreviewed", "rule", None, None), (4, "?", "e", "confirmed", "manual", "p", None), (5, "met", "e", "unreviewed", "rule", "p", None)], schema)
    got = sorted((r["relationship_id"], r["rule"]) for r in review.relation_violations(rows, kinds).collect())
    assert got == [(1, "manual_only"), (2, "requires_event"), (3, "no_object"), (4, "unknown_type")]


def test_facts_are_known_or_not(spark):
    facts = spark.createDataFrame([(1, "a", ["Big Cat"], None), (1, "b", ["dog"], None), (2, "c", [], True), (2, "d", None, None)], "case_id int, fact_id string, patterns array<string>, judged boolean")
    answers = spark.createDataFrame([(1, "the big-cat."), (2, "x")], "case_id int, answer string")
    covered = evaluation.fact_coverage(facts, answers)
    assert {r["fact_id"]: r["covered"] for r in covered.collect()} == {"a": True, "b": False, "c": True, "d": None}
    r = evaluation.coverage_summary(covered).first()
    assert (r["macro"], round(r["micro"], 6), r["known"]) == (0.75, 0.666667, 3)


def test_dispositions(spark):
    rows = spark.createDataFrame([("an answer", "supported"), ("cannot say", "supported"), ("an answer", "partial"), ("", "supported"), ("x", "no_evidence")], "a string, s string")
    got = [r[0] for r in rows.select(evaluation.disposition(F.col("a"), F.col("s"), "cannot")).collect()]
    assert got == ["answered", "refused", "partial", "refused", "refused"]


def test_candidates_by_both_ways_in(spark):
    rows = [
        (1, "exact_day", 0.70, 0.1, 0.1, 0, False, True),
        (2, "exact_day", 0.65, 0.82, 0.55, 0, False, True),
        (3, "exact_day", 0.65, 0.82, 0.54, 2, True, False),
        (4, "same_month", 0.60, 0.80, 0.45, 1, True, True),
        (5, "same_value", 0.65, 0.90, 0.45, 1, False, True),
        (6, "same_month", 0.65, 0.89, 0.50, 1, False, False),
        (7, "same_month", 0.90, 0.79, 0.50, 1, True, False),
        (8, "same_month", 0.90, 0.80, 0.44, 1, True, False),
        (9, "same_month", 0.59, 0.95, 0.90, 1, True, False),
        (10, "same_value", 0.90, 0.95, 0.90, 0, True, False),
        (11, None, 0.90, 0.95, 0.90, 2, True, False),
    ]
    scored = spark.createDataFrame([r[:-1] for r in rows], "a long, relation string, score double, containment double, jaccard double, shared int, mutual boolean")
    assert sorted(r["a"] for r in resolve.candidates(scored).collect()) == [r[0] for r in rows if r[-1]]
