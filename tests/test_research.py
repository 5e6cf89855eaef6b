"""Research operators on small rows with known results."""

import datetime

from pyspark.sql import functions as F

from evidencelake.operators import evaluation, fusion, resolve, sessions
from evidencelake.operators import research as R


def test_names_resolve_without_space_and_case(spark):
    names = spark.createDataFrame([("p1", "Li Wei"), ("p2", "Wang"), ("p3", "WANG")], "person_id string, form string")
    asked = spark.createDataFrame([("liwei",), ("Wang",), ("Zhao",), ("LI WEI",)], "mention string")
    open_ = spark.createDataFrame([("L I W E I",)], "form string")
    got = {r["mention"]: (r["status"], r["person_id"]) for r in R.resolve_names(asked, names).collect()}
    assert got == {"liwei": ("resolved", "p1"), "LI WEI": ("resolved", "p1"), "Wang": ("ambiguous", None), "Zhao": ("not_found", None)}
    assert {r["status"] for r in R.resolve_names(asked.where("mention = 'liwei'"), names, open_).collect()} == {"ambiguous"}


def test_a_filtered_canonical_event_releases_its_members(spark):
    schema = "event_id string, start_value string, end_value string, event_type string"
    canonical = spark.createDataFrame([("c1", "1949-01-01", None, "meeting"), ("c2", "1949-02", None, "visit")], schema)
    source = spark.createDataFrame([("s1", "1949-01-01", None, "meeting"), ("s2", "1949-02", None, "meeting"), ("s3", None, None, "meeting")], schema)
    members = spark.createDataFrame([("c1", "s1"), ("c2", "s2")], "canonical_event_id string, event_id string")
    got = sorted(r["event_id"] for r in R.timeline(canonical, members, source, F.col("event_type") == "meeting").collect())
    assert got == ["c1", "s2", "s3"]


def test_periods_and_tenure(spark):
    low, high = R.period(F.col("v"))
    got = [tuple(r) for r in spark.createDataFrame([("1949",), ("1949-02",), ("1949-02-03",), ("1949-02-30",), ("?",)], "v string").select(low, high).collect()]
    d = datetime.date
    assert got == [(d(1949, 1, 1), d(1949, 12, 31)), (d(1949, 2, 1), d(1949, 2, 28)), (d(1949, 2, 3), d(1949, 2, 3)), (None, None), (None, None)]
    rows = spark.createDataFrame([(1, "1949", None), (2, "1950-05", "1952"), (3, None, None), (4, "1948", "1949-01")], "id int, s string, e string")
    assert sorted(r["id"] for r in R.held_at(rows, "s", "e", "1949-06").collect()) == [1]
    assert sorted(r["id"] for r in R.held_at(rows, "s", "e", "1951").collect()) == [2]


def test_synchronise_actions(spark):
    current = spark.createDataFrame([("a", "1", "confirmed", True), ("b", "1", "unreviewed", True), ("c", "1", "unreviewed", False), ("d", "1", "unreviewed", True), ("e", "1", "unreviewed", True)], "k string, input_hash string, review_status string, is_active boolean")
    new = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1"), ("d", "2"), ("f", "1")], "k string, input_hash string")
    got = {r["k"]: r["action"] for r in resolve.synchronise(current, new, "k").collect()}
    assert got == {"a": "protected", "b": "skipped", "c": "reactivated", "d": "updated", "e": "deactivated", "f": "created"}


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in resolve.components(pairs).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100}


def test_fusion_prefers_hits_of_both_branches(spark):
    schema = "query_id int, id int, rank int"
    one, two = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema), spark.createDataFrame([(1, 12, 1), (1, 11, 2)], schema)
    got = [r["id"] for r in fusion.fuse(one, two, 3).orderBy("rank").collect()]
    assert got == [11, 10, 12]


def test_coverage_keeps_the_order_of_rank(spark):
    rows = spark.createDataFrame([(1, i, y, i) for i, y in enumerate([1950, 1950, 1950, 1950, 1953, 1956], 1)], "query_id int, id int, year int, rank int")
    got = [r["id"] for r in fusion.cover(rows, "year", (1950, 1958), 4, "balanced").orderBy("final_rank").collect()]
    assert got == [1, 2, 5, 6]
    assert [r["id"] for r in fusion.cover(rows, "year", (1950, 1953), 4, "auto").orderBy("final_rank").collect()] == [1, 2, 3, 4]


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "query_id int, id int, rank int")
    gold = spark.createDataFrame([(1, 8), (1, 5), (2, 4)], "query_id int, id int")
    ranks = {r["query_id"]: (r["first"], r["reciprocal"]) for r in evaluation.first_ranks(hits, gold).collect()}
    assert ranks == {1: (2, 0.5), 2: (None, 0.0)}
    at = {r["query_id"]: (r["hit"], r["recall"], r["precision"]) for r in evaluation.at_k(hits, gold, 5).collect()}
    assert at == {1: (1, 0.5, 0.2), 2: (0, 0.0, 0.0)}
    grades = gold.withColumn("grade", F.when(F.col("query_id") == 1, 2).otherwise(0))
    got = {r["query_id"]: r["ndcg"] for r in evaluation.ndcg(hits, grades, 5).collect()}
    assert got[2] is None and 0.3 < got[1] < 0.5


def test_prompt_budget(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 50), (1, 3, "c" * 30), (1, 4, "  ")], "s int, t int, c string")
    got = {r["t"]: r["kept"] for r in sessions.prompt_messages(rows, "s", "t", "c", 5, 60).collect()}
    assert got == {3: 30, 2: 30}


def test_history_marks_are_replaced(spark):
    assert spark.createDataFrame([("见 [E12]\n\n 下文",)], "c string").select(sessions.sanitised(F.col("c"))).first()[0] == "见 [历史引用] 下文"
