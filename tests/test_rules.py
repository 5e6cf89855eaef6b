"""Dates, questions, positions and grounding on small rows with known results."""

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import dates
from evidencelake.operators import enrichment, planning, positions, resolve


@pytest.mark.parametrize("text, hint, start, end, certainty, flags", [
    ("1962 年7 月28 日－8 月24 日", None, "1962-07-28", "1962-08-24", "exact", ["date_range"]),
    ("1962年9月15日、16日、19日", None, "1962-09-15", "1962-09-19", "approximate", ["multiple_dates"]),
    ("1月5日—7日", 1948, "1948-01-05", "1948-01-07", "inferred", ["date_range"]),
    ("1948年2月30日", None, "1948-02", None, "exact", ["invalid_date_component"]),
    ("3月25日—9日", 1933, "1933-03-25", None, "inferred", ["invalid_date_order"]),
    ("1950年春", None, "1950", None, "approximate", []),
    ("不详", None, None, None, "unknown", ["unknown_date"]),
    (None, 1950, None, None, "unknown", ["unknown_date"]),
])
def test_partial_dates(text, hint, start, end, certainty, flags):
    got = dates.parse(text, hint)
    assert (got["start"]["value"], got["end"] and got["end"]["value"], got["start"]["certainty"], got["flags"]) == (start, end, certainty, flags)


def test_dates_as_a_column(spark):
    row = spark.createDataFrame([("1月5日", 1948)], "t string, y int").select(dates.parsed("t", F.col("y")).alias("d")).first()["d"]
    assert row["start"]["value"] == "1948-01-05" and row["start"]["precision"] == "day" and row["end"] is None


def column(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression.alias("r")).first()["r"]


def test_relative_years(spark):
    years = dates.relative_years(F.col("t"), 1921, 1978)
    assert column(spark, "1949年以前的会议", years) == [1921, 1948]
    assert column(spark, "1949年及以前", years) == [1921, 1949]
    assert column(spark, "1970年之后", years) == [1971, 1978]
    assert column(spark, "1949年以前和1950年", years) is None


def test_year_ranges(spark):
    assert column(spark, "1921-1926年", planning.has_range(F.col("t"))) is True
    assert column(spark, "1937年和1945年", planning.has_range(F.col("t"))) is False
    assert column(spark, "1937年和1945年", planning.year_range(F.col("t"))) == [1937, 1945]
    assert column(spark, "长征和抗美援朝", planning.year_range(F.col("t"))) == [1934, 1953]
    assert column(spark, "何时", planning.year_range(F.col("t"))) is None


def test_intent_takes_the_first_rule(spark):
    rules = [("viewpoint", "观点|主张"), ("timeline", "活动|经过")]
    assert column(spark, "1950年活动的观点", planning.intent(F.col("t"), rules)) == "viewpoint"
    assert column(spark, "其他", planning.intent(F.col("t"), rules)) == "general"


def test_sub_ranges():
    assert planning.sub_ranges(1950, 1958, "balanced") == [(1950, 1952), (1953, 1955), (1956, 1958)]
    assert planning.sub_ranges(1950, 1952, "per_year") == [(1950, 1950), (1951, 1951), (1952, 1952)]
    assert len(planning.sub_ranges(1921, 1978, "per_year")) == 8


def test_positions(spark):
    got = column(spark, "会上，张三被任命为外交部部长兼国务院副总理，并出席会议。", positions.appointments(F.col("t"), F.lit("张三")))
    assert got == ["外交部部长", "国务院副总理"]
    split = lambda t: (lambda r: r and (r["organization"], r["role"]))(column(spark, t, positions.position(F.col("t"))))
    assert split("外交部部长") == ("外交部", "部长")
    assert split("国务院副总理") == ("国务院", "副总理")
    assert split("中央委员") is None and split("学校校长") is None


def test_evidence_budget_and_citations(spark):
    rows = spark.createDataFrame([("e", 1, "a" * 8), ("e", 2, "b" * 8), ("e", 3, "c")], "event_id string, seq int, quote string")
    assert [r["quote"] for r in enrichment.bounded_evidence(rows, 10).orderBy("seq").collect()] == ["a" * 8, "bb"]
    answers = spark.createDataFrame([(1, "# 标题\n这一段话没有任何标记存在。\n这一段话有标记[E1]和[E9]存在。")], "answer_id int, answer string")
    citations = spark.createDataFrame([(1, 1), (1, 2)], "answer_id int, number int")
    got = sorted((r["line"], r["error"]) for r in enrichment.citation_errors(answers, citations).collect())
    assert got == [(1, "missing_marker"), (2, "unknown_marker")]
    assert [r["number"] for r in enrichment.used_citations(answers, citations).collect()] == [1]
    whole = spark.createDataFrame([(["甲 乙", "丙"], "甲乙在丙")], "v array<string>, e string")
    assert whole.select(enrichment.grounded(F.col("v"), F.col("e"))).first()[0] is True


def test_components_of_named_events(spark):
    pairs = spark.createDataFrame([("e1", "e2"), ("e2", "e9"), ("f1", "f2")], "a string, b string")
    got = {r["node"]: r["component"] for r in resolve.components(pairs).collect()}
    assert got == {"e1": "e1", "e2": "e1", "e9": "e1", "f1": "f1", "f2": "f1"}


def test_canonical_types(spark):
    rows = [(1, "visit", True), (1, "visit", False), (2, "activity", True), (2, "speech", False), (3, "visit", False), (3, "speech", True), (4, "activity", True)]
    got = resolve.canonical_type(spark.createDataFrame(rows, "component int, event_type string, is_representative boolean"), "component")
    assert {r["component"]: r["event_type"] for r in got.collect()} == {1: "visit", 2: "speech", 3: "speech", 4: "activity"}
