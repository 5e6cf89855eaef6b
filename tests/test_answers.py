"""Quotes, extractive answers, salvage, years of timelines, plans and follow-up queries on small texts with known results."""

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import answers as A
from evidencelake.operators import planning as P
from evidencelake.operators import resolve

FILL = "文字" * 200


@pytest.fixture(scope="module")
def quoted(spark):
    rows = [
        ("short", "1月 5日　到 北京。", [], []),
        ("empty", "", ["甲某"], ["北京"]),
        ("null", None, ["甲某"], ["北京"]),
        ("one", "前文。甲某到北京。", ["甲某"], []),
        ("month", "3月开会。", [], []),
        ("kept", "3月上旬开会。", [], []),
        ("term", FILL + "。要点在此，" + FILL, [], ["无", "要点"]),
        ("nothing", FILL + FILL, [], ["无此词"]),
        ("date", FILL + "1935年3月2日在遵义，要点" + FILL, [], ["要点"]),
        ("pair", "甲某。" + FILL + "。会上甲某见乙某，" + FILL, ["甲某", "乙某", "甲某"], []),
        ("apart", "甲某" + FILL * 2 + "乙某", ["甲某", "乙某"], []),
    ]
    frame = spark.createDataFrame(rows, "k string, text string, people array<string>, terms array<string>")
    return {r["k"]: r["quote"] for r in A.quotes(frame, "text", "people", "terms").collect()}


def test_short_texts_are_quoted_whole(quoted):
    assert quoted["short"] == "1月 5日 到 北京。" and quoted["empty"] == "" and quoted["null"] is None
    assert quoted["kept"] == "3月上旬开会。" and quoted["month"] == "开会。"


def test_quotes_begin_at_sentences_and_dates(quoted):
    assert quoted["one"] == "……甲某到北京。"
    assert quoted["term"].startswith("……要点在此，") and len(quoted["term"]) == 407
    assert quoted["nothing"] == (FILL + FILL)[:420] + "……"
    assert quoted["date"].startswith("……1935年3月2日在遵义，要点文字")


def test_two_people_are_quoted_where_they_meet(quoted):
    assert "会上甲某见乙某" in quoted["pair"] and quoted["pair"].startswith("……")
    assert quoted["apart"].startswith("甲某文字") and quoted["apart"].endswith("……")


def test_salvage(spark):
    texts = ["# 标题\n这一行没有任何证据标记，应当去掉。\n\n\n\n这一行有证据标记可以留下 [E1]", "全部都有标记，没有什么可去掉的内容 [E2]", "这一整行都没有任何的证据标记在里面", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in frame.orderBy("i").select(A.salvaged(F.col("t"))).collect()]
    assert got == ["# 标题\n\n这一行有证据标记可以留下 [E1]", None, None, None]


@pytest.mark.parametrize("question, answer, wanted", [
    ("1935年的经历", "- 3月开会 [E1]", False),
    ("1935年至1936年", "- 3月开会 [E1]", True),
    ("1935年至1936年", "## 1935年\n- 3月开会 [E1]\n- 2月休养 [E2]", True),
    ("1935年至1936年", "## 1935年\n- 3月开会 [E1]\n## 1936年\n- 2月休养 [E2]", False),
    ("1935年至1936年", "- 1935年3月开会 [E1]\n- 4月2日到4月1日 [E2]", True),
    ("1935年至1936年", "- 1935年12月开会 [E1]\n- 1936年1月 [E2]\n没有证据的 3月", False),
    ("1935年至1936年", "## 1935年\n- 3月 [E1]\n## 其他\n- 4月 [E2]", True),
    ("1935年至1936年", "", False),
])
def test_years_of_timelines(spark, question, answer, wanted):
    frame = spark.createDataFrame([(1, question, answer)], "answer_id int, question string, answer string")
    assert [tuple(r) for r in A.ambiguous_years(frame).collect()] == [(1, wanted)]


def test_extractive_answers(spark):
    questions = spark.createDataFrame([(1, "timeline"), (2, "viewpoint")], "answer_id int, intent string")
    cited = [(1, 2, "短句。这一句话足够长，可以作为答案使用。", [1935, 1936]), (1, 1, "……，没有句号的引文", [])]
    frame = spark.createDataFrame(cited, "answer_id int, number int, quote string, years array<int>")
    got = {r["answer_id"]: r["answer"] for r in A.extractive(questions, frame).collect()}
    assert got[1] == A.LEADS["timeline"] + "\n\n- 没有句号的引文 [E1]\n- 1935、1936年：这一句话足够长，可以作为答案使用。 [E2]"
    assert got[2] == A.NOTHING


def test_periods_of_titles(spark):
    frame = spark.createDataFrame([("年谱 1898—1949", 1950, 1960), ("年谱 1898.3-1949.10", 1949, 1960), ("文集", 1, 2), ("年谱 1898—1949", None, None)], "t string, a int, b int")
    assert [r[0] for r in frame.select(A.period_fits(F.col("t"), F.col("a"), F.col("b"))).collect()] == [False, True, True, True]


def test_candidate_blocks(spark):
    frame = spark.createDataFrame([(1, 2, "乙", 7, [1935, 1936], "二", "甲"), (1, 1, "甲", 3, [], "一", "甲")], "answer_id int, rank int, title string, page int, years array<int>, text string, person string")
    assert A.candidate_text(frame, "person").first()["block"] == "[R1] 文献：《甲》；PDF第3页；片段标注年份：未标注\n一\n\n[R2] 文献：《乙》；PDF第7页；片段标注年份：[1935, 1936]\n二"


def test_followups(spark):
    frame = spark.createDataFrame([("甲某在1935年", ["甲某", "甲某"], ["会议"], ["1936年 的任职。", "更多", "1935年任职", "1936年的任职", "观点"])], "q string, e array<string>, c array<string>, a array<string>")
    column = P.followups(F.col("q"), F.col("e"), F.col("q"), F.col("c"), F.col("a"), 2)
    assert frame.select(column).first()[0] == ["甲某 的任职 会议", "甲某 1935年任职 会议"]


PLAN = "question string, previous string, normalized string, start_year int, end_year int, entities array<struct<text:string,canonical:string>>, queries array<string>, constraints array<string>, coverage string"


@pytest.mark.parametrize("question, previous, years, names, queries, coverage", [
    ("张三做过什么", "李四1935年在哪里", (None, None), ["张三"], ["张三 经历"], "relevance"),
    ("他在那年做过什么", "李四1935年在哪里", (1935, 1935), ["李四"], ["张三 经历", "李四 1935"], "per_year"),
    ("张三1940年", None, (1940, 1940), ["张三"], ["张三 经历"], "per_year"),
])
def test_plans_keep_to_the_question(spark, question, previous, years, names, queries, coverage):
    row = (question, previous, "张三 李四", 1935, 1935, [("张三", "张三"), ("李四", "李四")], ["张三 经历", "李四 1935"], ["1935年内"], "per_year")
    got = P.guarded(spark.createDataFrame([row], PLAN), ["他", "那年"]).first()
    assert (got["start_year"], got["end_year"]) == years and [e["text"] for e in got["entities"]] == names and got["coverage"] == coverage
    kept = [q for q in queries if "张三" not in q or "张三" in names]
    assert got["queries"] == kept


def test_month_pairs_take_nulls_and_refuse_thresholds(spark):
    kinds = "event_id string, start_value string, event_type string, description string, people array<string>, organizations array<string>, location string, documents array<string>, subjects array<string>"
    rows = [("a", "1935-03-02", "visit", "到遵义出席会议", None, None, None, ["x"], None), ("b", "1935-03-02", "visit", "到遵义出席会议", None, None, None, ["y"], None), ("c", None, "visit", "到遵义出席会议", None, None, None, None, None), ("d", "1935-03-02", "visit", "", ["p"], None, None, ["z"], None), ("e", "1935-03-02", "visit", "到遵义出席会议", None, None, None, ["x"], None)]
    frame = spark.createDataFrame(rows, kinds)
    got = sorted((r["a"], r["b"], r["relation"], r["score"]) for r in resolve.candidates(resolve.month_pairs(frame)).collect())
    assert got == [("a", "b", "exact_day", 0.69), ("b", "e", "exact_day", 0.69)]
    assert resolve.month_pairs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        resolve.month_pairs(frame, 0.4)
