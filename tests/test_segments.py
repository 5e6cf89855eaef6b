"""Entries with split and relative dates on small pages with known results."""

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import segments
from evidencelake.operators.chronology import about_subject

TEXT = "text_layer"


def entries(spark, texts, years, methods=None):
    pages = spark.createDataFrame([("d", p, t, (methods or {}).get(p, TEXT), "x") for p, t in texts.items()], "document_id string, pdf_page int, text string, method string, label string")
    dated = spark.createDataFrame([("d", p, y) for p, y in years.items()], "document_id string, pdf_page int, year int")
    return segments.split_date_entries(pages, dated).orderBy("entry").collect()


def starts(rows):
    return [r["date"]["start"]["value"] for r in rows]


def test_split_labels_footnotes_and_pages(spark):
    rows = entries(spark, {
        6: "1949年\n五十六岁\n10月\n1\n日下午，甲某与乙某在西城召开会议讨论工作。\n同日下午，出席群众举行的大会并宣读公告，\n[1]丙某，1954年担任某项职务。",
        7: "2\n1 9 4 9 年\n1\n0 月\n随后向到会群众讲话并接受代表致意。\n10月2日—5日 在西城连续召开会议研究有关工作。\n10月6日 致信有关部门研究下一阶段工作。",
    }, {6: 1949, 7: 1949}, {7: "ocr"})
    assert starts(rows) == ["1949-10-01", "1949-10-01", "1949-10-02", "1949-10-06"]
    assert rows[2]["date"]["end"]["value"] == "1949-10-05"
    assert rows[1]["pages"] == [6, 7] and rows[1]["methods"] == ["ocr", TEXT] and rows[1]["flags"] == ["footnotes_excluded"]
    assert "1954" not in rows[1]["text"] and rows[1]["text"].startswith("同日\n下午") and "随后向到会群众" in rows[1]["text"]
    assert rows[1]["date"]["flags"] == ["inherited_date"] and rows[1]["date"]["start"]["certainty"] == "inferred"


def test_years_and_missing_pages_end_what_is_carried(spark):
    rows = entries(spark, {1: "12月31日 召开会议部署工作。", 2: "同日 会见代表讨论工作。", 4: "同日 与代表团会谈。", 5: "属于上一条的话。"}, {1: 1949, 2: 1950, 4: 1950, 5: 1950})
    assert starts(rows) == ["1949-12-31", "1950", "1950"]
    assert [r["flags"] for r in rows] == [[], ["page_gap"], []]
    assert rows[2]["pages"] == [4, 5] and rows[1]["date"]["flags"] == ["inherited_date", "year_only_fallback"]


def test_relative_days(spark):
    rows = entries(spark, {
        1: "1月1日 目录中的日期不是一条。",
        2: "7月初 讨论农村工作。\n7月3日 会见来访的代表团。\n翌日 再次会见。\n次日 第三次会见。\n夏衍来信讨论创作。\n本月 为有关部门题词。\n翌日 没有可依的日子。\n同日 也没有。\n本年 写成文章。\n7月7日、9日 听取汇报。\n翌日 不止一天。",
    }, {2: 1961})
    assert starts(rows) == ["1961-07", "1961-07-03", "1961-07-04", "1961-07-05", "1961-07", "1961", "1961", "1961", "1961-07-07", "1961"]
    assert "夏衍来信" in rows[3]["text"]
    assert rows[5]["date"]["flags"] == ["inherited_date", "year_only_fallback", "relative_date_unresolved"]
    assert rows[8]["date"]["end"]["value"] == "1961-07-09"
    assert rows[4]["date"]["start"]["precision"] == "month"


def test_headings_do_not_replace_the_day(spark):
    rows = entries(spark, {1: "8月9日 主持会议讨论形势，", 2: "620\nl 9 4 5 年\n8 月\n并听取意见。\n同日 致电有关方面。\nClJ 丙某，当时担任职务。"}, {1: 1945, 2: 1945})
    assert starts(rows) == ["1945-08-09", "1945-08-09"] and "丙某" not in rows[1]["text"]


def test_what_tells_of_the_subject(spark):
    rows = entries(spark, {1: "\n7月7日 夜，敌军发动进攻，战争开始。\n7月8日 下午，在某地主持会议。\n同日 甲某和乙某致电有关方面。"}, {1: 1937})
    frame = spark.createDataFrame([(r["entry"], r["text"], r["label"]) for r in rows], "entry int, text string, label string")
    got = frame.select("entry", about_subject(F.col("text"), F.col("label"), ["甲某"]).alias("own")).orderBy("entry").collect()
    assert [r["own"] for r in got] == [False, True, True]


@pytest.mark.parametrize("texts, years", [({}, {}), ({1: None, 2: ""}, {1: 1950, 2: 1950}), ({1: "没有日期的话"}, {1: 1950}), ({1: "1月1日 有日期"}, {})])
def test_pages_without_entries(spark, texts, years):
    assert entries(spark, texts, years) == []
