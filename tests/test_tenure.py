"""Entries by lines, subjects of entries, appointments and tenure on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import chronology as C
from evidencelake.operators import positions


def test_lines_that_begin_entries(spark):
    text = "林彪年谱\n1935年 二十八岁\n前页的话\n3月 2日　到遵义。\n说明第3月 4日没有行首\n同日　开会。\n12\n3 月1 2日（星期二） 出发。"
    pages = spark.createDataFrame([("d", 1, "页前的话\n1月　出院。", "ocr"), ("d", 2, text, "text_layer"), ("d", 3, "次页接着说\n1月5日 新年", "text_layer"), ("d", 4, "没有年份\n1月5日 无", "ocr")], "document_id string, pdf_page int, text string, method string")
    repeated = spark.createDataFrame([("d", "林彪年谱")], "document_id string, line string")
    years = spark.createDataFrame([("d", 1, 1934), ("d", 2, 1935), ("d", 3, 1935)], "document_id string, pdf_page int, year int")
    got = C.line_entries(C.prepared(pages, repeated, "lin"), years).orderBy("entry").collect()
    assert [(r["label"], r["text"], r["pages"], r["date"]["start"]["value"]) for r in got] == [
        ("1月", "出院。", [1], "1934-01"),
        ("3月 2日", "到遵义。\n说明第3月 4日没有行首", [2], "1935-03-02"),
        ("同日", "开会。", [2], "1935"),
        ("3 月1 2日（星期二）", "出发。\n次页接着说", [2, 3], "1935-03-12"),
        ("1月5日", "新年", [3], "1935-01-05"),
    ]
    assert got[2]["date"]["flags"] == ["unknown_date"]


@pytest.mark.parametrize("text, wanted", [("3月2日 上午九时，出席会议", True), ("3月2日 苏联发表声明", False), ("3月2日 苏联致电毛泽东", True), ("会见代表", True), ("", False)])
def test_entries_on_the_subject(spark, text, wanted):
    frame = spark.createDataFrame([(text, "3月2日")], "t string, l string")
    assert frame.select(C.about_subject(F.col("t"), F.col("l"), ["毛泽东", "毛主席"])).first()[0] is wanted


@pytest.mark.parametrize("text, wanted", [
    ("会议建议由张三担任部长", []),
    ("张 三担任外交部部长、国务院副总理并兼任委员，后张三任主席", ["外交部部长", "国务院副总理", "委员", "主席"]),
    ("任命张三为国防部部长并出席会议", ["国防部部长"]),
    ("当选为主席。", ["主席"]),
    ("张三任命李四为部长", []),
    ("张三会见客人，担任主席", []),
    ("", []),
])
def test_appointments(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(positions.appointments(F.col("t"), F.lit("张三"))).first()[0] == wanted


def test_tenure(spark):
    rows = [(1, "p", "led", "confirmed", "部", "1950", None), (2, "p", "led", "confirmed", "部", None, None), (3, "p", "led", "unreviewed", "部", None, None), (4, "p", "met", "confirmed", "部", "1950", None), (5, "p", "led", "confirmed", None, "1950", None), (6, "p", "led", "rejected", "部", "1950", None), (7, "p", "led", "confirmed", "部", "1949", "1950-02")]
    relations = spark.createDataFrame(rows, "relation_id int, person_id string, relation_type string, review_status string, organization string, start_value string, end_value string")
    evidence = spark.createDataFrame([(i, f"e{i}") for i in (*range(1, 8), 1)], "relation_id int, evidence_id string")
    ids = lambda **k: [r["relation_id"] for r in positions.tenure(relations, evidence, **k).orderBy("place").collect()]
    assert ids() == [3, 7, 1] and ids(at="1950-03") == [1] and ids(at="1950") == [7, 1] and ids(limit=1, offset=1) == [7]
    for wrong in ({"limit": 0}, {"offset": -1}, {"types": ("met",)}, {"statuses": ()}):
        with pytest.raises(ValueError):
            positions.tenure(relations, evidence, **wrong)
