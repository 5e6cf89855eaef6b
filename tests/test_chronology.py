"""Chronology entries, people and event records on small pages with known results."""

import pytest

from pyspark.sql import functions as F

from evidencelake.operators import chronology as C


@pytest.fixture(scope="module")
def built(spark):
    pages = spark.createDataFrame([
        ("d", 1, "序言不算【1949年1月5日】在北京出席会议，王五参加。△致电李四，商谈有关事项。", "text_layer"),
        ("d", 2, "继续上文的内容。【2月3日】赴上海视察，会见各界代表。【2月30日】主持召开座谈会讨论问题。", "ocr"),
    ], "document_id string, pdf_page int, text string, method string")
    forms = spark.createDataFrame([("p1", "张三"), ("p2", "李四"), ("p3", "王五"), ("p4", "代表"), ("p5", "代表")], "person_id string, form string")
    subjects = spark.createDataFrame([("d", "p1", "张三")], "document_id string, person_id string, name string")
    rows = C.entries(pages)
    return rows, C.candidates(rows, C.participants(rows, forms, subjects), subjects)


def test_entries_go_on_across_pages(built):
    got = [(r["label"], r["text"], r["pages"], r["date"]["start"]["value"]) for r in built[0].orderBy("entry").collect()]
    assert got == [
        ("1949年1月5日", "在北京出席会议，王五参加。", [1], "1949-01-05"),
        ("1949年1月5日", "致电李四，商谈有关事项。继续上文的内容。", [1, 2], "1949-01-05"),
        ("2月3日", "赴上海视察，会见各界代表。", [2], "1949-02-03"),
        ("2月30日", "主持召开座谈会讨论问题。", [2], "1949-02"),
    ]


def test_records(built):
    got = {r["quote"][:3]: r for r in built[1].collect()}
    first, second, third, last = got["在北京"], got["致电李"], got["赴上海"], got["主持召"]
    assert [p["person_id"] for p in first["participants"]] == ["p1", "p3"]
    assert first["participants"][0]["mention_source"] == "chronology_subject" and first["event_type"] == "meeting"
    assert second["event_type"] == "correspondence" and "cross_page" in second["flags"] and (second["pdf_page_start"], second["pdf_page_end"]) == (1, 2)
    assert first["location_text"] == "北京" and third["location_text"] == "上海" and third["event_type"] == "visit"
    assert [p["person_id"] for p in third["participants"]] == ["p1"]
    assert last["review_status"] == "needs_review" and third["review_status"] == "unreviewed"
    assert first["extraction_confidence"] == 0.89 and last["extraction_confidence"] == 0.58
    assert first["name"] == "张三：在北京出席会议，王五参加"


def test_summary_and_sample(spark, built):
    r = C.run_summary(built[1]).first()
    assert (r["events"], r["needs_review"], r["with_location"]) == (4, 1, 2)
    rows = spark.createDataFrame([("g", i) for i in range(10)], "g string, i int")
    assert [r["i"] for r in C.spaced_sample(rows, "g", "i", 4).orderBy("i").collect()] == [0, 3, 6, 9]


@pytest.mark.parametrize("text, wanted", [
    ("抵达北京，在上海举行会议。", "北京；上海"),
    ("前往平型关附近，到达平型关附近地区。", "平型关附近地区"),
    ("在会议期间工作。到达中央工作。", None),
    ("抵达沈阳机场，赴莫斯科访问，返回延安，到达太原。", "沈阳机场；莫斯科；延安"),
    ("来到某某村，", "某某村"),
    ("", None),
    (None, None),
])
def test_places(spark, text, wanted):
    rows = spark.createDataFrame([(text,)], "text string")
    assert rows.select(C.places(F.col("text"))).first()[0] == wanted
