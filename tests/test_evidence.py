"""Structure by years, careers, citations, judgements and OCR results on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import corpus, evaluation, positions
from evidencelake.operators import pages as G


def test_years_begin_pages_once(spark):
    pages = spark.createDataFrame([
        ("d", 1, "目录\n1898年（诞生，一岁）....3\n1899年（二岁）……9"),
        ("d", 3, "1898年（一岁）\n正文\n1899年（二岁）"),
        ("d", 4, "1898年（一岁）\n1900 年 (三岁)"),
        ("d", 6, "1899年（二岁）"),
        ("e", 1, "没有年份"),
    ], "document_id string, pdf_page int, text string")
    last = spark.createDataFrame([("d", 9), ("e", 2)], "document_id string, pages int")
    got = [tuple(r) for r in corpus.year_structure(pages, last).orderBy("start").collect()]
    assert got == [("d", "1898年", 3, 3), ("d", "1900年", 4, 5), ("d", "1899年", 6, 9)]
    assert corpus.year_structure(pages.limit(0), last).count() == 0


@pytest.mark.parametrize("question, people, title, text, kept", [
    ("张三担任过什么", ["张三"], "文集", "会上，张三当选为中央委员。", True),
    ("张三担任过什么", ["张三"], "文集", "会上张三发言，李四当选为中央委员。", False),
    ("张三担任过什么", ["张三"], "张三年谱", "会上发言，李四当选为中央委员。", True),
    ("张三担任过什么", ["张三"], "文集", "由书记张三主持", True),
    ("张三担任过什么", ["张三"], "文集", "由张三、李四等人组成新的前委", True),
    ("张三的党内职务", ["张三"], "文集", "张三任政治委员", False),
    ("张三的任职", ["张三"], "文集", "张三任政治委员", True),
    ("张三在1935年的任职", None, "文集", "无关的内容", False),
    ("任职情况", [], "文集", "无关的内容", True),
    ("张三到过哪里", ["张三"], "文集", "无关的内容", True),
    ("张三的任职", ["张三"], None, None, False),
])
def test_careers(spark, question, people, title, text, kept):
    hits = spark.createDataFrame([(question, people, title, text)], "question string, people array<string>, title string, text string")
    assert positions.career_hits(hits).count() == int(kept)


def test_citations(spark):
    quote = "这是一段足够长的引文用来核对页面"
    cited = [(1, 1, "d", 1, 2, quote), (1, 2, "d", 9, None, quote), (2, 1, "d", 3, None, "另外的一段根本不在页面上的引文文字"), (4, 1, "d", 4, 5, quote)]
    citations = spark.createDataFrame(cited, "case_id int, number int, document_id string, start int, end int, quote string")
    gold = spark.createDataFrame([(1, "d", 2), (1, "d", 3), (3, "d", 1)], "case_id int, document_id string, page int")
    pages = spark.createDataFrame([("d", 1, "前文" + quote[:8]), ("d", 2, quote[8:] + "后文"), ("d", 3, "别的内容"), ("d", 4, quote)], "document_id string, page int, text string")
    got = {r["case_id"]: tuple(r)[1:] for r in evaluation.citation_metrics(citations, gold, pages).collect()}
    assert got[1] == (2, 0.5, None, 0.5, 0.5)
    assert got[2] == (1, 1.0, 0.0, 0.0, None)
    assert got[3] == (0, None, None, None, 0.0)
    assert got[4] == (1, 0.0, 1.0, 0.0, None)


def test_judgements(spark):
    rows = [("pass", ["甲"], "甲"), ("fail", [], "甲"), ("fail", ["甲 乙"], "甲乙丙"), ("fail", ["丁"], "甲"), ("pass", None, "甲")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, c array<string>, a string").orderBy("i")
    assert [r[0] for r in frame.select(evaluation.judgment_error(F.col("v"), F.col("c"), F.col("a"))).collect()] == ["passing_with_claims", "failing_without_claims", None, "claim_not_in_answer", None]


def test_ocr_results(spark):
    frame = spark.createDataFrame([(1, [(["一", " ", "二 "], [0.9, 0.1, 0.8]), (["三"], [])]), (2, [])], "i int, r array<struct<texts:array<string>,scores:array<double>>>").orderBy("i")
    assert [tuple(r[0]) for r in frame.select(G.ocr_text(F.col("r"))).collect()] == [("一\n二\n三", 0.85), ("", None)]
