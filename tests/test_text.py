"""Text functions and corpus operators on small rows with known results."""

from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import corpus, pages


def one(spark, expression, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(expression.alias("r")).first()["r"]


def test_index_tokens_count_a_year_twice(spark):
    got = one(spark, T.index_tokens("t"), t="抗日战争 1937年 Long-March 3.14")
    assert got == ["抗日", "日战", "战争", "年", "1937", "long-march", "3.14", "1937", "1937年"]


def test_query_tokens_drop_stop_terms_and_edges(spark):
    got = one(spark, T.query_tokens("t", ("哪些",), "的了"), t="哪些 的人 会议 a 会议")
    assert got == ["会议"]


def test_bigrams_and_similarity(spark):
    row = spark.createDataFrame([("AB-c", "abd")], "a string, b string").select(T.bigrams("a").alias("x"), T.bigrams("b").alias("y")).select("x", "y", T.containment("x", "y").alias("c"), T.jaccard("x", "y").alias("j")).first()
    assert row["x"] == ["ab", "bc"] and row["c"] == 0.5 and abs(row["j"] - 1 / 3) < 1e-12


def test_page_classes(spark):
    rows = [("", 0, "empty", ["empty_page"]), ("", 2, "ocr_required", ["image_only_page"]), ("短", 0, "extracted", ["very_short_text"]), ("字" * 60, 0, "extracted", []), ("字" * 60 + "�" * 5, 0, "ocr_required", ["high_replacement_ratio"])]
    got = spark.createDataFrame([(t, n) for t, n, *_ in rows], "t string, n int").select(T.page_status("t", "n").alias("s"), T.page_flags("t", "n").alias("f")).collect()
    assert [(r["s"], r["f"]) for r in got] == [(s, f) for *_, s, f in rows]


def test_storage_form(spark):
    assert one(spark, T.for_storage("t"), t="a\r\nb\rc\x00d") == "a\nb\ncd"


def test_cleaned_joins_wrapped_lines(spark):
    text = "页眉\n第一章 总论\n这是一段\n很长的文字。\n12\n下一段\n\n末段"
    got = one(spark, corpus.cleaned(F.col("t"), F.array(F.lit("页眉"))), t=text)
    assert got == "第一章 总论\n这是一段很长的文字。\n下一段\n末段"


def test_chunks_respect_the_limits(spark):
    sentence = "一" * 299 + "。"
    got = one(spark, corpus.chunk_texts(F.col("t")), t=sentence * 5)
    assert [len(c) for c in got] == [900, 600]
    assert one(spark, corpus.chunk_texts(F.col("t")), t="一" * 2000 + "。") == ["一" * 900, "一" * 900, "一" * 200 + "。"]
    assert one(spark, corpus.chunk_texts(F.col("t")), t="太短。") == []
    tail = one(spark, corpus.chunk_texts(F.col("t")), t="一" * 699 + "。" + "二" * 50 + "。")
    assert [len(c) for c in tail] == [751]


def test_dates(spark):
    assert one(spark, corpus.dates("t"), t="1937年7月7日，又 1937 年 8 月，一九三八年，1937年7月7日") == ["1937-07-07", "1937-08", "1938"]


def test_contents_page(spark):
    assert one(spark, corpus.is_contents_page("t"), t="目录\n一……………1\n二……………2\n三.......3") is True
    assert one(spark, corpus.is_contents_page("t"), t="目录\n一……………1") is False


def test_effective_pages(spark):
    base = spark.createDataFrame([("d", 1, "extracted", "正文"), ("d", 2, "ocr_required", ""), ("d", 3, "empty", ""), ("d", 4, "ocr_required", "")], "document_id string, pdf_page int, status string, normalized_text string")
    ocr = spark.createDataFrame([("d", 2, "extracted", "识别"), ("d", 3, "extracted", "不用"), ("d", 4, "failed", "")], base.schema)
    got = {r["pdf_page"]: (r["text"], r["method"]) for r in pages.effective_pages(base, ocr).collect()}
    assert got == {1: ("正文", "text_layer"), 2: ("识别", "ocr")}


def test_page_ranges(spark):
    rows = spark.createDataFrame([("a", p) for p in (1, 2, 3, 3, 7, 9, 10)], "g string, p int")
    assert pages.page_ranges(rows, "g", "p").first()["ranges"] == "1–3, 7, 9–10"


def test_outline_ends_and_paths(spark):
    entries = spark.createDataFrame([("d", 1, 1, 1, "一"), ("d", 2, 2, 2, "甲"), ("d", 3, 2, 5, "乙"), ("d", 4, 1, 8, "二")], "document_id string, seq int, level int, page int, title string")
    last = spark.createDataFrame([("d", 10)], "document_id string, last_page int")
    ended = corpus.outline_ends(entries, last)
    assert [r["end_page"] for r in ended.orderBy("seq").collect()] == [7, 4, 7, 10]
    wanted = spark.createDataFrame([("d", 3), ("d", 6), ("d", 9)], "document_id string, pdf_page int")
    got = {r["pdf_page"]: r["path"] for r in corpus.section_paths(wanted, ended).collect()}
    assert got == {3: ["一", "甲"], 6: ["一", "乙"], 9: ["二"]}
