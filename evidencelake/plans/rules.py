"""Queries that run the rules of questions, hits, pages and chronologies over the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import dates
from evidencelake.functions import text as T
from evidencelake.operators import answers, chronology, fusion, keyword, pages, planning, positions, stored
from evidencelake.plans.retrieval import BM25, BRANCHES, _bm25, _branches, _ranked
from evidencelake.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _pick(column, *values):
    """The value at the remainder of a key; None is null."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(column % len(values) == i, v).otherwise(out)
    return out


# Hits


@query(f"""
WITH {BRANCHES}, hi AS (SELECT *, ['timeline', 'viewpoint', 'observation'][query_id % 3 + 1] AS intent, ['chronology', 'selected_works', 'contemporary_observation', 'other'][id % 4 + 1] AS st FROM f),
bo AS (SELECT query_id, id, round(raw_rrf + CASE WHEN (intent = 'timeline' AND (id % 5 = 0 OR (query_id % 2 = 1 AND st = 'chronology'))) OR (intent = 'viewpoint' AND st = 'selected_works') OR (intent = 'observation' AND st = 'contemporary_observation') THEN CAST(0.004 AS DOUBLE) ELSE 0 END, 8) AS rrf_score FROM hi),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM bo) SELECT * FROM r WHERE rank <= 10""")
def h4_source_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches of every benchmark item, fused with the bonus of sources that suit its intent."""
    words, near = _branches(spark, sf_dir, 100)
    met = words.select("query_id", "id").unionByName(near.select("query_id", "id")).distinct()
    intent = _pick(F.col("query_id"), "timeline", "viewpoint", "observation")
    source = _pick(F.col("id"), "chronology", "selected_works", "contemporary_observation", "other")
    bonus = met.select("query_id", "id", fusion.source_bonus(intent, source, F.col("id") % 5 == 0, F.col("query_id") % 2 == 0).alias("bonus"))
    return fusion.fuse(words, near, 10, bonus).select("query_id", "id", "rrf_score", F.col("rank").cast("long").alias("rank"))


@query("""
WITH o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y FROM orders),
p AS (SELECT k, list_filter(CASE WHEN k % 4 = 0 THEN [y - 9, y] ELSE [] END, lambda v: v BETWEEN 1994 AND 1998) AS section, CASE WHEN k % 3 = 0 THEN [y + 1, y] ELSE [] END AS written, list_filter([y + 1, y, y - 2], lambda v: v BETWEEN 1994 AND 1998) AS inside FROM o)
SELECT k AS id, coalesce(section[1], list_filter(written, lambda v: list_contains(inside, v))[1], list_min(inside)) AS year FROM p""")
def h7_primary_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year each order is about: of its section, of its text, or the least of its years."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    none = F.array().cast("array<int>")
    written = F.when(key % 3 == 0, F.concat(F.lit("至"), (year + 1).cast("string"), F.lit("年又"), year.cast("string"), F.lit("年止"))).otherwise("无")
    return table(spark, sf_dir, "orders").select(key.alias("id"), fusion.primary_year(F.when(key % 4 == 0, F.array(year - 9, year)).otherwise(none), written, F.array(year + 1, year, year - 2), 1994, 1998).alias("year"))


@query(f"""
WITH {BM25}, d AS (SELECT *, doc_id % 50 + 1900 AS y FROM documents),
r AS (SELECT query_id, id AS doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, id) AS rank FROM b JOIN d ON d.doc_id = b.id
  WHERE (d.lang IS NULL OR d.lang <> 'fr') AND d.source IN ('src1', 'src2', 'src3', 'src4') AND (y BETWEEN 1910 AND 1930 OR y + 20 BETWEEN 1910 AND 1930) AND doc_id % 3 <> 0)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def k10_bm25_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best among documents whose metadata pass: scope, document, section, years and people."""
    key = F.col("doc_id")
    year = (1900 + key % 50).cast("int")
    metadata = table(spark, sf_dir, "documents").select(
        key.alias("chunk_id"), F.col("source").alias("document_id"), F.when(F.col("lang") == "fr", "out_of_scope").otherwise("in_scope").alias("scope_status"),
        F.array(F.lit("book"), F.concat(F.lit("part "), F.col("source"))).alias("section_path"), F.array(year, year + 20).alias("year_mentions"), F.when(key % 3 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("people"),
    )
    passed = keyword.admitted(metadata, ["src1", "src2", "src3", "src4"], "part src", (1910, 1930), people=["a", "b"]).select("chunk_id", F.lit(0.0).alias("gain"))
    return _ranked(_bm25(spark, sf_dir, 10, passed))


@query("""
WITH o AS (SELECT o_custkey AS question, o_orderkey AS id, o_orderkey % 6 AS form FROM orders) SELECT question, id FROM o WHERE form IN (0, 1, 3, 5) OR question % 4 = 0""")
def h3_career_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of customers' questions on a career, those that tie the person to a role; a question in four is on something else."""
    key = F.col("o_orderkey")
    texts = _pick(key, "张三出任该部副部长。", "会上，书记张三讲话。", "张三出席会议。某人当选主席。", "同日，张三与各方组成临时党委。", "李四担任部长，另有任务。", "他改任秘书长，三月到任。")
    title = F.when(key % 6 == 5, "张三年谱").otherwise("文集")
    question = F.when(F.col("o_custkey") % 4 == 0, "张三在1950年的讲话").when(F.col("o_custkey") % 4 == 1, "张三在1950年任职情况").otherwise("介绍张三 职务变化")
    people = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("张三"))).otherwise(F.array().cast("array<string>"))
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asked"), key.alias("id"), question.alias("question"), people.alias("people"), title.alias("title"), texts.alias("text"))
    return positions.career_hits(hits).select(F.col("asked").alias("question"), "id")


# Questions


@query("""
WITH c AS (SELECT c_custkey AS k, CAST(1930 + c_custkey % 40 AS INT) AS a, CAST(1935 + c_custkey % 23 AS INT) AS b FROM customer)
SELECT k AS question, k % 5 = 0 AS has_range, CASE WHEN k % 5 IN (0, 1) THEN least(a, b) WHEN k % 5 = 2 THEN 1934 WHEN k % 5 = 3 THEN CASE WHEN k % 2 = 0 THEN 1945 END END AS first, CASE WHEN k % 5 IN (0, 1) THEN greatest(a, b) WHEN k % 5 = 2 THEN 1953 WHEN k % 5 = 3 THEN CASE WHEN k % 2 = 0 THEN 1949 END END AS last,
  CASE WHEN k % 3 = 0 THEN 'viewpoint' WHEN k % 3 = 1 THEN 'timeline' ELSE 'general' END AS intent, CASE WHEN k % 3 = 0 THEN 0 ELSE 2 END AS people FROM c""")
def k5_question_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, intent and hard people of a question of every customer."""
    key = F.col("c_custkey")
    one, two = ((1930 + key % 40).cast("string"), (1935 + key % 23).cast("string"))
    when = F.when(key % 5 == 0, F.concat(one, F.lit("年至"), two, F.lit("年"))).when(key % 5 == 1, F.concat(one, F.lit("年和"), two, F.lit("年"))).when(key % 5 == 2, "长征和抗美援朝").when((key % 5 == 3) & (key % 2 == 0), "解放战争").otherwise("当时")
    what = F.when(key % 3 == 0, "的观点与活动").when(key % 3 == 1, "的活动经过").otherwise("的来信")
    rows = table(spark, sf_dir, "customer").select(key.alias("question"), F.concat(when, what).alias("t"))
    intent = planning.intent(F.col("t"), [("viewpoint", "观点|主张"), ("timeline", "活动|经历")])
    years = planning.year_range(F.col("t"))
    people = planning.filtered_people(F.array(F.lit("a"), F.lit("b")), intent)
    return rows.select("question", planning.has_range(F.col("t")).alias("has_range"), F.get(years, F.lit(0)).alias("first"), F.get(years, F.lit(1)).alias("last"), intent.alias("intent"), F.size(people).alias("people"))


@query("""
WITH c AS (SELECT c_custkey AS k, 1930 + c_custkey % 40 AS y FROM customer)
SELECT k AS question, CASE k % 5 WHEN 0 THEN 1921 WHEN 1 THEN 1921 WHEN 2 THEN y + 1 WHEN 3 THEN y END AS first, CASE k % 5 WHEN 0 THEN y - 1 WHEN 1 THEN y WHEN 2 THEN 1978 WHEN 3 THEN 1978 END AS last FROM c""")
def q1_relative_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years before and after the one that each customer's question names."""
    key = F.col("c_custkey")
    year = (1930 + key % 40).cast("string")
    text = F.concat(year, _pick(key, "年以前的事", "年及之前", "年之后", "年及以后的会议", "年的会议"))
    years = dates.relative_years(text, 1921, 1978)
    return table(spark, sf_dir, "customer").select(key.alias("question"), F.get(years, F.lit(0)).cast("long").alias("first"), F.get(years, F.lit(1)).cast("long").alias("last"))


@query("""
WITH o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y FROM orders)
SELECT k AS id, CASE k % 4 WHEN 0 THEN y <= 1997 AND 1995 <= y + 2 WHEN 1 THEN y - 3 <= 1997 AND 1995 <= y - 1 ELSE true END AS fits FROM o""")
def q14_period_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the years in a title overlap 1995 to 1997."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    s = lambda c: c.cast("string")
    title = F.when(key % 4 == 0, F.concat(F.lit("年谱（"), s(year), F.lit("—"), s(year + 2), F.lit("）"))).when(key % 4 == 1, F.concat(F.lit("文选 "), s(year - 3), F.lit(".5至"), s(year - 1), F.lit(".12"))).when(key % 4 == 2, F.concat(F.lit("年谱 "), s(year))).otherwise("文选")
    return table(spark, sf_dir, "orders").select(key.alias("id"), answers.period_fits(title, F.lit(1995), F.lit(1997)).alias("fits"))


@query("""
WITH o AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT k AS question, n > 12 OR k % 4 = 1 OR k % 3 = 0 AS reflects FROM o""")
def h15_reflects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' questions deserve a second look: by coverage, intent or wording."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("question")).agg(F.count("*").alias("n"))
    key = F.col("question")
    asked = F.when(key % 3 == 0, "请梳理这段经过").otherwise("这是何时")
    return rows.select("question", planning.reflects(asked, F.when(key % 4 == 1, "comparison").otherwise("fact"), F.when(F.col("n") > 12, "balanced").otherwise("relevance")).alias("reflects"))


# Pages


PAGE = "p AS (SELECT page_id, page_id % 11 AS doc, page_id // 11 AS page, trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body, len(regexp_extract_all(html, '<img')) AS images FROM pages)"


@query(rf"""
WITH {PAGE}, c AS (SELECT *, length(regexp_replace(body, '\s+', '', 'g')) AS n FROM p),
s AS (SELECT *, CASE WHEN n = 0 AND images > 0 THEN 'ocr_required' WHEN n = 0 THEN 'empty' ELSE 'extracted' END AS own FROM c),
w AS (SELECT *, doc % 4 = 0 AS whole, doc % 4 = 1 AND page % 5 = 0 AS listed FROM s)
SELECT doc AS document_id, page AS pdf_page, CASE WHEN whole OR listed THEN 'ocr_required' ELSE own END AS status, CASE WHEN whole THEN 'ocr_policy_full' WHEN listed THEN 'ocr_policy_page' ELSE '' END AS policy FROM w""")
def p4_ocr_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Html pages as pages of eleven books, of which some are read again whole, some by every fifth page; an earlier policy's flags go."""
    key = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select((key % 11).alias("document_id"), F.floor(key / 11).alias("pdf_page"), F.trim(F.regexp_replace("html", "<[^>]*>", "")).alias("text"), F.regexp_count("html", F.lit("<img")).alias("images"))
    records = pages.page_records(rows)
    before = F.when(F.col("pdf_page") % 7 == 0, F.array_append("quality_flags", "ocr_policy_full")).otherwise(F.col("quality_flags"))
    book = F.col("document_id")
    catalog = rows.select("document_id").distinct().select("document_id", F.when(book % 4 == 0, "full").when(book % 4 == 1, "pages").alias("ocr_strategy"), F.when(book % 4 == 1, F.transform(F.sequence(F.lit(0), F.lit(200_000)), lambda i: (i * 5).cast("long"))).alias("ocr_pages"))
    found = pages.with_ocr_policy(records.withColumn("quality_flags", before), catalog)
    return found.select("document_id", "pdf_page", "status", F.array_join(F.filter("quality_flags", lambda f: F.startswith(f, F.lit("ocr_policy"))), ",").alias("policy"))


@query(rf"""
WITH {PAGE}, b AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'ocr_required' WHEN 1 THEN 'extracted' WHEN 2 THEN 'empty' ELSE 'extracted' END AS own, CASE WHEN page_id % 4 = 3 THEN ' ' ELSE 'text ' || page_id END AS t, CASE WHEN page_id % 3 = 0 THEN 'extracted' WHEN page_id % 3 = 1 THEN 'failed' END AS again FROM p)
SELECT doc AS document_id, page AS pdf_page, CASE WHEN own = 'extracted' THEN t ELSE 'read ' || page_id END AS text, CASE WHEN own = 'extracted' THEN 'text_layer' ELSE 'ocr' END AS method FROM b WHERE own = 'extracted' AND trim(t) <> '' OR own = 'ocr_required' AND again = 'extracted'""")
def p5_effective_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text of each html page: its own, or what was read where that was asked for."""
    key = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", (key % 11).alias("document_id"), F.floor(key / 11).alias("pdf_page"))
    base = rows.select("document_id", "pdf_page", _pick(key, "ocr_required", "extracted", "empty", "extracted").alias("status"), F.when(key % 4 == 3, " ").otherwise(F.concat(F.lit("text "), key.cast("string"))).alias("normalized_text"))
    read = rows.where(key % 3 != 2).select("document_id", "pdf_page", _pick(key, "extracted", "failed", None).alias("status"), F.concat(F.lit("read "), key.cast("string")).alias("normalized_text"))
    return pages.effective_pages(base, read)


@query(rf"""
WITH {PAGE} SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'failed' WHEN page_id % 7 = 0 THEN 'visual_or_blank' WHEN page_id % 5 = 0 THEN 'pending' WHEN length(regexp_replace(body, '\s+', '', 'g')) < 20 OR page_id % 9 < 5 THEN 'low_text' ELSE 'completed' END AS route FROM p""")
def p8_ocr_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each html page goes after a reading."""
    key = F.col("page_id")
    body = T.compact(F.regexp_replace("html", "<[^>]*>", ""))
    status = F.when(key % 7 == 0, "empty").when(key % 5 == 0, "ocr_required").otherwise("extracted")
    return table(spark, sf_dir, "pages").select("page_id", T.ocr_route(status, F.length(body), key % 9, F.when(key % 13 == 0, "no engine")).alias("route"))


# Chronologies


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), f AS (SELECT o.*, f.n AS n FROM o, (VALUES (0), (1), (2)) f(n) WHERE n < 1 + k % 3)
SELECT k AS entry, string_agg(CAST(p AS VARCHAR), ',' ORDER BY pos) AS people FROM (SELECT k, c % 25 AS p, -1 AS pos FROM o UNION ALL SELECT k, (k + 7 * n) % 25, n FROM f WHERE (k + 7 * n) % 25 <> c % 25) GROUP BY k""")
def e8_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries that name one to three of 25 people, each book having a subject; forms that two people share name nobody."""
    key, digits = F.col("o_orderkey"), "甲乙丙丁戊己庚辛壬癸"
    name = lambda p: F.concat(F.lit("王"), F.translate(F.lpad(p.cast("string"), 2, "0"), "0123456789", digits))
    people = spark.range(25).select(F.col("id").alias("person_id"), name(F.col("id")).alias("name"))
    forms = people.select("person_id", F.col("name").alias("form")).unionByName(people.where("person_id < 2").select("person_id", F.lit("会议").alias("form")))
    said = F.array_join(F.transform(F.sequence(F.lit(0), (key % 3).cast("int")), lambda n: name((key + 7 * n) % 25)), "、")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("document_id"), key.alias("entry"), F.concat(F.lit("会议 上，与"), said, F.lit("谈话。")).alias("text"))
    subjects = people.select(F.col("person_id").alias("document_id"), "person_id", "name")
    found = chronology.participants(rows, forms, subjects)
    return found.select("entry", F.array_join(F.transform("participants", lambda p: p["person_id"].cast("string")), ",").alias("people"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders),
c AS (SELECT k, [CAST(0.12 AS DOUBLE), 0.15, 0.25, 0][k % 4 + 1] + [CAST(0 AS DOUBLE), 0.03, 0.08][k % 3 + 1] + CASE WHEN s = 'O' THEN CAST(0.08 AS DOUBLE) ELSE 0 END AS off FROM o)
SELECT k AS event_id, ['meeting', 'correspondence', 'visit', 'activity', 'military'][k % 5 + 1] AS event_type, ['北京；上海', '延安', '莫斯科', NULL, '太原'][k % 5 + 1] AS places, round(greatest(0.4, round(0.89 - off, 9)), 2) AS confidence FROM c""")
def e10_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, places and confidence of orders as entries in five wordings."""
    key = F.col("o_orderkey")
    text = _pick(key, "抵达北京，在上海举行会议。", "在延安工作，致电各地。", "赴莫斯科访问。", "休息。", "进驻太原，率部撤退。")
    flags = F.when(key % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(_pick(key, "multiple_dates", "inherited_date", "unknown_date", "")))
    methods = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("ocr"), F.lit("text_layer"))).otherwise(F.array(F.lit("text_layer")))
    confidence = chronology.confidence(F.lit(0.89), flags, _pick(key, "day", "month", "year"), methods)
    return table(spark, sf_dir, "orders").select(key.alias("event_id"), chronology.event_type(text).alias("event_type"), chronology.places(text).alias("places"), confidence.alias("confidence"))


# What is embedded


@query("""
SELECT doc_id, sha256(regexp_replace(coalesce(source, '') || chr(10) || coalesce(lang || ' > ' || 'p', '') || chr(10) || text, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS text_sha256 FROM documents""")
def v1_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what would be embedded of each document: its source as title, its language and a part as path, its text."""
    path = F.when(F.col("lang").isNotNull(), F.array(F.col("lang"), F.lit("p")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(stored.embedding_text(F.col("source"), path, F.col("text")), 256).alias("text_sha256"))
