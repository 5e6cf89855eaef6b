"""Queries on appointments, tenure and chronology entries over the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import chronology, positions
from evidencelake.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""
WITH p AS (SELECT o_custkey % 200 AS person, CASE o_orderkey % 4 WHEN 0 THEN '外交部' WHEN 1 THEN '国务院' WHEN 2 THEN '国防部' ELSE '学校' END AS org, CASE o_orderkey % 4 WHEN 0 THEN '部长' WHEN 1 THEN '副总理' WHEN 2 THEN '委员' ELSE '校长' END AS role,
  strftime(o_orderdate, '%Y-%m') AS s, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 4),
u AS (SELECT person, org, role, s, k FROM p UNION ALL SELECT person, '中共中央', '书记', s, k FROM p WHERE k % 5 = 3)
SELECT 'p' || person AS person_id, org AS organization, role, s AS start_value, array_to_string(list_sort(list_distinct(list(k))), ',') AS events FROM u WHERE org <> '学校' GROUP BY ALL""")
def o3_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events that appoint a customer; some are wishes, some hold two posts, some name no organisation."""
    key = F.col("o_orderkey")
    post = F.when(key % 4 == 0, "外交部部长").when(key % 4 == 1, "国务院副总理").when(key % 4 == 2, "国防部委员").otherwise("学校校长")
    told = F.when(key % 5 == 4, F.concat(F.lit("会议建议由张三担任"), post)).when(key % 5 == 3, F.concat(F.lit("张三 被任命为"), post, F.lit("并兼任中共中央书记，到任。"))).when(key % 5 == 2, F.concat(F.lit("决定由张三担任"), post, F.lit("并出席会议"))).when(key % 5 == 1, F.concat(F.lit("当选为"), post)).otherwise(F.concat(F.lit("会上，张三任"), post, F.lit("。")))
    mentions = table(spark, sf_dir, "orders").select(
        key.alias("event_id"),
        F.when(key % 5 == 1, "appointment").otherwise("meeting").alias("event_type"),
        F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("unreviewed").alias("review_status"),
        told.alias("description"),
        F.date_format("o_orderdate", "yyyy-MM").alias("start_value"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 200).cast("string")).alias("person_id"),
        F.lit("张三").alias("mention"),
        key.alias("evidence_id"),
    )
    held = positions.relationships(mentions)
    return held.select("person_id", "organization", "role", "start_value", F.array_join(F.transform("event_ids", lambda e: e.cast("string")), ",").alias("events"))


@query("""
WITH r AS (SELECT o_orderkey AS id, o_custkey AS person, CASE o_orderkey % 5 WHEN 0 THEN 'led' WHEN 1 THEN 'met' ELSE 'held_position' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'needs_review' ELSE 'rejected' END AS st,
  o_orderdate AS lo, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAY ELSE last_day(o_orderdate) END AS hi FROM orders WHERE o_orderkey % 7 <> 0),
k AS (SELECT r.*, strftime(lo, '%Y-%m') AS s FROM r WHERE kind <> 'met' AND st <> 'rejected' AND date_trunc('month', lo) <= DATE '1996-06-30' AND hi >= DATE '1996-06-01'),
e AS (SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS evidence FROM lineitem GROUP BY 1),
n AS (SELECT k.*, evidence, row_number() OVER (PARTITION BY person ORDER BY s, id) AS place, count(*) OVER (PARTITION BY person) AS total FROM k JOIN e USING (id))
SELECT person AS person_id, id AS relation_id, s AS start_value, evidence, place, total, total > 2 AS has_more FROM n WHERE place <= 2""")
def o6_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as positions held in June 1996, two a page, with their parts as evidence."""
    key = F.col("o_orderkey")
    relations = table(spark, sf_dir, "orders").select(
        key.alias("relation_id"),
        F.col("o_custkey").alias("person_id"),
        F.when(key % 5 == 0, "led").when(key % 5 == 1, "met").otherwise("held_position").alias("relation_type"),
        F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("rejected").alias("review_status"),
        F.when(key % 7 != 0, F.col("o_orderpriority")).alias("organization"),
        F.date_format("o_orderdate", "yyyy-MM").alias("start_value"),
        F.when(key % 3 == 0, F.date_format(F.date_add(F.to_date("o_orderdate"), 400), "yyyy-MM-dd")).alias("end_value"),
    )
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relation_id"), F.col("l_partkey").alias("evidence_id"))
    rows = positions.tenure(relations, evidence, "1996-06", limit=2)
    return rows.select("person_id", "relation_id", "start_value", F.array_join(F.transform("evidence_ids", lambda e: e.cast("string")), ",").alias("evidence"), F.col("place").cast("long").alias("place"), F.col("total").cast("long").alias("total"), "has_more")


@query("""
WITH o AS (SELECT o_custkey AS doc, year(o_orderdate) AS y, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS half, o_orderkey AS k, o_orderdate AS d, o_orderkey % 3 <> 0 AS labelled FROM orders),
w AS (SELECT *, count(*) FILTER (labelled) OVER (PARTITION BY doc, y ORDER BY half, k) AS n FROM o),
g AS (SELECT doc, y, n, min(CASE WHEN labelled THEN strftime(d, '%Y-%m-%d') END) AS start_value, string_agg('事' || k, '' ORDER BY half, k) AS body, count(DISTINCT half) AS pages FROM w WHERE n > 0 GROUP BY ALL)
SELECT doc AS document_id, row_number() OVER (PARTITION BY doc ORDER BY y, n) AS entry, start_value, body, pages FROM g""")
def e5_line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a chronology: a page for each half of a year, two in three lines with a date."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    label = F.when(key % 3 != 0, F.concat(F.month(day).cast("string"), F.lit("月 "), F.dayofmonth(day).cast("string"), F.lit("日　"))).otherwise("")
    line = F.concat(label, F.lit("事"), key.cast("string"))
    page = F.year(day) * 10 + F.when(F.month(day) <= 6, 1).otherwise(2)
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id"), page.alias("pdf_page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit("年谱\n"), F.col("pdf_page").cast("string").substr(1, 4), F.lit("年 三十岁\n12\n"), F.col("body"))
    pages = grouped.select("document_id", "pdf_page", head.alias("text"), F.lit("text_layer").alias("method"))
    repeated = pages.select("document_id", F.lit("年谱").alias("line")).distinct()
    years = pages.select("document_id", "pdf_page", F.floor(F.col("pdf_page") / 10).cast("int").alias("year"))
    found = chronology.line_entries(chronology.prepared(pages, repeated, "lin"), years)
    return found.select("document_id", F.col("entry").cast("long").alias("entry"), F.col("date.start.value").alias("start_value"), F.regexp_replace("text", r"\s+", "").alias("body"), F.size("pages").cast("long").alias("pages"))
