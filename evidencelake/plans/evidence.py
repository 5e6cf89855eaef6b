"""Queries on structures by years, citations and judgements over the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import corpus, evaluation
from evidencelake.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""
WITH p AS (SELECT o_custkey AS d, CAST(o_orderkey AS INT) AS page, 1900 + (year(o_orderdate) - 1990) AS y FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT d, y, min(page) AS start FROM p GROUP BY ALL),
e AS (SELECT *, lead(start) OVER (PARTITION BY d ORDER BY start) - 1 AS stop, 1000000 AS last FROM f)
SELECT d AS document_id, y || '年' AS title, start, CAST(greatest(start, coalesce(stop, last)) AS INT) AS "end" FROM e""")
def c6_year_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages, two in three with the heading of a year and one with leaders."""
    year = F.concat((F.year("o_orderdate") - 90).cast("string"), F.lit("年（三岁）"))
    head = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("正文\n"), year)).otherwise(F.concat(year, F.lit("……3")))
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").cast("int").alias("pdf_page"), head.alias("text"))
    return corpus.year_structure(pages, pages.select("document_id").distinct().withColumn("pages", F.lit(1_000_000)))


@query("""
WITH c AS (SELECT o_custkey % 300 AS case_id, o_orderkey AS number, 'd' || o_custkey % 10 AS doc, CAST(o_orderkey % 50 AS INT) AS s, CAST(o_orderkey % 50 + o_orderkey % 3 AS INT) AS e, 'passage of words number ' || o_orderkey % 50 AS q FROM orders),
g AS (SELECT DISTINCT c_custkey % 400 AS case_id, 'd' || c_custkey % 10 AS doc, CAST(c_custkey % 45 AS INT) AS page FROM customer), pg AS (SELECT 'd' || d AS doc, CAST(p AS INT) AS page, 'Passage of words, number ' || p || '.' AS text FROM range(10) a(d), range(50) b(p) WHERE p % 7 <> 3),
x AS (SELECT c.*, unnest(range(s, e + 1)) AS page FROM c), r AS (SELECT x.*, pg.text, g.page IS NOT NULL AS rel FROM x LEFT JOIN pg USING (doc, page) LEFT JOIN g USING (case_id, doc, page)),
k AS (SELECT case_id, number, bool_or(coalesce(page = s AND text IS NOT NULL, false)) AS hit, bool_and(text IS NOT NULL) AS ex, bool_or(rel) AS rel FROM r GROUP BY ALL),
m AS (SELECT case_id, count(*) AS citations, round(avg(CAST(ex AS INT)), 6) AS validity, round(avg(CAST(rel AS INT)), 6) AS precision FROM k GROUP BY 1),
t AS (SELECT g.case_id, round(avg(CASE WHEN x.page IS NULL THEN CAST(0 AS DOUBLE) ELSE 1 END), 6) AS recall FROM g LEFT JOIN (SELECT DISTINCT case_id, doc, page FROM x) x USING (case_id, doc, page) GROUP BY 1)
SELECT case_id, coalesce(citations, 0) AS citations, validity, precision, recall FROM m FULL JOIN t USING (case_id)""")
def g10_citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as citations of customers' cases, on pages of which some are missing."""
    key, doc = F.col("o_orderkey"), lambda c: F.concat(F.lit("d"), (F.col(c) % 10).cast("string"))
    start = (key % 50).cast("int")
    citations = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("case_id"), key.alias("number"), doc("o_custkey").alias("document_id"), start.alias("start"), (start + key % 3).cast("int").alias("end"), F.concat(F.lit("passage of words number "), start.cast("string")).alias("quote"))
    gold = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 400).alias("case_id"), doc("c_custkey").alias("document_id"), (F.col("c_custkey") % 45).cast("int").alias("page"))
    numbered = spark.range(500).select(F.concat(F.lit("d"), F.floor(F.col("id") / 50).cast("string")).alias("document_id"), (F.col("id") % 50).cast("int").alias("page"))
    pages = numbered.where("page % 7 <> 3").withColumn("text", F.concat(F.lit("Passage of words, number "), F.col("page").cast("string"), F.lit(".")))
    found = evaluation.citation_metrics(citations, gold, pages)
    return found.select("case_id", "citations", *(F.round(c, 6).alias(c) for c in ("validity", "precision", "recall")))


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'pass' ELSE 'fail' END AS v, CASE turn % 4 WHEN 0 THEN [] WHEN 1 THEN [substr(text, 5, 20)] ELSE ['no such claim 0123'] END AS cl, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN v = 'pass' AND len(cl) > 0 THEN 'passing_with_claims' WHEN v = 'fail' AND len(cl) = 0 THEN 'failing_without_claims'
  WHEN len(list_filter(cl, lambda x: NOT contains(a, lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))))) > 0 THEN 'claim_not_in_answer' END AS error FROM c""")
def y27_judgement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as answers, and judgements on them."""
    turn = F.col("turn")
    claims = F.when(turn % 4 == 0, F.array().cast("array<string>")).when(turn % 4 == 1, F.array(F.substring("text", 5, 20))).otherwise(F.array(F.lit("no such claim 0123")))
    error = evaluation.judgment_error(F.when(turn % 3 == 0, "pass").otherwise("fail"), claims, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", error.alias("error"))
