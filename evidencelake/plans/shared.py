"""Queries on entries with relative dates, and on what two people share, over the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.operators import joint, segments
from evidencelake.operators.lineage import cut
from evidencelake.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y,
    row_number() OVER w + count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS page
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
q AS (SELECT *, coalesce(lead(page) OVER v = page + 1 AND lead(y) OVER v = y, false) AS goes_on, coalesce(lead(page) OVER v > page + 1, false) AS gap, lead(k) OVER v AS following FROM o WINDOW v AS (PARTITION BY doc ORDER BY page)),
l AS (SELECT *, CASE WHEN k % 5 = 4 THEN 1 ELSE 2 END + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS n FROM q),
e AS (SELECT *, unnest(range(1, n + 1)) AS i FROM l),
s AS (SELECT *, CASE WHEN i = 1 THEN 'own' WHEN i = 3 OR k % 5 = 4 THEN 'next' ELSE ['same', 'next', 'month', 'year'][k % 5 + 1] END AS kind FROM e),
t AS (SELECT *, CASE WHEN kind = 'own' OR kind = 'same' THEN strftime(d, '%Y-%m-%d') WHEN kind = 'month' THEN strftime(d, '%Y-%m') WHEN kind = 'year' THEN CAST(y AS VARCHAR)
    WHEN i = 3 AND k % 5 IN (2, 3) THEN CAST(y AS VARCHAR) WHEN i = 3 AND k % 5 = 1 THEN strftime(d + INTERVAL 2 DAY, '%Y-%m-%d') ELSE strftime(d + INTERVAL 1 DAY, '%Y-%m-%d') END AS start_value,
    CASE WHEN kind = 'own' THEN month(d) || '月' || day(d) || '日事' WHEN i = 3 OR k % 5 = 4 THEN '次日再' ELSE ['同日', '翌日', '本月', '本年'][k % 5 + 1] || '又' END || k AS told FROM s)
SELECT doc AS document_id, row_number() OVER (PARTITION BY doc ORDER BY page, i) AS entry, start_value, told || CASE WHEN i = n AND goes_on THEN '续' || following ELSE '' END AS body,
  CAST(CASE WHEN i = n AND goes_on THEN 2 ELSE 1 END AS BIGINT) AS pages,
  concat_ws(',', CASE WHEN k % 3 = 0 OR i = n AND goes_on AND following % 3 = 0 THEN 'footnotes_excluded' END, CASE WHEN i = n AND gap THEN 'page_gap' END) AS flags FROM t""")
def e6_split_date_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages, one each, with a date split over lines, days that refer to it, footnotes, and a page missing behind some."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    along = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gaps = F.count(F.when(F.col("o_orderstatus") == "P", 1)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    dated = F.concat(F.lit("\n"), F.month(day).cast("string"), F.lit("\n月 "), F.dayofmonth(day).cast("string"), F.lit("\n日 事"), key.cast("string"))
    word = F.get(F.array(*map(F.lit, ("同日", "翌日", "本月", "本年"))), (key % 5).cast("int"))
    more = F.when(key % 5 != 4, F.concat(F.lit("\n　"), word, F.lit(" 又"), key.cast("string"))).otherwise("")
    last = F.when(key % 4 == 0, F.concat(F.lit("\n次日 再"), key.cast("string"))).otherwise("")
    note = F.when(key % 3 == 0, "\n[1] 某人，1954年在任。\n同日 注文").otherwise("")
    placed = cut(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), (F.row_number().over(along) + gaps).alias("pdf_page"), "o_orderkey", "o_orderdate"))
    pages = placed.select("document_id", "pdf_page", F.concat(F.lit("12\n续"), key.cast("string"), dated, more, last, note).alias("text"), F.lit("ocr").alias("method"), F.year(day).alias("year"))
    found = segments.split_date_entries(pages, pages)
    return found.select("document_id", F.col("entry").cast("long").alias("entry"), F.col("date.start.value").alias("start_value"), F.regexp_replace("text", r"\s+", "").alias("body"), F.size("pages").cast("long").alias("pages"), F.array_join("flags", ",").alias("flags"))


#: Digits as characters that stand in names.
DIGITS = "甲乙丙丁戊己庚辛壬癸"


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS form, c_nationkey AS a FROM orders JOIN customer ON c_custkey = o_custkey),
g AS (SELECT k, form, a, list_sort(list_distinct(list(s_nationkey))) AS others FROM o JOIN lineitem ON l_orderkey = k JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
e AS (SELECT k, form, a, unnest(others) AS b FROM g),
-- whom each form names as actor, and whether one of a pair has to be that one
p AS (SELECT k, form, a AS x, b AS y, CASE WHEN form = 1 THEN '主持者' WHEN form = 5 THEN '共同出席者' ELSE '共同会见者' END AS xr, CASE WHEN form = 1 THEN '参会者' WHEN form = 5 THEN '共同出席者' ELSE '共同会见者' END AS yr FROM e WHERE form IN (0, 1, 2, 5) AND a <> b
  UNION SELECT e.k, e.form, e.b, f.b, CASE WHEN e.form = 1 THEN '参会者' WHEN e.form = 5 THEN '共同出席者' ELSE '共同会见者' END, CASE WHEN e.form = 1 THEN '参会者' WHEN e.form = 5 THEN '共同出席者' ELSE '共同会见者' END
    FROM e JOIN e f ON e.k = f.k AND e.b < f.b WHERE e.form IN (1, 2, 5) AND e.a <> e.b AND f.a <> f.b)
SELECT k AS event_id, CAST(least(x, y) AS BIGINT) AS first, CAST(greatest(x, y) AS BIGINT) AS second, CASE WHEN x < y THEN xr ELSE yr END AS first_role, CASE WHEN x < y THEN yr ELSE xr END AS second_role,
  CASE WHEN form = 2 THEN 'grouped_attendance' WHEN form = 5 THEN 'single_clause' ELSE 'adjacent_attendance' END AS method, form = 0 AS explicit FROM p""")
def x3_roster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as meetings: the customer's nation receives or chairs, the suppliers' nations attend, in five forms that tell of it and three that do not."""
    name = lambda c: F.translate(F.lpad(c.cast("string"), 2, "0"), "0123456789", DIGITS)
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("event_id"), name(F.col("c_nationkey")).alias("actor"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_set(name(F.col("s_nationkey")))), "、").alias("others"))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    actor, others = F.col("actor"), F.col("others")
    forms = [
        said("3月14日下午六时，", actor, "会见外国代表，同他们交谈。参加会见的有", others, "等。"),
        said("下午，主持召开扩大会议，讨论问题。出席会议的有：", others, "。"),
        said("去广场参加庆祝大会前，在某堂会见外宾。参加会见的，中方有", others, "，苏方有来宾。"),
        said(actor, "没有会见外国代表。参加会见的有", others, "。"),
        said(actor, "会见外国代表。次日参加会见的有", others, "。"),
        said("同日 和", others, "共同出席会议。"),
        said(actor, "说：“甲“乙”", actor, "、", others, "出席会议”。"),
        said(actor, "会见外国代表。参加会见的有", others, "的秘书。"),
    ]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(F.col("event_id") % 8 == i, form).otherwise(text)
    events = orders.join(lines, "event_id").select("event_id", text.alias("text"), F.when(F.col("event_id") % 8 != 0, actor).alias("subject"))
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("person_id"), name(F.col("n_nationkey")).alias("name"))
    names = [r["name"] for r in people.select("name").collect()]
    actions = joint.joint_actions(events, names).unionByName(joint.roster_actions(events, names))
    return joint.joint_pairs(actions, people).select("event_id", "first", "second", "first_role", "second_role", "method", (F.col("basis") == "explicit").alias("explicit"))


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS person_id FROM lineitem),
v AS (SELECT l_orderkey AS event_id, l_suppkey, l_linestatus || l_returnflag AS source, l_linenumber AS low, l_linenumber + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS high, l_partkey FROM lineitem),
f AS (SELECT v.* FROM v JOIN (SELECT event_id, source, min(low) AS least FROM v GROUP BY ALL) m USING (event_id, source) WHERE low = least AND high = least AND NOT contains(source, 'R')),
p AS (SELECT DISTINCT a.event_id, a.l_suppkey AS first, b.l_suppkey AS second, a.source || ':' || a.l_partkey || ':' || b.l_partkey AS proof FROM f a JOIN f b ON a.event_id = b.event_id AND a.source = b.source AND a.l_suppkey < b.l_suppkey),
g AS (SELECT event_id, first, second, string_agg(proof, ',' ORDER BY proof) AS proofs FROM p GROUP BY ALL),
r AS (SELECT s_suppkey AS request, s_suppkey AS person_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1 ELSE s_suppkey - 1 END AS other_id FROM supplier),
b AS (SELECT r.*, o_orderdate AS day, a.event_id, proofs FROM r JOIN e a ON a.person_id = r.person_id JOIN e c ON c.person_id = r.other_id AND c.event_id = a.event_id JOIN orders ON o_orderkey = a.event_id AND o_orderstatus <> 'F'
  LEFT JOIN g ON g.event_id = a.event_id AND first = least(r.person_id, r.other_id) AND second = greatest(r.person_id, r.other_id)),
t AS (SELECT request, count(proofs) AS total, count(*) AS co_mention_total FROM b GROUP BY request),
n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY day, event_id) AS place FROM b WHERE proofs IS NOT NULL)
SELECT r.request, r.person_id, r.other_id, coalesce(total, 0) AS total, coalesce(co_mention_total, 0) AS co_mention_total, coalesce(total, 0) > 3 AS has_more, place, event_id, proofs
FROM r LEFT JOIN t USING (request) LEFT JOIN (SELECT request, place, event_id, proofs FROM n WHERE place BETWEEN 2 AND 3) USING (request)""")
def x6_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every supplier shares with its neighbour: orders of both, proven where lines of both open a source that is not rejected; places two and three."""
    lines, neighbour = table(spark, sf_dir, "lineitem"), F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(-1)
    requests = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request"), F.col("s_suppkey").alias("person_id"), neighbour.alias("other_id"))
    events = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("day"))
    participants = lines.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("person_id"))
    low = F.col("l_linenumber")
    evidence = lines.select(F.col("l_orderkey").alias("event_id"), F.concat("l_linestatus", "l_returnflag").alias("source_event_id"), low.alias("pdf_page_start"), (low + (F.col("l_tax") > 0.06).cast("int")).alias("pdf_page_end"), F.col("l_suppkey").alias("person_id"), F.col("l_partkey").cast("string").alias("part"))
    opening = joint.first_pages(evidence).where(F.col("first_page") & ~F.contains("source_event_id", F.lit("R")))
    side = lambda who: opening.select("event_id", "source_event_id", F.col("person_id").alias(who), F.col("part").alias(f"{who}_part"))
    proven = side("first").join(side("second"), ["event_id", "source_event_id"]).where("first < second").select("event_id", "first", "second", F.concat_ws(":", "source_event_id", "first_part", "second_part").alias("proof"))
    found = joint.intersections(requests, events, participants, proven, [F.col("day")], offset=1, limit=2)
    return found.select("request", "person_id", "other_id", "total", "co_mention_total", "has_more", F.col("place").cast("long").alias("place"), "event_id", F.array_join(F.col("proofs.proof"), ",").alias("proofs"))
