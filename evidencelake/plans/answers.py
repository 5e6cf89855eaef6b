"""Queries on duplicate events of a month, quotes, extractive answers, batches, routes and reviews, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import answers, enrichment, evaluation, planning, resolve
from evidencelake.operators.lineage import cut
from evidencelake.plans.research import BIGRAMS
from evidencelake.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# Orders as events: of a day, or of a month for each fourth; two people, one document and its subject.
MONTHLY = rf"""ev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s, list_distinct([o_custkey % 50, o_custkey % 7]) AS ppl,
  o_orderkey % 7 AS doc, CASE WHEN o_totalprice > 250000 THEN 'visit' ELSE 'activity' END AS kind, o_orderpriority AS org, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS loc,
  lower(regexp_replace(o_orderpriority || o_orderstatus || CAST(o_custkey AS VARCHAR), '[^\p{{L}}\p{{N}}]', '', 'g')) AS x FROM orders),
e AS (SELECT *, {BIGRAMS('x')} AS g FROM ev),
j AS (SELECT l.id AS a, r.id AS b, CASE WHEN l.s = r.s AND length(l.s) = 10 THEN 'exact_day' WHEN l.s = r.s THEN 'same_value' ELSE 'same_month' END AS relation,
  CAST(len(list_intersect(l.g, r.g)) AS DOUBLE) AS i, len(l.g) AS n, len(r.g) AS m, list_intersect(l.ppl, r.ppl) AS sh, list_contains(sh, l.doc) AND list_contains(sh, r.doc) AS mutual, l.org = r.org AS org, coalesce(l.loc = r.loc, false) AS loc, l.kind = r.kind AND l.kind <> 'activity' AS kind
  FROM e l JOIN e r ON l.s[:7] = r.s[:7] AND l.id < r.id AND l.doc <> r.doc),
f AS (SELECT *, i / least(n, m) AS c, i / (n + m - i) AS k FROM j),
sc AS (SELECT a, b, relation, round(c, 6) AS containment, round(k, 6) AS jaccard, len(sh) AS shared, mutual, round(least(CAST(1 AS DOUBLE), CASE relation WHEN 'exact_day' THEN CAST(0.34 AS DOUBLE) WHEN 'same_value' THEN CAST(0.24 AS DOUBLE) ELSE CAST(0.18 AS DOUBLE) END
  + CAST(0.22 AS DOUBLE) * c + CAST(0.10 AS DOUBLE) * k + CAST(0.14 AS DOUBLE) * least(len(sh), 2) / CAST(2 AS DOUBLE) + CASE WHEN mutual THEN CAST(0.10 AS DOUBLE) ELSE 0 END + CASE WHEN org THEN CAST(0.04 AS DOUBLE) ELSE 0 END + CASE WHEN loc THEN CAST(0.03 AS DOUBLE) ELSE 0 END + CASE WHEN kind THEN CAST(0.03 AS DOUBLE) ELSE 0 END), 6) AS score FROM f)"""


CANDIDATES = "(relation = 'exact_day' AND (score >= 0.7 OR (containment >= 0.82 AND jaccard >= 0.55))) OR (relation <> 'exact_day' AND score >= 0.6 AND containment >= 0.8 AND jaccard >= 0.45 AND shared > 0 AND (mutual OR containment >= 0.9))"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    start = F.when(order % 4 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    document = F.array(order % 7)
    return table(spark, sf_dir, "orders").select(
        order.alias("event_id"),
        start.alias("start_value"),
        F.when(F.col("o_totalprice") > 250000, "visit").otherwise("activity").alias("event_type"),
        F.concat("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("description"),
        F.array(F.col("o_custkey") % 50, F.col("o_custkey") % 7).alias("people"),
        F.array("o_orderpriority").alias("organizations"),
        F.when(order % 3 == 0, F.col("o_orderstatus")).alias("location"),
        document.alias("documents"),
        document.alias("subjects"),
    )


@query(f"""
WITH {MONTHLY} SELECT a, b, relation, containment, jaccard, CAST(shared AS INT) AS shared, mutual, score FROM sc
WHERE {CANDIDATES}""")
def m7_month_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates among all events of each month, with every relation of dates and people."""
    return resolve.candidates(resolve.month_pairs(_monthly(spark, sf_dir))).drop("month")


@query(f"""
WITH RECURSIVE {MONTHLY}, k AS (SELECT * FROM sc WHERE {CANDIDATES}), g AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
t AS (SELECT a AS node, a AS other FROM g UNION SELECT t.node, g.b FROM t JOIN g ON g.a = t.other), co AS (SELECT node, min(other) AS component FROM t GROUP BY node),
m AS (SELECT component, node, s, ev.kind, ev.org, x, o_orderpriority || o_orderstatus || o_custkey AS description, o_totalprice > 100000 AS confirmed, o_orderkey % 3 <> 0 AS exact, round(o_totalprice / 1000000, 6) AS confidence FROM co JOIN ev ON ev.id = node JOIN orders ON o_orderkey = node),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY confirmed DESC, confidence DESC, exact DESC, kind <> 'activity' DESC, length(description), node DESC) AS n FROM m),
h AS (SELECT component, count(*) AS members, min(CASE WHEN n = 1 THEN node END) AS representative_id, count(DISTINCT kind) AS kinds, min(CASE WHEN n = 1 THEN kind END) AS own, bool_and(length(s) = 10) AS days, bool_or(exact) AS exact,
  array_to_string(list_sort(list_distinct(list(org))), ',') AS organizations FROM r GROUP BY component),
p AS (SELECT component, count(*) AS pairs, round(avg(score), 6) AS confidence, bool_and(relation = 'exact_day' AND score >= 0.8 AND containment >= 0.75 AND (mutual OR (containment >= 0.9 AND shared > 0))) AS sure FROM k JOIN co ON co.node = k.a GROUP BY component)
SELECT component, members, CASE WHEN members = 2 AND pairs = 1 AND sure AND days AND exact THEN 'high_confidence' ELSE 'uncertain' END AS candidate_kind, CASE WHEN members = 2 AND pairs = 1 AND sure AND days AND exact THEN 'unreviewed' ELSE 'needs_review' END AS review_status,
  representative_id, CASE WHEN kinds = 1 THEN own ELSE 'visit' END AS event_type, organizations, confidence FROM h JOIN p USING (component)""")
def m14_canonical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of the groups that the candidates of whole months make."""
    events = _monthly(spark, sf_dir)
    pairs = cut(resolve.candidates(resolve.month_pairs(events)))
    groups = cut(resolve.components_within(pairs, "month"))
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_totalprice") > 100000, "confirmed").otherwise("unreviewed").alias("review_status"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence"), F.when(F.col("o_orderkey") % 3 != 0, "exact").otherwise("inferred").alias("certainty"))
    named = events.withColumns({"name": F.col("description"), "end_value": F.lit(None).cast("string"), "precision": F.when(F.length("start_value") == 10, "day").otherwise("month")})
    members = groups.select("component", F.col("node").alias("event_id")).hint("merge").join(named, "event_id").hint("merge").join(facts, "event_id")
    found = resolve.canonical_candidates(members, pairs.hint("merge").join(groups.select(F.col("node").alias("a"), "component"), "a"), "v1")
    return found.select("component", "members", "candidate_kind", "review_status", "representative_id", "event_type", F.array_join(F.array_sort("organizations"), ",").alias("organizations"), "confidence")


SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"""
WITH d AS (SELECT doc_id, {SQUEEZED} AS t, CASE doc_id % 3 WHEN 0 THEN ['thin', 'erer'] WHEN 1 THEN ['zzzz', 'x'] ELSE ['sch', 'que'] END AS ws FROM documents),
c AS (SELECT *, coalesce(list_min(list_filter(list_transform(list_filter(ws, lambda w: length(w) >= 2), lambda w: instr(t, w) - 1), lambda i: i >= 0)), 0) AS ce FROM d),
w AS (SELECT *, greatest(ce - 180, 0) AS ws0 FROM c), s AS (SELECT *, ws0 + length(regexp_extract(substr(t, ws0 + 1, ce - ws0), '(?s)^.*[.!?;]')) AS st FROM w)
SELECT doc_id, CASE WHEN length(t) <= 420 THEN t ELSE CASE WHEN st > 0 THEN '……' ELSE '' END || substr(t, st + 1, 420) || CASE WHEN st + 420 < length(t) THEN '……' ELSE '' END END AS quote FROM s""")
def q7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of all documents around the first of two terms."""
    of = lambda *w: F.array(*map(F.lit, w))
    terms = F.when(F.col("doc_id") % 3 == 0, of("thin", "erer")).when(F.col("doc_id") % 3 == 1, of("zzzz", "x")).otherwise(of("sch", "que"))
    hits = table(spark, sf_dir, "documents").select("doc_id", "text", terms.alias("terms"), F.array().cast("array<string>").alias("people"))
    return answers.quotes(hits, "text", "people", "terms", ends=".!?;").select("doc_id", "quote")


@query(rf"""
WITH d AS (SELECT doc_id, {SQUEEZED} AS t FROM documents), s AS (SELECT *, greatest(instr(t, 'onthe') - 141, 0) AS st FROM d)
SELECT doc_id, CASE WHEN length(t) <= 560 THEN t ELSE CASE WHEN st > 0 THEN '……' ELSE '' END || substr(t, st + 1, 560) || CASE WHEN st + 560 < length(t) THEN '……' ELSE '' END END AS excerpt FROM s""")
def y15_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", answers.excerpt(F.col("text"), F.lit("onthe")).alias("excerpt"))


@query(r"""
WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn > 0),
s AS (SELECT *, list_filter(regexp_extract_all(text, '(?s)[^.!?;]*[.!?;]|[^.!?;]+$'), lambda p: length(trim(p, chr(32))) >= 12) AS ps FROM c WHERE n <= 5),
l AS (SELECT conv_id, turn, '- ' || CASE WHEN conv_id % 4 = 0 AND turn % 2 = 0 THEN '1935、1936年：' ELSE '' END || regexp_replace(trim(substr(coalesce(trim(ps[1], chr(32)), text), 1, 180), chr(32)), '^[…，、\s]+', '') || ' [E' || turn || ']' AS line FROM s),
a AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS lines FROM l GROUP BY conv_id), q AS (SELECT DISTINCT conv_id FROM conversations)
SELECT q.conv_id AS answer_id, CASE WHEN lines IS NULL THEN '现有本地资料中没有检索到足以回答这个问题的证据。' ELSE CASE WHEN q.conv_id % 4 = 0 THEN '根据当前本地资料，可先按以下史料线索梳理：' ELSE '根据当前本地资料，检索到以下可核验线索：' END || chr(10) || chr(10) || lines END AS answer FROM q LEFT JOIN a USING (conv_id)""")
def q9_extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later turns of a conversation as evidence for it."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "answer_id")
    questions = turns.select("answer_id").distinct().withColumn("intent", F.when(F.col("answer_id") % 4 == 0, "timeline").otherwise("general"))
    years = F.when(F.col("turn") % 2 == 0, F.array(F.lit(1935), F.lit(1936))).otherwise(F.array().cast("array<int>"))
    return answers.extractive(questions, turns.where("turn > 0").select("answer_id", F.col("turn").alias("number"), F.col("text").alias("quote"), years.alias("years")), ".!?;")


@query(r"""
WITH c AS (SELECT conv_id, turn, string_split(CASE WHEN turn % 2 = 0 THEN replace(text, ' the ', ' [E1] the ') ELSE '# ' || text END, chr(10)) AS ls FROM conversations),
k AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '\[E[0-9]+\]') OR regexp_matches(x, '^\s*#') OR length(trim(x, chr(32))) < 12) AS ks FROM c),
t AS (SELECT *, regexp_replace(regexp_replace(array_to_string(ks, chr(10)), '\n[ \t]*\n([ \t]*\n)+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS left_over FROM k)
SELECT conv_id, turn, CASE WHEN len(ks) < len(ls) AND left_over <> '' THEN left_over END AS answer FROM t""")
def q11_salvaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations without the lines that lack a mark."""
    text = F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit(" the "), F.lit(" [E1] the "))).otherwise(F.concat(F.lit("# "), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.salvaged(text).alias("answer"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)
SELECT o_custkey AS answer_id, o_orderkey AS number, CAST(ceil(n / 12) AS BIGINT) AS batch, CAST(ceil(m / 12) AS BIGINT) AS batches FROM r""")
def q16_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as evidence, twelve at a time."""
    return answers.batches(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("number")))


@query("""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 1900 + c_custkey % 40 END AS s, CASE WHEN c_custkey % 7 <> 0 THEN 1905 + c_custkey % 31 END AS e, c_custkey % 3 = 0 AS u, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'which' END AS q FROM customer)
SELECT c_custkey, CASE WHEN (s IS NULL) <> (e IS NULL) THEN 'incomplete_year_range' WHEN s > e THEN 'reversed_year_range' WHEN u AND trim(coalesce(q, '')) = '' THEN 'missing_clarification_question' END AS error FROM p""")
def q3_plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    clarification = F.when(key % 4 == 0, " ").when(key % 4 == 1, "which")
    error = planning.plan_error(F.when(key % 5 != 0, 1900 + key % 40), F.when(key % 7 != 0, 1905 + key % 31), key % 3 == 0, clarification)
    return table(spark, sf_dir, "customer").select("c_custkey", error.alias("error"))


MODES = "['structured_timeline', 'full_text_section', 'query_clarification', 'weighted_hybrid', 'keyword_only', 'vector', 'none']"


@query(f"""
WITH c AS (SELECT c_custkey AS case_id, ({MODES})[1 + c_custkey % 7] AS mode, CASE c_nationkey % 3 WHEN 0 THEN ['hybrid_retrieval'] WHEN 1 THEN ['structured_timeline', 'none'] ELSE [] END AS preferred FROM customer),
r AS (SELECT *, CASE WHEN mode LIKE '%hybrid%' OR mode LIKE '%keyword%' OR mode LIKE '%vector%' THEN 'hybrid_retrieval' ELSE mode END AS route FROM c)
SELECT case_id, route, CASE WHEN len(preferred) > 0 THEN list_contains(preferred, route) END AS route_match FROM r""")
def g12_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval modes of cases against their preferred routes."""
    of = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    modes = of("structured_timeline", "full_text_section", "query_clarification", "weighted_hybrid", "keyword_only", "vector", "none")
    preferred = F.when(F.col("c_nationkey") % 3 == 0, of("hybrid_retrieval")).when(F.col("c_nationkey") % 3 == 1, of("structured_timeline", "none")).otherwise(of())
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.get(modes, (F.col("c_custkey") % 7).cast("int")).alias("mode"), preferred.alias("preferred"))
    return evaluation.routing(cases).select("case_id", "route", "route_match")


ATTEMPTS = """a AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'needs_review' ELSE 'unreviewed' END AS st, least(value / 100.0, 1.0) AS confidence, CASE WHEN event_type = 'view' THEN 'activity' ELSE event_type END AS kind,
  CASE WHEN event_id % 11 <> 0 THEN event_id % 4 = 0 END AS asks, CASE WHEN event_id % 11 = 0 THEN 'timeout' END AS error, ts FROM events)"""


@query(f"""
WITH {ATTEMPTS} SELECT event_id, array_to_string(list_filter(['model_assisted', CASE WHEN st = 'needs_review' THEN 'source_needs_review' END, CASE WHEN confidence < 0.75 THEN 'low_rule_confidence' END, CASE WHEN kind = 'activity' THEN 'generic_rule_event_type' END,
  CASE WHEN asks THEN 'model_requested_review' END, CASE WHEN asks THEN 'model_unclear_date' END, error], lambda x: x IS NOT NULL), ',') AS reasons,
  CAST(CASE WHEN error IS NOT NULL THEN 90 WHEN asks THEN 70 ELSE 50 END AS INT) AS priority FROM a""")
def l6_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons and priorities of events that a model looked at; each eleventh attempt failed."""
    return _attempts(spark, sf_dir).select("event_id", F.array_join("reasons", ",").alias("reasons"), "priority")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    failed = key % 11 == 0
    asks = F.when(~failed, key % 4 == 0)
    kind = F.when(F.col("event_type") == "view", "activity").otherwise(F.col("event_type"))
    reasons = enrichment.review_reasons(
        F.when(key % 3 == 0, "needs_review").otherwise("unreviewed"), F.least(F.col("value") / 100.0, F.lit(1.0)), kind, asks, F.when(asks, F.array(F.lit("unclear_date"))), F.when(failed, "timeout")
    )
    priority = enrichment.attempt_priority(F.when(failed, "failed").otherwise("succeeded"), asks)
    return table(spark, sf_dir, "events").select(key, "ts", kind.alias("event_type"), reasons.alias("reasons"), priority.alias("priority"))


@query(f"""
WITH {ATTEMPTS}, q AS (SELECT *, CASE WHEN error IS NOT NULL THEN 90 WHEN asks THEN 70 ELSE 50 END AS p FROM a WHERE event_id % 2 = 1)
SELECT 'q' || event_id AS queue_id, event_id, kind AS event_type, CAST(p AS INT) AS priority, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS attempt_status FROM q ORDER BY p DESC, ts, 'q' || event_id LIMIT 50""")
def l7_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty pending rows that most need a look; even events are done."""
    tried, key = _attempts(spark, sf_dir), F.col("event_id")
    name = lambda p: F.concat(F.lit(p), key.cast("string"))
    queue = tried.select(name("q").alias("queue_id"), key, name("a").alias("source_attempt_id"), "priority", F.when(key % 2 == 1, "pending").otherwise("done").alias("status"), F.col("ts").alias("created_at"))
    attempts = tried.select(name("a").alias("attempt_id"), key, F.when(key % 11 == 0, "failed").otherwise("succeeded").alias("status"))
    listed = enrichment.review_queue(queue, tried.select("event_id", "event_type"), attempts, 50)
    return listed.select("queue_id", "event_id", "event_type", "priority", "attempt_status")
