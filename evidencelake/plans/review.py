"""Queries on canonical events, review, enrichment, manifests and windows over the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import enrichment, fusion, resolve
from evidencelake.plans.research import EVENTS, SCORED, _scored
from evidencelake.plans.retrieval import BRANCHES, _branches
from evidencelake.plans.tables import source_events, table
from evidencelake.sources import files, schemas
from evidencelake.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SCORED} SELECT a, b, score FROM sc WHERE score >= 0.7")
def m7_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one day with the least score; all of them share their person."""
    scored = _scored(spark, sf_dir).select("*", F.lit("exact_day").alias("relation"), F.lit(1).alias("shared"), F.lit(True).alias("mutual"))
    return resolve.candidates(scored).select("a", "b", "score")


COMPONENTS = f"""{SCORED}, g AS (SELECT a, b FROM sc WHERE score >= 0.85 UNION SELECT b, a FROM sc WHERE score >= 0.85),
t AS (SELECT a AS node, a AS other FROM g UNION SELECT t.node, g.b FROM t JOIN g ON g.a = t.other), co AS (SELECT node, min(other) AS component FROM t GROUP BY node)"""


@query(f"""
WITH RECURSIVE {COMPONENTS}, m AS (SELECT component, 'canonical_' || substr(sha256(string_agg(CAST(node AS VARCHAR), chr(31) ORDER BY node)), 1, 32) AS canonical_event_id, count(*) AS members,
  CASE WHEN count(DISTINCT event_type) = 1 THEN max(event_type) ELSE arg_max(event_type, (CASE review_status WHEN 'confirmed' THEN 3 WHEN 'unreviewed' THEN 2 WHEN 'needs_review' THEN 1 ELSE 0 END, confidence, -length(props), event_id)) END AS event_type FROM co JOIN ev ON event_id = node GROUP BY component),
p AS (SELECT component, round(avg(score), 6) AS score FROM sc JOIN co ON co.node = sc.a WHERE score >= 0.85 GROUP BY component)
SELECT component, canonical_event_id, members, event_type, score FROM m JOIN p USING (component)""")
def m14_canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _scored(spark, sf_dir).where("score >= 0.85")
    groups = resolve.components(pairs.select("a", "b"))
    members = groups.select("component", F.col("node").alias("event_id")).join(source_events(spark, sf_dir).withColumn("description", F.col("props")), "event_id")
    return resolve.canonical(members, pairs.join(groups.select(F.col("node").alias("a"), "component"), "a"))


@query(f"""
WITH ev AS ({EVENTS}), g AS (SELECT event_id, start_value AS grp, person_id, event_type AS mention, CASE WHEN event_id % 5 = 0 THEN 'subject' WHEN event_id % 5 = 1 THEN NULL ELSE 'other' END AS role, document_id AS source_rank FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, person_id, mention ORDER BY coalesce(role = 'subject', false) DESC, source_rank, (role IS NOT NULL) DESC, event_id) AS n FROM g) SELECT grp, person_id, mention, event_id, role FROM r WHERE n = 1""")
def m11_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants of all events of a day, one row of each."""
    role = F.when(F.col("event_id") % 5 == 0, "subject").when(F.col("event_id") % 5 == 1, F.lit(None)).otherwise("other")
    rows = source_events(spark, sf_dir).select("event_id", F.col("start_value").alias("grp"), "person_id", F.col("event_type").alias("mention"), role.alias("role"), F.col("document_id").alias("source_rank"))
    return resolve.participants(rows, "grp").select("grp", "person_id", "mention", "event_id", "role")


@query(f"""
WITH ev AS ({EVENTS}), q AS (SELECT start_value, min(event_id) AS first_event, count(*) AS members, max(CAST(least(90, 55 + round_even((1 - confidence) * 50, 0)) AS INT)) AS priority FROM ev WHERE review_status = 'unreviewed' GROUP BY start_value)
SELECT start_value, first_event, members, priority FROM q ORDER BY priority DESC, members DESC, start_value LIMIT 10""")
def m17_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten days that most need a review, with their events."""
    rows = source_events(spark, sf_dir).where("review_status = 'unreviewed'").withColumn("priority", resolve.review_priority(F.col("confidence")))
    grouped = rows.groupBy("start_value").agg(F.min("event_id").alias("first_event"), F.count("*").alias("members"), F.max("priority").alias("priority"))
    return grouped.orderBy(F.desc("priority"), F.desc("members"), "start_value").limit(10)


@query(f"""
WITH ev AS ({EVENTS}) SELECT event_id, round(confidence, 6) AS confidence FROM ev WHERE review_status IN ('unreviewed', 'needs_review') AND (confidence < 0.75) AND event_id % 3 <> 0 ORDER BY confidence, event_id LIMIT 50""")
def l1_enrichment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty least sure events that no attempt has looked at; every third one was tried."""
    events = source_events(spark, sf_dir).withColumn("request_hash", T.stable_id("event_id", "props"))
    return enrichment.candidates(events, events.where("event_id % 3 = 0"), 50).select("event_id", F.round("confidence", 6).alias("confidence"))


@query("""
WITH r AS (SELECT conv_id AS event_id, turn AS seq, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations)
SELECT event_id, seq, md5(substr(text, 1, CAST(1200 - used AS BIGINT))) AS quote_md5 FROM r WHERE used < 1200""")
def l2_bounded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event_id"), F.col("turn").alias("seq"), F.col("text").alias("quote"))
    return enrichment.bounded_evidence(rows).select("event_id", "seq", F.md5("quote").alias("quote_md5"))


@query(f"""
WITH {BRANCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_rrf, 8) DESC, id) AS rank FROM f), k AS (SELECT * FROM r WHERE rank <= 10)
SELECT query_id, CASE WHEN NOT bool_or(keyword_rank IS NOT NULL) THEN 'no_evidence' WHEN bool_or(rank <= 5 AND keyword_rank IS NOT NULL AND vector_rank IS NOT NULL) THEN 'supported' ELSE 'partial' END AS status FROM k GROUP BY query_id""")
def q8_evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.evidence_status(fusion.fuse(*_branches(spark, sf_dir, 100), 10))


@query("""
WITH o AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1), f AS (SELECT o_custkey, 'h' || last AS sha256, last AS size_bytes FROM o WHERE o_custkey % 4 <> 0)
SELECT c_custkey AS document_id, c_name AS title, c_mktsegment || '; ' || c_nationkey AS tags, sha256, size_bytes FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def s9_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their last order as the current file."""
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"))
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.max("o_orderkey").alias("size_bytes"))
    held = last.select("document_id", F.concat(F.lit("h"), F.col("size_bytes").cast("string")).alias("sha256"), "size_bytes", (F.col("document_id") % 4 != 0).alias("is_current"), F.lit(True).alias("is_present"))
    return files.manifest(documents, held)


@query("SELECT user_id, event_id AS run_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def s10_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts").alias("finished_at"))
    return files.latest_run(runs, "user_id").select("user_id", "run_id", "status")


@query("""
SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def s11_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that break one of two rules."""
    return schemas.violations(table(spark, sf_dir, "orders"), "o_orderkey", {"price": F.col("o_totalprice") <= 300000, "status": F.col("o_orderstatus") != "P"})


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streaming_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregation of the stream over the table as a whole."""
    rows = ingest.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", "total")
