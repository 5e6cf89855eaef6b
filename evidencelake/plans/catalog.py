"""Queries on catalogs, children, congress hits and gold relevance over the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import catalog as C
from evidencelake.operators import congress
from evidencelake.plans.research import EVENTS
from evidencelake.plans.tables import source_events, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_ORDINALS = "[" + ", ".join(f"'{o}'" for o in congress.ORDINALS) + "]"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _ordinal(number: str):
    return F.element_at(F.array(*map(F.lit, congress.ORDINALS)), F.expr(number).cast("int"))


@query(f"""
WITH n AS (SELECT n_nationkey, {_ORDINALS} AS o, CAST(1 + n_nationkey % 20 AS INT) AS a, CAST(1 + n_regionkey * 7 % 20 AS INT) AS b FROM nation)
SELECT n_nationkey, array_to_string(list_transform(CASE WHEN a <= b THEN range(a, b + 1) ELSE list_reverse(range(b, a + 1)) END, lambda i: o[i])
  || CASE WHEN 20 BETWEEN least(a, b) AND greatest(a, b) THEN [] ELSE ['二十'] END, ',') AS ordinals FROM n""")
def h2_congress_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of questions on a range of congresses and the twentieth."""
    question = F.concat(F.lit("从中共"), _ordinal("1 + n_nationkey % 20"), F.lit("大至 中共第"), _ordinal("1 + n_regionkey * 7 % 20"), F.lit("大，和中共二十大"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(congress.ordinals(question), ",").alias("ordinals"))


HITS = f"""hits AS (SELECT source AS question, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank,
  CASE WHEN doc_id % 4 = 0 THEN '党的第' || {_ORDINALS}[1 + doc_id % 6] || '次全国代表大会' ELSE '其他' END AS section,
  '第' || {_ORDINALS}[1 + doc_id % 5] || '次全国代表大会' || CASE WHEN doc_id % 3 = 0 THEN '召开' ELSE '' END AS text,
  CASE WHEN doc_id % 7 = 0 THEN 'official_history' ELSE 'memoir' END AS source_type FROM documents)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    section = F.when(F.expr("doc_id % 4 = 0"), F.concat(F.lit("党的第"), _ordinal("1 + doc_id % 6"), F.lit("次全国代表大会"))).otherwise("其他")
    text = F.concat(F.lit("第"), _ordinal("1 + doc_id % 5"), F.lit("次全国代表大会"), F.when(F.expr("doc_id % 3 = 0"), "召开").otherwise(""))
    kind = F.when(F.expr("doc_id % 7 = 0"), "official_history").otherwise("memoir")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("question"), F.col("doc_id").alias("chunk_id"), rank.alias("rank"), section.alias("section"), text.alias("text"), kind.alias("source_type"))


BEST = f"""{HITS}, m AS (SELECT h.*, ordinal, contains(section, '第' || ordinal || '次全国代表大会') AS heading, contains(text, '第' || ordinal || '次全国代表大会') AS body
  FROM hits h, (SELECT unnest(['一', '二', '六', '七']) AS ordinal)),
best AS (SELECT question, ordinal, chunk_id FROM m WHERE heading OR body QUALIFY row_number() OVER (PARTITION BY question, ordinal
  ORDER BY heading DESC, body DESC, contains(text, '召开') DESC, (source_type = 'official_history') DESC, rank) = 1)"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.col("source").alias("question")).distinct().withColumn("ordinals", congress.ordinals(F.lit("中共一大到中共二大、中共六大与中共第七大")))
    return congress.best_hits(_hits(spark, sf_dir), asked)


@query(f"WITH {BEST} SELECT question, ordinal, chunk_id FROM best")
def h9_best_congress_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@query(f"""
WITH {BEST}, f AS (SELECT question, chunk_id, min(list_position({_ORDINALS}, ordinal)) AS rank FROM best GROUP BY ALL),
o AS (SELECT question, chunk_id, min((part, rank)) AS place FROM (SELECT question, chunk_id, 0 AS part, rank FROM f UNION ALL SELECT question, chunk_id, 1, rank FROM hits WHERE rank <= 24) GROUP BY ALL)
SELECT question, chunk_id, row_number() OVER (PARTITION BY question ORDER BY place, chunk_id) AS rank FROM o""")
def h11_congress_hits_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each congress in front of the first 24 hits."""
    place = F.array_position(F.array(*map(F.lit, congress.ORDINALS)), F.col("ordinal"))
    front = _best(spark, sf_dir).groupBy("question", "chunk_id").agg(F.min(place).alias("rank"))
    return congress.prepended(front, _hits(spark, sf_dir).where("rank <= 24"))


@query("""
SELECT conv_id, CASE WHEN k AND v THEN 'hybrid' WHEN k THEN 'keyword_only' WHEN v THEN 'vector_only' ELSE 'error' END AS mode
FROM (SELECT conv_id, max(turn) >= 2 AS k, bool_or(length(text) > 200) AS v FROM conversations GROUP BY conv_id)""")
def h12_branch_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") >= 2).alias("k"), F.bool_or(F.length("text") > 200).alias("v"))
    return branches.select("conv_id", congress.branch_mode(F.col("k"), F.col("v")).alias("mode"))


EVIDENCE = "ee AS (SELECT event_id, event_id * 10 + j AS evidence_id, (event_id + j) % 7 AS document_id, event_id % 50 AS page FROM events, (SELECT unnest([1, 2]) AS j) WHERE event_id % 4 <> 0)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_id % 4 <> 0").select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("j"))
    return events.select("event_id", F.expr("event_id * 10 + j").alias("evidence_id"), F.expr("(event_id + j) % 7").alias("document_id"), F.expr("event_id % 50").alias("page"))


@query(f"""
WITH ev AS ({EVENTS}), {EVIDENCE}, k AS (SELECT event_id, list_sort(list(DISTINCT evidence_id)) AS e, list_sort(list(DISTINCT document_id)) AS d FROM ee WHERE document_id NOT IN (3, 4) GROUP BY event_id)
SELECT event_id, person_id, array_to_string(e, ',') AS evidence, array_to_string(d, ',') AS documents FROM ev JOIN k USING (event_id) WHERE review_status <> 'rejected'""")
def m1_source_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with evidence in five of seven documents."""
    documents = spark.range(7).select(F.col("id").alias("document_id")).where("document_id NOT IN (3, 4)")
    rows = C.source_load(source_events(spark, sf_dir), _evidence(spark, sf_dir), documents)
    return rows.select("event_id", "person_id", F.array_join(F.col("evidence_ids").cast("array<string>"), ",").alias("evidence"), F.array_join(F.col("document_ids").cast("array<string>"), ",").alias("documents"))


GROUPS = "g AS (SELECT user_id AS component, CAST(count(*) AS BIGINT) AS pairs, round(max(value) / 1000, 6) AS confidence, CASE WHEN count(*) % 2 = 0 THEN 'high_confidence' ELSE 'uncertain' END AS kind FROM events GROUP BY user_id)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("component")).agg(n.alias("pairs"), F.round(F.max("value") / 1000, 6).alias("confidence"), F.when(n % 2 == 0, "high_confidence").otherwise("uncertain").alias("kind"))


@query(f"""
WITH {GROUPS} SELECT CAST(7 AS BIGINT) AS source_events, CAST(9 AS BIGINT) AS compared_pairs, CAST(sum(pairs) AS BIGINT) AS candidate_pairs, count(*) AS candidate_groups,
  count(*) FILTER (kind = 'high_confidence') AS high_confidence_groups, count(*) FILTER (kind <> 'high_confidence') AS uncertain_groups FROM g""")
def m19_merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_summary(_groups(spark, sf_dir), 7, 9)


@query(f"WITH {GROUPS} SELECT component, pairs, confidence, kind FROM g ORDER BY confidence DESC, component LIMIT 12")
def m19_merge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_samples(_groups(spark, sf_dir))


@query(f"""
WITH {EVIDENCE}, p AS (SELECT event_id AS record_id, string_agg(person || '/' || mention || '/' || c_name, ';' ORDER BY person, mention) AS people
  FROM (SELECT DISTINCT event_id, user_id AS person, event_type AS mention FROM events) JOIN customer ON c_custkey = person GROUP BY 1),
e AS (SELECT event_id AS record_id, string_agg(document_id || '/' || page || '/' || evidence_id, ';' ORDER BY (event_id + evidence_id) % 2 <> 0, document_id, page, evidence_id) AS evidence FROM ee GROUP BY 1)
SELECT event_id AS record_id, coalesce(people, '') AS people, coalesce(evidence, '') AS evidence FROM events LEFT JOIN p ON p.record_id = event_id LEFT JOIN e ON e.record_id = event_id""")
def t7_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants and evidence of all events."""
    events, customer = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    people = events.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("person_id"), F.col("event_type").alias("mention_text")).distinct()
    evidence = _evidence(spark, sf_dir).select(F.col("event_id").alias("record_id"), F.col("event_id").alias("source_event_id"), "evidence_id", "document_id", "page", F.when(F.expr("(event_id + evidence_id) % 2 = 0"), "s").alias("subject_id"))
    rows = C.with_children(events.select(F.col("event_id").alias("record_id")), people, customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name")), evidence, "s")
    text = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *(x[f].cast("string") for f in fields))), ";").alias
    return rows.select("record_id", text("participants", "person_id", "mention_text", "name")("people"), text("evidence", "document_id", "page", "evidence_id")("evidence"))


@query(f"WITH ev AS ({EVENTS}) SELECT CASE review_status WHEN 'confirmed' THEN 'confirmed' WHEN 'needs_review' THEN 'pending_review' ELSE 'automatic' END AS level, count(*) AS events FROM ev GROUP BY 1")
def t8_verification_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_events(spark, sf_dir).groupBy(C.verification_level(F.col("review_status")).alias("level")).agg(F.count("*").alias("events"))


@query("""
SELECT o_custkey AS person_id, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_custkey % 5 = 0 THEN 'merged' ELSE 'active' END AS state,
  CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 10 = 0 THEN 'unknown' ELSE CAST(c_custkey - 1 AS VARCHAR) END AS use_person_id
FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def t9_merged_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    persons = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(key.cast("string").alias("person_id"), F.when(key % 5 == 0, "merged").otherwise("active").alias("status"), F.when((key % 5 == 0) & (key % 10 != 0), (key - 1).cast("string")).alias("merged_into"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("person_id")).distinct()
    return C.active_person(asked, persons).select(F.col("person_id").cast("long").alias("person_id"), "state", "use_person_id")


@query("""
WITH cur AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(cur.k, new.k) AS person_id, coalesce(new.name, cur.name) AS name, coalesce(new.seg, cur.seg) AS segment, new.k IS NOT NULL AS is_active,
  CASE WHEN cur.k IS NULL THEN 'created' WHEN new.k IS NULL THEN 'deactivated' WHEN cur.seg = new.seg THEN 'kept' ELSE 'updated' END AS action FROM cur FULL JOIN new ON cur.k = new.k""")
def r2_sync_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = rows.where("person_id % 4 <> 0").withColumn("segment", F.when(F.col("person_id") % 7 == 0, "MOVED").otherwise(F.col("segment")))
    return C.sync_catalog(rows.where("person_id % 3 <> 0"), new, ["person_id"], ["name", "segment"])


@query("""
WITH cur AS (SELECT DISTINCT p_brand AS b, 'of ' || p_brand AS m FROM part), new AS (SELECT DISTINCT p_brand AS b, 'OF ' || p_brand AS m FROM part WHERE p_size > 48)
SELECT cur.b AS relation, coalesce(new.m, cur.m) AS label, new.b IS NOT NULL AS is_active, CASE WHEN new.b IS NULL THEN 'deactivated' WHEN new.m = cur.m THEN 'kept' ELSE 'updated' END AS action FROM cur LEFT JOIN new ON cur.b = new.b""")
def r3_sync_relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    current = part.select(F.col("p_brand").alias("relation"), F.concat(F.lit("of "), "p_brand").alias("label")).distinct()
    new = part.where("p_size > 48").select(F.col("p_brand").alias("relation"), F.concat(F.lit("OF "), "p_brand").alias("label")).distinct()
    return C.sync_catalog(current, new, ["relation"], ["label"])


@query("""
WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT o_custkey AS source_id, t AS target_id, o_custkey IN (SELECT k FROM a) AND t IN (SELECT k FROM a) AND o_custkey <> t AS accepted
FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey % 50 AS BIGINT) AS t FROM orders)""")
def r5_merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_acctbal") > 0, "active").otherwise("merged").alias("status"))
    proposals = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.expr("o_orderkey % 50").cast("long").alias("target_id")).distinct()
    return C.merge_proposals(proposals, persons)


@query("SELECT o_orderkey AS hit, o_custkey % 10 AS document_id, CAST(unnest(range(o_orderkey % 40, o_orderkey % 40 + o_custkey % 4 + 1)) AS INT) AS page FROM orders")
def g2_hit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("o_orderkey % 40").cast("int")
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hit"), F.expr("o_custkey % 10").alias("document_id"), start.alias("start"), (start + F.expr("o_custkey % 4").cast("int")).alias("end"))
    return C.hit_pages(hits)


@query("""
SELECT l_orderkey, l_partkey, CAST(max(r) AS INT) AS relevance FROM (SELECT l_orderkey, l_partkey, 2 AS r FROM lineitem WHERE l_quantity > 40
  UNION ALL SELECT l_orderkey, l_partkey, CAST(1 + l_linenumber % 2 AS INT) FROM lineitem WHERE l_discount < 0.05) GROUP BY 1, 2""")
def g3_known_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return C.known_relevance(rows.where("l_quantity > 40"), rows.where("l_discount < 0.05").withColumn("relevance", F.expr("1 + l_linenumber % 2")), ["l_orderkey", "l_partkey"])


@query("""
WITH s AS (SELECT n_nationkey AS d, 1 AS level, 'outline ' || n_name AS title, 1 AS a, 5 AS b, 'outline' AS source, 0 AS p FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT n_nationkey, 2, 'year ' || y, 1 + y % 5, 9, 'year_heading', 1 FROM nation, (SELECT unnest([1949, 1950]) AS y) WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 1, n_name, 1, 10 + n_nationkey, 'document_root', 2 FROM nation)
SELECT d AS document_id, CAST(level AS INT) AS level, title, CAST(a AS INT) AS start, CAST(b AS INT) AS "end", source FROM s QUALIFY p = min(p) OVER (PARTITION BY d)""")
def c7_structure_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents, some with an outline, some with headings of years."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").alias("document_id")
    outline = nation.where("n_nationkey % 3 = 0").select(key, F.lit(1).alias("level"), F.concat(F.lit("outline "), "n_name").alias("title"), F.lit(1).alias("start"), F.lit(5).alias("end"), F.lit("outline").alias("source"))
    dated = nation.where("n_nationkey % 2 = 0").withColumn("y", F.explode(F.array(F.lit(1949), F.lit(1950))))
    years = dated.select(key, F.lit(2).alias("level"), F.concat(F.lit("year "), F.col("y").cast("string")).alias("title"), (1 + F.col("y") % 5).cast("int").alias("start"), F.lit(9).alias("end"), F.lit("year_heading").alias("source"))
    return C.first_structure(nation.select(key, F.col("n_name").alias("title"), (10 + F.col("n_nationkey")).alias("page_count")), [outline, years])


@query("SELECT p_partkey, p_name || ' ' || p_brand || ' of brand ' || p_brand || ' ' || p_name || ' ' || (1900 + p_size) || '年' AS search_text FROM part")
def c14_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = C.search_text(F.col("p_name"), F.col("p_brand"), F.array(F.lit("of"), F.lit("brand"), F.col("p_brand")), F.array("p_name"), F.array(1900 + F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("search_text"))


@query("""
SELECT o_orderkey AS run_id, o_orderpriority AS operation, CASE WHEN n % 3 = 0 THEN 'failed' WHEN n % 3 = 1 THEN 'succeeded' ELSE 'running' END AS status, CAST(CASE WHEN n % 3 < 2 THEN n ELSE 0 END AS BIGINT) AS seconds
FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)""")
def s17_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, which begin at 0 and end after as many seconds as they have items, or not at all."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    runs = table(spark, sf_dir, "orders").join(items, "o_orderkey", "left").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("operation"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    begun = runs.select("run_id", "operation", F.lit("running").alias("status"), F.lit(0).cast("long").alias("at"))
    ended = runs.where("n % 3 < 2").select("run_id", "operation", F.when(F.col("n") % 3 == 0, "failed").otherwise("succeeded").alias("status"), F.col("n").alias("at"))
    return C.latest_runs(begun.unionByName(ended))


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'chunk build manifest is missing' WHEN doc_id % 5 = 1 THEN 'legacy chunk report has no manifest'
  WHEN doc_id % 5 = 2 AND text IS NOT NULL THEN 'chunk artifact changed after the latest chunk build' ELSE '' END AS warning FROM documents""")
def s16_manifest_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = F.sha2("text", 256)
    kind = F.col("doc_id") % 5
    recorded = F.when(kind == 2, F.concat(actual, F.lit("!"))).otherwise(actual)
    return table(spark, sf_dir, "documents").select("doc_id", C.manifest_warnings(kind != 0, kind != 1, recorded, actual).alias("warning"))


@query(f"""
WITH RECURSIVE ev AS ({EVENTS}), g AS (SELECT *, row_number() OVER (PARTITION BY person_id, start_value ORDER BY event_id) = 1 AS rep, CASE WHEN event_type = 'click' THEN 'activity' ELSE event_type END AS kind FROM ev)
SELECT person_id || ':' || start_value AS grp, CASE WHEN count(DISTINCT kind) = 1 THEN max(kind) WHEN count(DISTINCT kind) FILTER (kind <> 'activity') = 1 THEN max(kind) FILTER (kind <> 'activity') ELSE max(kind) FILTER (rep) END AS event_type FROM g GROUP BY 1""")
def m13_canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the events of a person's day, whose first event stands for them; clicks have no type of their own."""
    from pyspark.sql import Window

    from evidencelake.operators import resolve

    events = source_events(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("person_id", "start_value").orderBy("event_id")) == 1
    members = events.select(F.concat(F.col("person_id").cast("string"), F.lit(":"), F.col("start_value")).alias("grp"), F.when(F.col("event_type") == "click", resolve.GENERIC).otherwise(F.col("event_type")).alias("event_type"), first.alias("is_representative"))
    return resolve.canonical_type(members, "grp")
