"""Queries on structure, resolution, timelines, evaluation and sessions over the driver tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import corpus, evaluation, resolve, sessions
from evidencelake.operators import research as R
from evidencelake.operators.holding import holding
from evidencelake.plans.retrieval import BRANCHES, PAGES, _by_vector, _by_words
from evidencelake.plans.tables import pages as page_table
from evidencelake.plans.tables import source_events, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


EVENTS = """SELECT event_id, user_id AS person_id, event_type, strftime(ts, '%Y-%m-%d') AS start_value, least(value / 100.0, 1.0) AS confidence,
  CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'unreviewed' END AS review_status, event_id % 7 AS document_id, props FROM events"""


# Cleaning and structure


@query(rf"""
WITH p AS ({PAGES}), l AS (SELECT document_id, pdf_page, list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS ls FROM p),
e AS (SELECT document_id, unnest(list_distinct(list_concat(ls[1:2], ls[greatest(len(ls) - 1, 1):len(ls)]))) AS line FROM l),
c AS (SELECT document_id, line, count(*) AS pages FROM e WHERE length(line) BETWEEN 2 AND 50 AND NOT regexp_matches(line, '^[\s—–-]*[0-9]{{1,4}}[\s—–-]*$') GROUP BY ALL),
n AS (SELECT document_id, greatest(5, round_even(count(*) * 0.04, 0)) AS least FROM p GROUP BY document_id)
SELECT document_id, line, pages FROM c JOIN n USING (document_id) WHERE pages >= least""")
def c1_marginal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.marginal_lines(page_table(spark, sf_dir))


@query()
def c4_cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all pages, without the lines that repeat at their margins (a fold; tested on fixtures)."""
    rows = page_table(spark, sf_dir)
    repeated = corpus.marginal_lines(rows).groupBy("document_id").agg(F.collect_set("line").alias("repeated"))
    return rows.join(repeated, "document_id", "left").select("document_id", "pdf_page", corpus.cleaned(F.col("text"), F.coalesce("repeated", F.array().cast("array<string>"))).alias("text"))


@query()
def c9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all pages at sentence ends (a fold; tested on fixtures)."""
    return corpus.chunks(page_table(spark, sf_dir), r"(?<=[.!。！？；])").drop("text")


HEADINGS = r"""h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])', 1)) AS level, generate_subscripts(regexp_extract_all(html, '<h([1-6])', 1), 1) AS seq FROM pages)"""


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the html pages as outline entries, the place of a heading standing for its page."""
    found = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.posexplode(F.regexp_extract_all("html", F.lit("<h([1-6])"), 1)).alias("at", "level"))
    return found.select("document_id", (F.col("at") + 1).alias("seq"), F.col("level").cast("int").alias("level"), (F.col("at") + 1).alias("page"))


@query(f"""
WITH {HEADINGS}, e AS (SELECT page_id AS document_id, CAST(seq AS INT) AS seq, CAST(level AS INT) AS level FROM h), l AS (SELECT document_id, max(seq) + 2 AS last_page FROM e GROUP BY 1)
SELECT e.document_id, e.seq, e.level, CAST(greatest(e.seq, coalesce((SELECT min(n.seq) - 1 FROM e n WHERE n.document_id = e.document_id AND n.seq > e.seq AND n.level <= e.level), l.last_page)) AS INT) AS end_page FROM e JOIN l USING (document_id)""")
def c5_outline_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _headings(spark, sf_dir)
    last = entries.groupBy("document_id").agg((F.max("seq") + 2).alias("last_page"))
    return corpus.outline_ends(entries, last).select("document_id", "seq", "level", F.col("end_page").cast("int").alias("end_page"))


@query(f"""
WITH {HEADINGS}, e AS (SELECT page_id AS document_id, CAST(seq AS INT) AS seq, CAST(level AS INT) AS level FROM h), l AS (SELECT document_id, max(seq) + 2 AS last_page FROM e GROUP BY 1),
x AS (SELECT e.*, greatest(e.seq, coalesce((SELECT min(n.seq) - 1 FROM e n WHERE n.document_id = e.document_id AND n.seq > e.seq AND n.level <= e.level), l.last_page)) AS end_page FROM e JOIN l USING (document_id)),
p AS (SELECT document_id, unnest(range(1, last_page + 1)) AS pdf_page FROM l),
b AS (SELECT p.document_id, p.pdf_page, x.level, max(x.seq) AS seq FROM p JOIN x ON x.document_id = p.document_id AND p.pdf_page BETWEEN x.seq AND x.end_page GROUP BY ALL)
SELECT document_id, CAST(pdf_page AS INT) AS pdf_page, string_agg('h' || level || '.' || seq, '>' ORDER BY level) AS path FROM b GROUP BY ALL""")
def c8_section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _headings(spark, sf_dir)
    last = entries.groupBy("document_id").agg((F.max("seq") + 2).alias("last_page"))
    rows = last.select("document_id", F.explode(F.sequence(F.lit(1), "last_page")).alias("pdf_page"))
    named = corpus.outline_ends(entries, last).withColumn("title", F.concat(F.lit("h"), F.col("level").cast("string"), F.lit("."), F.col("seq").cast("string")))
    return corpus.section_paths(rows, named).select("document_id", F.col("pdf_page").cast("int").alias("pdf_page"), F.array_join("path", ">").alias("path"))


@query("SELECT doc_id, lag(doc_id) OVER w AS previous_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def c15_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.lag("doc_id").over(w).alias("previous_id"), F.lead("doc_id").over(w).alias("next_id"))


YEARS = "y AS (SELECT o_custkey, list_sort(list_distinct(list(CAST(year(o_orderdate) AS INT)))) AS years FROM orders GROUP BY 1)"


@query(f"""
WITH {YEARS} SELECT o_custkey, array_to_string(years, ',') AS years, CASE WHEN len(list_filter(years, lambda v: v BETWEEN 1996 AND 1999)) = len(years) THEN 'in_scope' WHEN len(list_filter(years, lambda v: v BETWEEN 1996 AND 1999)) > 0 THEN 'mixed' ELSE 'out_of_scope' END AS scope FROM y""")
def c11_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("years"))
    return rows.select("o_custkey", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), corpus.scope(F.col("years"), 1996, 1999).alias("scope"))


@query("""
WITH f AS (SELECT n_name AS form, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT c_custkey, n_name || ' ' || c_mktsegment AS text FROM customer JOIN nation ON n_nationkey = c_nationkey) t JOIN f ON contains(text, form) GROUP BY c_custkey""")
def c12_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    forms = nation.join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("form"), F.col("r_name").alias("name"))
    texts = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.concat_ws(" ", "n_name", "c_mktsegment").alias("text"))
    return corpus.mentions(texts, forms, "c_custkey").select("c_custkey", F.array_join("names", ",").alias("names"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_sha256, count(*) AS parts FROM conversations GROUP BY conv_id")
def c17_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return corpus.full_text(rows, "conv_id", "turn").join(rows.groupBy("conv_id").agg(F.count("*").alias("parts")), "conv_id").select("conv_id", F.sha2("text", 256).alias("text_sha256"), "parts")


# Duplicate events

PAIRS = f"""ev AS ({EVENTS}), pr AS (SELECT l.event_id AS a, r.event_id AS b, l.event_type AS lt, r.event_type AS rt, l.start_value AS ls, r.start_value AS rs, l.props AS lp, r.props AS rp, l.person_id AS person_id
  FROM ev l JOIN ev r ON l.person_id = r.person_id AND l.start_value[:7] = r.start_value[:7] AND l.event_id < r.event_id AND l.document_id <> r.document_id WHERE l.review_status <> 'rejected' AND r.review_status <> 'rejected')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = source_events(spark, sf_dir).where("review_status <> 'rejected'").withColumn("month", F.substring("start_value", 1, 7))
    return resolve.blocked_pairs(events, ["person_id", "month"])


@query(f"WITH {PAIRS} SELECT person_id, count(*) AS pairs, count(*) FILTER (ls = rs) AS same_day FROM pr GROUP BY person_id")
def m5_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = resolve.date_relation(F.col("l.start_value"), F.col("r.start_value"))
    return _pairs(spark, sf_dir).groupBy("person_id").agg(F.count("*").alias("pairs"), F.count_if(relation == "exact_day").alias("same_day"))


BIGRAMS = lambda c: f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"
SCORED = rf"""{PAIRS}, nf AS (SELECT *, lower(regexp_replace(lt || lp, '[^\p{{L}}\p{{N}}]', '', 'g')) AS x, lower(regexp_replace(rt || rp, '[^\p{{L}}\p{{N}}]', '', 'g')) AS y FROM pr WHERE ls = rs),
bg AS (SELECT *, {BIGRAMS('x')} AS p, {BIGRAMS('y')} AS q FROM nf), sm AS (SELECT *, CAST(len(list_intersect(p, q)) AS DOUBLE) AS i FROM bg),
sc AS (SELECT a, b, round(i / least(len(p), len(q)), 6) AS containment, round(i / (len(p) + len(q) - i), 6) AS jaccard,
  round(least(CAST(0.34 AS DOUBLE) + CAST(0.22 AS DOUBLE) * (i / least(len(p), len(q))) + CAST(0.10 AS DOUBLE) * (i / (len(p) + len(q) - i)) + CAST(0.14 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.10 AS DOUBLE) + CASE WHEN lt = rt THEN CAST(0.03 AS DOUBLE) ELSE 0 END, CAST(1 AS DOUBLE)), 6) AS score FROM sm)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    same_day = _pairs(spark, sf_dir).where(F.col("l.start_value") == F.col("r.start_value"))
    texts = same_day.select(*(F.col(s).withField("words", F.concat(F.col(f"{s}.event_type"), F.col(f"{s}.props"))).alias(s) for s in ("l", "r")))
    alike = resolve.similarities(texts, "words")
    relation = resolve.date_relation(F.col("l.start_value"), F.col("r.start_value"))
    score = resolve.pair_score(relation, F.col("containment"), F.col("jaccard"), F.lit(1), F.lit(True), F.lit(False), F.lit(False), F.col("l.event_type") == F.col("r.event_type"))
    return alike.select(F.col("l.event_id").alias("a"), F.col("r.event_id").alias("b"), F.round("containment", 6).alias("containment"), F.round("jaccard", 6).alias("jaccard"), score.alias("score"))


@query(f"WITH {SCORED} SELECT a, b, containment, jaccard, score FROM sc")
def m6_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query(f"""
WITH RECURSIVE {SCORED}, g AS (SELECT a, b FROM sc WHERE score >= 0.85 UNION SELECT b, a FROM sc WHERE score >= 0.85),
t AS (SELECT a AS node, a AS other FROM g UNION SELECT t.node, g.b FROM t JOIN g ON g.a = t.other) SELECT node, min(other) AS component FROM t GROUP BY node""")
def m8_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.components(_scored(spark, sf_dir).where("score >= 0.85").select("a", "b"))


@query(f"""
WITH ev AS ({EVENTS}), g AS (SELECT *, person_id || ':' || start_value AS grp FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE review_status WHEN 'confirmed' THEN 2 WHEN 'unreviewed' THEN 1 ELSE 0 END DESC, confidence DESC, length(props), event_id DESC) AS n FROM g)
SELECT grp, event_id, round(confidence, 6) AS confidence, review_status FROM r WHERE n = 1""")
def m10_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = source_events(spark, sf_dir).withColumn("grp", F.concat(F.col("person_id").cast("string"), F.lit(":"), F.col("start_value"))).withColumn("description", F.col("props"))
    return resolve.representative(events, "grp").select("grp", "event_id", F.round("confidence", 6).alias("confidence"), "review_status")


@query(f"""
WITH ev AS ({EVENTS}), g AS (SELECT *, person_id || ':' || start_value AS grp FROM ev),
u AS (SELECT grp, event_id, 'event_type' AS field, event_type AS value FROM g UNION ALL SELECT grp, event_id, 'review_status', review_status FROM g),
v AS (SELECT grp, field, value, string_agg(DISTINCT CAST(event_id AS VARCHAR), ',') AS unordered, list_sort(list_distinct(list(event_id))) AS ids FROM u GROUP BY grp, field, value)
SELECT grp, field, value, array_to_string(ids, ',') AS events FROM v WHERE (grp, field) IN (SELECT grp, field FROM v GROUP BY grp, field HAVING count(*) > 1)""")
def m12_field_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = source_events(spark, sf_dir).withColumn("grp", F.concat(F.col("person_id").cast("string"), F.lit(":"), F.col("start_value")))
    return resolve.field_variants(events, "grp", ["event_type", "review_status"])


@query("""
WITH cur AS (SELECT o_custkey AS k, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS h FROM orders WHERE year(o_orderdate) < 2000 GROUP BY 1),
new AS (SELECT o_custkey AS k, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS h FROM orders WHERE o_totalprice > 50000 GROUP BY 1),
j AS (SELECT coalesce(cur.k, new.k) AS k, cur.h AS o, new.h AS n, CASE WHEN cur.k % 5 = 0 THEN 'confirmed' WHEN cur.k % 5 = 1 THEN 'rejected' WHEN cur.k IS NOT NULL THEN 'unreviewed' END AS st, cur.k % 3 <> 0 AS act FROM cur FULL JOIN new ON cur.k = new.k)
SELECT CASE WHEN o IS NULL AND st IS NULL THEN 'created' WHEN st IN ('confirmed', 'rejected') THEN 'protected' WHEN n IS NULL AND act THEN 'deactivated' WHEN n IS NULL THEN 'skipped' WHEN o = n AND act THEN 'skipped' WHEN o = n THEN 'reactivated' ELSE 'updated' END AS action, count(*) AS rows, CAST(sum(k) AS BIGINT) AS keys FROM j GROUP BY 1""")
def m15_synchronise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of customers' orders, synchronised."""
    orders = table(spark, sf_dir, "orders")
    state = lambda rows: rows.groupBy(F.col("o_custkey").alias("k")).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda o: o.cast("string")), ",")).alias("input_hash"))
    reviewed = F.when(F.col("k") % 5 == 0, "confirmed").when(F.col("k") % 5 == 1, "rejected").otherwise("unreviewed")
    current = state(orders.where(F.year("o_orderdate") < 2000)).withColumn("review_status", reviewed).withColumn("is_active", F.col("k") % 3 != 0)
    rows = resolve.synchronise(current, state(orders.where("o_totalprice > 50000")), "k")
    return rows.groupBy("action").agg(F.count("*").alias("rows"), F.sum("k").alias("keys"))


@query(f"""
WITH ev AS ({EVENTS}) SELECT event_id, CAST(least(90, 55 + round_even((1 - confidence) * 50, 0)) AS INT) AS priority FROM ev WHERE review_status = 'unreviewed'""")
def m16_review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_events(spark, sf_dir).where("review_status = 'unreviewed'").select("event_id", resolve.review_priority(F.col("confidence")).alias("priority"))


# People, timelines and tenure

NAMES = "n AS (SELECT CAST(c_custkey AS VARCHAR) AS person_id, c_mktsegment || '-' || (c_custkey % 400) AS form FROM customer)"


@query(f"""
WITH {NAMES}, m AS (SELECT DISTINCT c_mktsegment || ' - ' || upper(CAST(c_custkey % 600 AS VARCHAR)) AS mention FROM customer),
f AS (SELECT mention, count(DISTINCT person_id) AS candidates, min(person_id) AS person FROM m LEFT JOIN n ON lower(replace(mention, ' ', '')) = lower(replace(form, ' ', '')) GROUP BY mention)
SELECT mention, CASE candidates WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN candidates = 1 THEN person END AS person_id, candidates FROM f""")
def r4_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of customers by segment and number, spaced otherwise than the names."""
    customer = table(spark, sf_dir, "customer")
    names = customer.select(F.col("c_custkey").cast("string").alias("person_id"), F.concat(F.col("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 400).cast("string")).alias("form"))
    mentioned = customer.select(F.concat(F.col("c_mktsegment"), F.lit(" - "), (F.col("c_custkey") % 600).cast("string")).alias("mention"))
    return R.resolve_names(mentioned, names)


@query("SELECT o_custkey, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def r9_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphans(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


CANONICAL = f"""ev AS ({EVENTS}), mem AS (SELECT min(event_id) OVER g AS canonical_event_id, event_id, count(*) OVER g AS n FROM ev WINDOW g AS (PARTITION BY person_id, start_value, event_type)),
can AS (SELECT ev.*, 'canonical' AS kind FROM ev WHERE event_id IN (SELECT canonical_event_id FROM mem WHERE n > 1)),
cf AS (SELECT * FROM can WHERE review_status <> 'rejected' AND confidence >= 0.2 AND substr(start_value, 1, 4) = '2024'),
sf AS (SELECT *, 'source' AS kind FROM ev WHERE review_status <> 'rejected' AND confidence >= 0.2 AND substr(start_value, 1, 4) = '2024' AND event_id NOT IN (SELECT event_id FROM mem WHERE n > 1 AND canonical_event_id IN (SELECT event_id FROM cf))),
tl AS (SELECT * FROM cf UNION ALL SELECT * FROM sf)"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = source_events(spark, sf_dir).withColumn("end_value", F.lit(None).cast("string"))
    same = Window.partitionBy("person_id", "start_value", "event_type")
    members = events.select("event_id", F.min("event_id").over(same).alias("canonical_event_id"), F.count("*").over(same).alias("n")).where("n > 1").drop("n")
    canonical = events.join(members.select(F.col("canonical_event_id").alias("event_id")).distinct(), "event_id", "left_semi")
    passes = (F.col("review_status") != "rejected") & (F.col("confidence") >= 0.2) & R.overlaps_years(F.col("start_value"), F.col("end_value"), 2024, 2024)
    return R.timeline(canonical, members, events, passes)


@query(f"WITH {CANONICAL} SELECT event_id, person_id, start_value, kind FROM tl")
def t3_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).select("event_id", "person_id", "start_value", "kind")


@query(f"""
WITH {CANONICAL}, o AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY start_value, event_id) AS place, count(*) OVER (PARTITION BY person_id) AS total FROM tl)
SELECT person_id, event_id, place, total, total > 15 AS has_more FROM o WHERE place > 5 AND place <= 15""")
def t5_timeline_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.page_of(_timeline(spark, sf_dir), "person_id", R.chronological("event_id"), 5, 10)
    return rows.select("person_id", "event_id", *long("place", "total"), "has_more")


@query(f"""
WITH ev AS ({EVENTS}), b AS (SELECT *, row_number() OVER (PARTITION BY person_id, start_value ORDER BY confidence DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY person_id, start_value) AS size FROM ev), t AS (SELECT * FROM b WHERE n = 1),
i AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY start_value) - 1 AS i, count(*) OVER (PARTITION BY person_id) AS m FROM t)
SELECT person_id, start_value AS bucket, event_id, size FROM i WHERE m <= 6 OR i IN (SELECT round_even(j * (m - 1) / CAST(5 AS DOUBLE), 0) FROM range(0, 6) r(j))""")
def t6_timeline_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_buckets(source_events(spark, sf_dir), "person_id", F.col("start_value"), F.struct("confidence", "event_id"), 6)


@query("""
WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS first, b.l_suppkey AS second, count(*) AS shared FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def x6_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one order as people of one event."""
    return R.together(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey"])


TENURE = "t AS (SELECT o_custkey, o_orderpriority, strftime(min(o_orderdate), '%Y-%m') AS start_value, strftime(max(o_orderdate), '%Y-%m-%d') AS end_value FROM orders GROUP BY ALL)"


@query(f"WITH {TENURE} SELECT * FROM t WHERE CAST(start_value || '-01' AS DATE) <= DATE '1997-03-31' AND CAST(end_value AS DATE) >= DATE '1997-03-01'")
def o5_held_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities that customers used in March 1997, from partial dates."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("start_value"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("end_value"))
    return R.held_at(rows, "start_value", "end_value", "1997-03")


@query("""
WITH cur AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 4 <> 0), new AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(n.p_partkey, c.p_partkey) AS p_partkey, coalesce(n.p_brand, c.p_brand) AS p_brand, coalesce(n.p_size, c.p_size) AS p_size,
  CASE WHEN c.p_partkey IS NULL THEN 'created' WHEN n.p_partkey IS NULL THEN 'deactivated' WHEN c.p_size = n.p_size THEN 'skipped' ELSE 'updated' END AS action, n.p_partkey IS NOT NULL AS is_active FROM cur c FULL JOIN new n ON c.p_partkey = n.p_partkey""")
def r6_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    new = part.where("p_partkey % 5 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return R.upsert(part.where("p_partkey % 4 <> 0"), new, "p_partkey", ["p_brand", "p_size"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS is_current FROM events")
def s14_current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.current_version(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""
WITH c AS (SELECT s_suppkey AS d, lower(s_name) AS k FROM supplier), kn AS (SELECT s_suppkey AS d, md5(CAST(CASE WHEN s_suppkey % 7 = 0 THEN -s_suppkey ELSE s_suppkey END AS VARCHAR)) AS old FROM supplier WHERE s_suppkey % 4 <> 0),
fi AS (SELECT CASE WHEN s_suppkey % 5 = 1 THEN 'moved-' || lower(s_name) ELSE lower(s_name) END AS k, md5(CAST(s_suppkey AS VARCHAR)) AS sha FROM supplier WHERE s_suppkey % 6 <> 0),
j AS (SELECT d, coalesce(w.k, fi.k) AS k, old, sha FROM (SELECT c.d, k, old FROM c LEFT JOIN kn ON kn.d = c.d) w FULL JOIN fi ON fi.k = w.k),
fr AS (SELECT sha, min(k) AS moved FROM j WHERE d IS NULL GROUP BY sha HAVING count(*) = 1),
s AS (SELECT j.*, fr.moved FROM j LEFT JOIN fr ON fr.sha = j.old), st AS (SELECT d, k, moved, CASE WHEN d IS NULL THEN 'unregistered' WHEN sha IS NULL AND moved IS NOT NULL THEN 'renamed' WHEN sha IS NULL THEN 'missing' WHEN old IS NULL THEN 'new' WHEN old = sha THEN 'unchanged' ELSE 'changed' END AS status FROM s)
SELECT status, count(*) AS files FROM st WHERE NOT (status = 'unregistered' AND k IN (SELECT moved FROM st WHERE status = 'renamed')) GROUP BY status""")
def s1_scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files of a scan, some moved, some changed, some gone."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document_id"), F.lower("s_name").alias("filename"))
    digest = lambda c: F.md5(c.cast("string"))
    known = supplier.where("document_id % 4 <> 0").select("document_id", digest(F.when(F.col("document_id") % 7 == 0, -F.col("document_id")).otherwise(F.col("document_id"))).alias("sha256"))
    found = supplier.where("document_id % 6 <> 0").select(F.when(F.col("document_id") % 5 == 1, F.concat(F.lit("moved-"), "filename")).otherwise(F.col("filename")).alias("filename"), digest(F.col("document_id")).alias("sha256"))
    return R.scan_status(supplier, known, found).groupBy("status").agg(F.count("*").alias("files"))


# Evaluation


@query(f"""
WITH {BRANCHES}, g AS (SELECT i.item_id AS query_id, d.doc_id AS id FROM benchmark i JOIN documents d ON contains(lower(regexp_replace(d.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lower(regexp_replace(i.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')))),
m AS (SELECT g.query_id, min(kw.rank) AS first FROM g LEFT JOIN kw ON kw.query_id = g.query_id AND kw.id = g.id GROUP BY 1)
SELECT query_id, first, round(coalesce(CAST(1 AS DOUBLE) / first, 0), 6) AS reciprocal FROM m""")
def g1_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the documents that hold a benchmark item whole, in the ranking by words."""
    words = _by_words(spark, sf_dir, 100)
    rows = evaluation.first_ranks(words, _gold(spark, sf_dir))
    return rows.select("query_id", *long("first"), F.round("reciprocal", 6).alias("reciprocal"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id) of items whose letters and digits a document holds in one run, wherever their words begin."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.comparable("text").alias("quote"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.comparable("text").alias("page"))
    return holding(docs, items).distinct()


@query(f"""
WITH {BRANCHES}, g AS (SELECT i.item_id AS query_id, e.vec_id AS id FROM benchmark i JOIN embeddings q ON q.vec_id = i.item_id JOIN embeddings e ON e.label = q.label),
sz AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), h AS (SELECT v.query_id, count(*) AS found FROM v JOIN g ON g.query_id = v.query_id AND g.id = v.id WHERE v.rank <= 10 GROUP BY 1)
SELECT sz.query_id, CAST(coalesce(found, 0) > 0 AS INT) AS hit, round(coalesce(found, 0) / CAST(n AS DOUBLE), 6) AS recall, round(coalesce(found, 0) / CAST(10 AS DOUBLE), 6) AS precision FROM sz LEFT JOIN h USING (query_id)""")
def g4_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, recall and precision of the vector branch, a query's label being what is relevant."""
    near = _by_vector(spark, sf_dir, 100)
    rows = evaluation.at_k(near, _relevant(spark, sf_dir), 10)
    return rows.select("query_id", "hit", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(points.select(F.col("id").alias("query_id"), "label"), "query_id")
    return asked.join(points, "label").select("query_id", "id")


@query(f"""
WITH {BRANCHES}, g AS (SELECT i.item_id AS query_id, e.vec_id AS id, CASE WHEN e.vec_id % 2 = 0 THEN 2 ELSE 1 END AS grade FROM benchmark i JOIN embeddings q ON q.vec_id = i.item_id JOIN embeddings e ON e.label = q.label),
d AS (SELECT v.query_id, sum((CAST(2 AS DOUBLE) ** grade - 1) / log2(rank + 1)) AS dcg FROM v JOIN g ON g.query_id = v.query_id AND g.id = v.id WHERE rank <= 10 GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM g), i AS (SELECT query_id, sum((CAST(2 AS DOUBLE) ** grade - 1) / log2(place + 1)) AS best FROM p WHERE place <= 10 GROUP BY 1)
SELECT i.query_id, round(coalesce(dcg, 0) / best, 6) AS ndcg FROM i LEFT JOIN d USING (query_id)""")
def g5_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _by_vector(spark, sf_dir, 100)
    grades = _relevant(spark, sf_dir).withColumn("grade", F.when(F.col("id") % 2 == 0, 2).otherwise(1))
    return evaluation.ndcg(near, grades, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"""
WITH {BRANCHES}, h AS (SELECT kw.query_id, md5(d.text) AS f FROM kw JOIN documents d ON d.doc_id = kw.id WHERE rank <= 20)
SELECT query_id, count(*) AS hits, count(DISTINCT f) AS different, round((count(*) - count(DISTINCT f)) / CAST(count(*) AS DOUBLE), 6) AS redundancy FROM h GROUP BY query_id""")
def g6_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _by_words(spark, sf_dir, 20)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("f"))
    return evaluation.redundancy(words.join(docs, "id"), "f").withColumn("redundancy", F.round("redundancy", 6))


@query("""
WITH o AS (SELECT quality = 1 AS expected, n_chars > 400 AS predicted, lang, source FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, source, count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (NOT expected AND predicted) AS fp, count(*) FILTER (expected AND NOT predicted) AS fn, count(*) FILTER (NOT expected AND NOT predicted) AS tn FROM o GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(CAST(2 AS DOUBLE) * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def g20_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts as a guess at good ones, overall, by language and by source."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select((F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 400).alias("predicted"), "lang", "source")
    out = evaluation.confusion(rows, [[], ["lang"], ["source"]])
    return out.select("lang", "source", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY event_type")
def g18_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.percentiles(table(spark, sf_dir, "events"), "event_type", "value")
    return rows.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")), "most")


@query("""
WITH a AS (SELECT user_id, round(sum(value), 6) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, round(sum(value), 6) AS v FROM events WHERE event_type = 'view' AND value > 100 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS baseline, b.v AS candidate, round(b.v - a.v, 6) AS delta, CASE WHEN a.v IS NULL THEN 'missing_in_baseline' WHEN b.v IS NULL THEN 'missing_in_candidate' ELSE 'comparable' END AS reason FROM a FULL JOIN b ON a.user_id = b.user_id""")
def g15_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda rows: rows.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("v"))
    events = table(spark, sf_dir, "events")
    return evaluation.compare(run(events.where("event_type = 'click'")), run(events.where("event_type = 'view' AND value > 100")), "user_id", "v").withColumn("delta", F.round("delta", 6))


@query("""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('v1|' || doc_id)) AS place FROM documents) SELECT doc_id, lang, source, place FROM r WHERE place <= 3""")
def g21_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each language and source for review."""
    rows = evaluation.stratified(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", "v1", 3)
    return rows.select("doc_id", "lang", "source", *long("place"))


@query("SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_event FROM events")
def g21_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.min("event_id").over(Window.partitionBy("user_id", "event_type")).alias("first_event"))


@query("""
SELECT role, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS messages FROM conversations GROUP BY role""")
def g19_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and messages as usage maps, summed by key."""
    usage = table(spark, sf_dir, "conversations").select(F.create_map(F.col("role"), F.length("text").cast("long")).alias("usage"))
    return usage.select(F.explode("usage").alias("role", "n")).groupBy("role").agg(F.sum("n").alias("characters"), F.count("*").alias("messages"))


@query()
def g11_quote_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that hold them whole."""
    return _gold(spark, sf_dir)


# Sessions


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role FROM r WHERE n <= 3")
def w1_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.retained(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM r WHERE n <= 2")
def w2_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role", *long("place"))


@query("""
WITH r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER w AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations WHERE length(trim(text)) > 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, CAST(least(size, 1500 - used) AS BIGINT) AS kept FROM r WHERE n <= 4 AND used < 1500""")
def w3_prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.prompt_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 4, 1500).select("conv_id", "turn", "kept")
