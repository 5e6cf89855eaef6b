"""Queries on stored indexes, searches, parsers, passes, packets and audits over the driver tables, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import evaluation, packets, pages, parsers, reports, search, stored
from evidencelake.operators.research import upsert_generated
from evidencelake.operators.lineage import cut, shared_folder
from evidencelake.plans.retrieval import BRANCHES, WORDS, _branches, _by_vector, _vectors, keyword_index
from evidencelake.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _own_store(spark: SparkSession) -> stored.Store:
    return stored.Store(spark, f"{shared_folder(spark)}/evidencelake-indexes/{uuid.uuid4().hex}")


# Stored indexes


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents)
SELECT doc_id AS chunk_id, len(words)::BIGINT AS length, len(list_distinct(words))::BIGINT AS terms FROM w""")
def s12_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and distinct terms of every document, as the published index has them."""
    store, version = keyword_index(spark, sf_dir)
    return store.table("words", version).select("chunk_id", "length", F.size("terms").cast("long").alias("terms"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS held, count(*) AS words FROM w GROUP BY term""")
def s12_stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each term, and how often it comes, from the published index."""
    store, version = keyword_index(spark, sf_dir)
    return store.table("terms", version)


@query("""
WITH v AS (SELECT label, count(*) AS n, count(*) FILTER (label < 3) AS low FROM embeddings GROUP BY label)
SELECT 'first' AS step, label, n AS points FROM v UNION ALL SELECT 'second', label, low FROM v WHERE low > 0 UNION ALL SELECT 'back', label, n FROM v""")
def s13_vector_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each label in a published vector index, in one that replaces it, and after going back to the first."""
    store, points = _own_store(spark), _vectors(spark, sf_dir)
    of = lambda step, version: store.table("points", version).groupBy("label").agg(F.count("*").alias("points")).select(F.lit(step).alias("step"), "label", "points")
    first = of("first", stored.build_vectors(store, points))
    second = of("second", stored.build_vectors(store, points.where("label < 3")))
    return first.unionByName(second).unionByName(of("back", store.roll_back()))


@query("""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (label < 3) AS low FROM embeddings)
SELECT 'vector_index' AS operation, 'published' AS status, n AS points, CAST(1 AS BIGINT) AS runs FROM n UNION ALL SELECT 'vector_index', 'published', low, 1 FROM n
UNION ALL SELECT 'vector_index', 'failed', NULL, 1 UNION ALL SELECT 'roll_back', 'published', n, 1 FROM n""")
def s17_build_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after two builds, one that its check refuses, and a roll-back."""
    store, points = _own_store(spark), _vectors(spark, sf_dir)
    stored.build_vectors(store, points)
    stored.build_vectors(store, points.where("label < 3"))
    try:
        stored.build_vectors(store, points.unionByName(points))  # every id twice
    except stored.BuildError:
        pass
    store.roll_back()
    said = F.get_json_object("manifest", "$.points").cast("long").alias("points")
    return store.runs().groupBy("operation", "status", said).agg(F.count("*").alias("runs"))


# Searches


@query(f"""
WITH {BRANCHES}, r AS (SELECT query_id, id, keyword_rank, vector_rank, round(raw_rrf, 8) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_rrf, 8) DESC, id) AS rank FROM f)
SELECT 'hybrid_rrf' AS mode, '' AS lost, query_id, id, keyword_rank, vector_rank, rank, rrf_score FROM r WHERE rank <= 5
UNION ALL SELECT 'keyword_only', 'vector', query_id, id, rank, NULL, rank, NULL FROM kw WHERE rank <= 5
UNION ALL SELECT 'vector_only', 'keyword', query_id, id, NULL, rank, rank, NULL FROM v WHERE rank <= 5""")
def h14_degraded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of every benchmark item by both branches, by words while no vectors are published, and by vectors while the word index fails as it is read."""
    words, near = map(cut, _branches(spark, sf_dir, 100))  # three searches read them
    empty = _own_store(spark)
    broken = words.withColumn("id", F.when(F.col("rank") > 0, F.raise_error(F.lit("the index is damaged"))).otherwise(F.col("id")))
    runs = [
        search.hybrid(lambda: words, lambda: near, 5),
        search.hybrid(lambda: words, lambda: empty.table("points"), 5),
        search.hybrid(lambda: broken, lambda: near, 5),
    ]
    out = None
    for run in runs:
        ranks = (F.col(c).cast("long").alias(c) for c in ("keyword_rank", "vector_rank", "rank"))
        rows = run.hits.select(F.lit(run.mode).alias("mode"), F.lit(",".join(run.lost)).alias("lost"), "query_id", "id", *ranks, "rrf_score")
        out = rows if out is None else out.unionByName(rows)
    return out


# Evaluation


@query(f"""
WITH {BRANCHES}, h AS (SELECT query_id, rank, id % 7 AS doc, id // 7 AS low, id // 7 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS high FROM v),
g AS (SELECT i.item_id AS query_id, e.vec_id % 7 AS doc, e.vec_id // 7 AS page, CASE WHEN e.vec_id % 2 = 0 THEN 2 ELSE 1 END AS grade, i.item_id % 4 <> 0 AS complete
  FROM benchmark i JOIN embeddings q ON q.vec_id = i.item_id JOIN embeddings e ON e.label = q.label),
t AS (SELECT h.query_id, h.doc, g.page, min(rank) AS rank, max(grade) AS grade FROM h JOIN g ON g.query_id = h.query_id AND g.doc = h.doc AND g.page BETWEEN low AND high WHERE rank <= 10 GROUP BY ALL),
n AS (SELECT query_id, rank, max(grade) AS grade, count(*) AS pages FROM t GROUP BY ALL),
d AS (SELECT query_id, sum((CAST(2 AS DOUBLE) ** grade - 1) / log2(rank + 1)) AS dcg, max(pages) AS most FROM n GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM g), i AS (SELECT query_id, sum((CAST(2 AS DOUBLE) ** grade - 1) / log2(place + 1)) FILTER (place <= 10) AS best, min(complete) AS complete FROM p GROUP BY 1)
SELECT i.query_id, CASE WHEN complete AND coalesce(most, 0) < 2 THEN round(coalesce(dcg, 0) / best, 6) END AS ndcg, CASE WHEN NOT complete THEN 'incomplete_or_no_gain' WHEN most > 1 THEN 'ambiguous_pages' ELSE 'evaluated' END AS reason
FROM i LEFT JOIN d USING (query_id)""")
def g5_greedy_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings by vectors whose hits lie on a page, or on two, of seven books; gold pages gain once."""
    near = _by_vector(spark, sf_dir, 100)
    page = F.floor(F.col("id") / 7)
    hits = near.select("query_id", "rank", (F.col("id") % 7).alias("document_id"), page.alias("start"), F.when(F.col("id") % 3 == 0, page + 1).alias("end"))
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(points.select(F.col("id").alias("query_id"), "label"), "query_id")
    gold = asked.join(points, "label").select("query_id", (F.col("id") % 7).alias("document_id"), page.alias("page"), F.when(F.col("id") % 2 == 0, 2).otherwise(1).alias("grade"), (F.col("query_id") % 4 != 0).alias("complete"))
    return evaluation.greedy_ndcg(hits, gold, 10).withColumn("ndcg", F.round("ndcg", 6))


@query("""
WITH d AS (SELECT CASE WHEN doc_id % 97 = 0 THEN 'again' || doc_id % 5 ELSE 'a' || doc_id END AS id, CASE WHEN doc_id % 11 = 0 THEN 'refusal' WHEN lang = 'en' THEN 'timeline' WHEN lang = 'de' THEN 'conflict' WHEN lang = 'fr' THEN 'viewpoint' END AS category, doc_id % 11 = 0 OR doc_id % 7 <> 0 AS fine FROM documents),
q AS (SELECT 'answer' AS source, id, category, fine, CASE WHEN category IS NULL THEN 'no_core_category' END AS broken FROM d
  UNION ALL SELECT 'intersection', 'intersection::' || doc_id, 'intersection', toxic = 0, NULL FROM labels
  UNION ALL SELECT 'structured', 's' || item_id, CASE WHEN item_id % 2 = 0 THEN 'timeline' ELSE 'organization' END, true,
    CASE WHEN item_id % 2 = 0 AND item_id % 3 = 0 THEN 'timeline_needs_category_and_year' WHEN item_id % 2 = 1 AND item_id % 5 = 0 THEN 'organization_needs_relationship' END FROM benchmark)
SELECT 'questions' AS rule, NULL AS key, count(*) AS found, CAST(1000000 AS BIGINT) AS needed FROM q HAVING count(*) < 1000000
UNION ALL SELECT 'category', m.category, count(q.id), m.least FROM (VALUES ('timeline', 50), ('intersection', 1), ('viewpoint', 10000000), ('event', 5), ('organization', 1), ('conflict', 1), ('refusal', 1)) m(category, least) LEFT JOIN q ON q.category = m.category GROUP BY m.category, m.least HAVING count(q.id) < m.least
UNION ALL SELECT 'evidence', source, count(*) FILTER (fine), count(*) FROM q GROUP BY source HAVING count(*) FILTER (fine) < count(*)
UNION ALL SELECT 'duplicate', id, count(*), 1 FROM q GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'contract', source || ':' || broken, count(*), 0 FROM q WHERE broken IS NOT NULL GROUP BY source, broken""")
def g23_composite_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answer questions, labels as cases of two people, benchmark items as structured questions: what keeps the set from passing."""
    key = F.col("doc_id")
    tags = F.when(F.col("lang") == "en", F.array(F.lit("x"), F.lit("timeline"))).when(F.col("lang") == "de", F.array(F.lit("conflict"))).when(F.col("lang") == "fr", F.array(F.lit(evaluation.OBSERVATION))).otherwise(F.array(F.lit("x")))
    name = F.when(key % 97 == 0, F.concat(F.lit("again"), (key % 5).cast("string"))).otherwise(F.concat(F.lit("a"), key.cast("string")))
    answers = evaluation.answer_questions(table(spark, sf_dir, "documents").select(name.alias("question_id"), tags.alias("tags"), (key % 11 != 0).alias("answerable"), (key % 7).alias("evidence")))
    cases = evaluation.intersection_questions(table(spark, sf_dir, "labels").select(key.cast("string").alias("id"), F.lit("e").alias("source_event_id"), F.when(F.col("toxic") == 0, "d").alias("document_id"), F.lit(3).alias("pdf_page")))
    item = F.col("item_id")
    odd, three, five = item % 2 == 1, item % 3 == 0, item % 5 == 0
    structured = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("s"), item.cast("string")).alias("question_id"), F.when(odd, "organization").otherwise("timeline").alias("kind"), F.when(odd, "organization").otherwise("timeline").alias("category"),
        F.when(~odd & ~three, 1950).alias("year"), F.when(odd, "1950-01").alias("at"), F.lit("e").alias("source_event_id"), F.when(odd & ~five, "r").alias("relationship_id"), F.lit("d").alias("document_id"), F.lit(1).alias("pdf_page"),
    )
    minimums = dict.fromkeys(evaluation.CORE_CATEGORIES, 1) | {"timeline": 50, "viewpoint": 10_000_000, "event": 5}
    return evaluation.audit_sets(answers.unionByName(cases).unionByName(evaluation.structured_questions(structured)), minimums, 1_000_000)


# Parsers and passes


@query()
def p12_parser_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of all html pages compared with the first (blocks of common text; tested by brute force)."""
    html = F.coalesce("html", F.lit(""))
    plain = lambda c: F.regexp_replace(c, "<[^>]*>", " ")
    bare = plain(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " "))
    paragraphs = F.array_join(F.transform(F.regexp_extract_all(html, F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), plain), "\n")
    read = table(spark, sf_dir, "pages").select("page_id", F.inline(F.array(*(F.struct(F.lit(n).alias("parser"), t.alias("text"), e.alias("error")) for n, t, e in (("bare", bare, F.lit(None).cast("string")), ("tags", plain(html), F.lit(None).cast("string")), ("paragraphs", paragraphs, F.when(F.col("page_id") % 17 == 0, "no parser")))))))
    rows = parsers.compare_parsers(read.select(F.col("page_id").alias("document_id"), F.lit(1).alias("pdf_page"), "parser", "text", "error"), "bare")
    return rows.select("document_id", "parser", "status", "character_count", "similarity")


@query(r"""
WITH p AS (SELECT page_id, page_id % 13 AS doc, page_id // 13 AS page, trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM pages WHERE page_id % 3 <> 0),
s AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN page_id % 10 = 0 ELSE false END AS reused FROM p),
n AS (SELECT *, CASE WHEN NOT reused THEN row_number() OVER (PARTITION BY reused ORDER BY doc, page) END AS place FROM s),
r AS (SELECT *, reused AS old, NOT reused AND place <= 60 AS made FROM n)
SELECT doc AS document_id, count(*) AS candidates, count(*) FILTER (made) AS processed, count(*) FILTER (old) AS reused, count(*) FILTER (made AND page_id % 11 = 0) AS failed,
  count(*) FILTER (NOT made AND NOT old) AS remaining, round(avg(CASE WHEN made AND page_id % 11 <> 0 THEN CAST(0.5 AS DOUBLE) + page_id % 4 / CAST(10 AS DOUBLE) WHEN old THEN CAST(1 AS DOUBLE) END), 6) AS confidence FROM r GROUP BY doc""")
def p6_ocr_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass of sixty pages over thirteen books of html pages, of which some were read before, some by another version."""
    key = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", "html", (key % 13).alias("document_id"), (key % 13).alias("place"), F.floor(key / 13).alias("pdf_page"), F.lit("h").alias("file_sha256"), F.when(key % 3 == 0, "extracted").otherwise("ocr_required").alias("status"), F.lit("").alias("normalized_text"), F.lit(1).alias("images"), F.array().cast("array<string>").alias("quality_flags"))
    done = rows.where((key % 5 == 0) & (key % 3 != 0)).select("document_id", "pdf_page", "file_sha256", F.lit("extracted").alias("status"), "normalized_text", F.lit(0).cast("long").alias("character_count"), F.lit(1.0).alias("ocr_confidence"), "quality_flags", F.when(key % 10 == 0, "v2").otherwise("v1").alias("extractor_version"), F.lit(None).cast("string").alias("error"))
    texts = rows.select("document_id", "pdf_page", "page_id", F.trim(F.regexp_replace("html", "<[^>]*>", "")).alias("text"))

    def engine(pages_to_read: DataFrame) -> DataFrame:
        read = pages_to_read.join(texts, ["document_id", "pdf_page"])
        return read.withColumns({"confidence": 0.5 + key % 4 / F.lit(10.0), "error": F.when(key % 11 == 0, "no engine")}).drop("page_id")

    _, summary = pages.ocr_pass(rows, done, engine, "v2", 60)
    return summary.drop("characters")


# Reports and packets


@query("""
WITH c AS (SELECT source AS doc, doc_id, text, lang FROM documents),
m AS (SELECT doc, count(*) FILTER (doc_id % 9 <> 0) AS effective_pages, count(*) FILTER (doc_id % 9 = 0) AS skipped_pages, count(*) FILTER (doc_id % 4 = 0) AS structure_entries, count(*) FILTER (doc_id % 9 <> 0) AS chunks,
  coalesce(sum(length(text)) FILTER (doc_id % 9 <> 0), 0)::BIGINT AS characters, count(*) FILTER (doc_id % 9 <> 0 AND lang = 'en') AS in_scope, count(*) FILTER (doc_id % 9 <> 0 AND lang = 'de') AS mixed, count(*) FILTER (doc_id % 9 <> 0 AND lang = 'fr') AS out_of_scope,
  count(*) FILTER (doc_id % 9 <> 0 AND (lang IS NULL OR lang NOT IN ('en', 'de', 'fr'))) AS unknown FROM c GROUP BY doc),
h AS (SELECT doc, sha256(string_agg(sha256('{"chunk_id":' || doc_id || ',"document_id":' || coalesce('"' || doc || '"', 'null') || ',"scope_status":' || coalesce('"' || CASE lang WHEN 'en' THEN 'in_scope' WHEN 'de' THEN 'mixed' WHEN 'fr' THEN 'out_of_scope' ELSE 'other' END || '"', 'null') || ',"text":"' || md5(text) || '"}'), chr(10) ORDER BY doc_id)) AS sha256 FROM c WHERE doc_id % 9 <> 0 GROUP BY doc),
a AS (SELECT sha256(string_agg(doc || ' ' || sha256, chr(10) ORDER BY doc)) AS sha256 FROM h)
SELECT doc AS document_id, effective_pages, skipped_pages, structure_entries, chunks, chunks * 32 AS characters, in_scope, mixed, out_of_scope, unknown, sha256 FROM m LEFT JOIN h USING (doc)
UNION ALL SELECT NULL, sum(effective_pages)::BIGINT, sum(skipped_pages)::BIGINT, sum(structure_entries)::BIGINT, sum(chunks)::BIGINT, sum(chunks * 32)::BIGINT, sum(in_scope)::BIGINT, sum(mixed)::BIGINT, sum(out_of_scope)::BIGINT, sum(unknown)::BIGINT, (SELECT sha256 FROM a) FROM m""")
def c16_chunk_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents, their rows as pages and chunks, languages as scopes: the summary of a build and its digests."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "doc_id", "lang", F.md5("text").alias("text"))
    scope = F.when(F.col("lang") == "en", "in_scope").when(F.col("lang") == "de", "mixed").when(F.col("lang") == "fr", "out_of_scope").otherwise("other")
    chunks = rows.where("doc_id % 9 <> 0").select("document_id", F.col("doc_id").alias("chunk_id"), "text", scope.alias("scope_status"))
    return reports.chunk_build(rows.select("document_id", (F.col("doc_id") % 9 != 0).alias("effective")), chunks, rows.where("doc_id % 4 = 0").select("document_id"))


SEED = "a seed"
_RANK = lambda *parts: "sha256(concat_ws('|', " + ", ".join(parts) + "))"


@query(f"""
WITH e AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS p FROM lineitem),
x AS (SELECT a.p AS first, b.p AS second, a.event_id, o_orderpriority AS event_type, o_custkey AS document_id, CAST(1 AS BIGINT) AS pdf_page FROM e a JOIN e b ON a.event_id = b.event_id AND a.p < b.p JOIN orders ON o_orderkey = a.event_id WHERE a.event_id % 10 <> 0),
v AS (SELECT l_orderkey AS event_id, l_suppkey, l_returnflag, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
y AS (SELECT a.l_suppkey AS first, b.l_suppkey AS second, a.event_id, arg_min(a.l_linenumber, (a.l_linenumber, a.l_partkey)) AS page FROM v a JOIN v b ON a.event_id = b.event_id AND a.l_returnflag = b.l_returnflag AND a.l_suppkey < b.l_suppkey GROUP BY ALL),
j AS (SELECT x.*, page FROM x LEFT JOIN y USING (first, second, event_id)),
n AS (SELECT first, second, count(*) AS n FROM j GROUP BY ALL HAVING count(page) >= 2 AND count(*) - count(page) >= 2 ORDER BY n DESC, first, second LIMIT 40),
r AS (SELECT j.*, row_number() OVER (PARTITION BY first, second, page IS NULL ORDER BY {_RANK(f"'{SEED}'", "first", "second", "event_id", "CASE WHEN page IS NULL THEN 'b' ELSE 'a' END")}) AS i FROM j JOIN n USING (first, second)),
c AS (SELECT first, second, event_id, event_type, document_id, coalesce(page, pdf_page)::BIGINT AS pdf_page, 'blind-' || {_RANK(f"'{packets.CASE}'", f"'{SEED}'", "first", "second", "event_id")}[:16] AS case_id FROM r WHERE i <= 2)
SELECT *, sha256('{{"case_id":"' || case_id || '","document_id":' || document_id || ',"event_id":' || event_id || ',"event_type":"' || event_type || '","first":' || first || ',"pdf_page":' || pdf_page || ',"second":' || second || '}}') AS case_checksum,
  row_number() OVER (ORDER BY {_RANK(f"'{SEED}'", "case_id", "'review-order'")}) AS place FROM c""")
def y28_review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two proven and two unproven orders of each of the forty pairs of suppliers that share most, for blind review."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    taking = lines.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("p")).distinct()
    both = taking.withColumnRenamed("p", "first").join(taking.withColumnRenamed("p", "second"), "event_id").where("first < second")
    anchors = both.join(orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type"), F.col("o_custkey").alias("document_id")), "event_id").select("first", "second", "event_id", "event_type", "document_id", F.lit(1).cast("long").alias("pdf_page"))
    side = lines.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("event_id"), "l_returnflag", "l_suppkey", "l_linenumber", "l_partkey")
    one, two = (side.withColumnRenamed("l_suppkey", n) for n in ("first", "second"))
    proven = one.join(two.select("event_id", "l_returnflag", "second"), ["event_id", "l_returnflag"]).where("first < second").join(orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("document_id")), "event_id")
    proofs = proven.select("first", "second", "event_id", "document_id", F.col("l_linenumber").cast("long").alias("pdf_page"), F.col("l_partkey").alias("evidence_id"))
    known = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("event_id"))
    return packets.review_packet(anchors, proofs, known, SEED, 40, 2).withColumn("place", F.col("place").cast("long"))


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n, list_sort(list_distinct(list(o_orderpriority))) AS s FROM orders WHERE year(o_orderdate) < 2000 GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS n, list_sort(list_distinct(list(o_orderpriority))) AS s FROM orders WHERE o_totalprice > 20000 AND year(o_orderdate) < 2000 GROUP BY 1),
j AS (SELECT b.k, CASE WHEN a.k IS NULL THEN 'created' WHEN a.n % 4 = b.n % 4 AND a.s = b.s THEN 'skipped' WHEN b.k % 7 = 0 OR b.k % 5 = 0 OR b.k % 3 = 0 THEN 'protected' ELSE 'updated' END AS action FROM b LEFT JOIN a ON a.k = b.k)
SELECT action, count(*) AS rows, sum(k)::BIGINT AS keys FROM j GROUP BY action""")
def y11_upsert_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders in two states, priorities being the evidence: what an upsert would do to each customer."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate") < 2000)
    key = F.col("k")

    def state(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = rows.groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") % 4).alias("n"))
        return own, rows.select(F.col("o_custkey").alias("k"), "o_orderpriority")

    (old, old_evidence), (new, new_evidence) = state(orders), state(orders.where("o_totalprice > 20000"))
    stored_rows = old.select("*", F.when(key % 7 == 0, "manual").otherwise("rule").alias("extraction_method"), F.when(key % 5 == 0, "v1").otherwise("v2").alias("extractor_version"), F.when(key % 3 == 0, "confirmed").otherwise("unreviewed").alias("review_status"))
    acted = upsert_generated(stored_rows, new.withColumn("extractor_version", F.lit("v2")), "k", ["n"], {"evidence": (old_evidence, new_evidence)})
    return acted.groupBy("action").agg(F.count("*").alias("rows"), F.sum("k").alias("keys"))
