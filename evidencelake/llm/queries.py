"""Queries of the text-preparation operators, by name, with SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.llm import fixity, language_id, lm_scoring, pieces, quality, secrets, toxicity, whitening
from evidencelake.llm._sample import crc_remainder
from evidencelake.llm._store import shared_folder
from evidencelake.llm.decontamination import contamination
from evidencelake.llm.fingerprints import fingerprint_edits
from evidencelake.llm.near_dedup import Similarity, near_duplicates
from evidencelake.llm.ngrams import flagged
from evidencelake.llm.prefix_trie import prefix_nodes
from evidencelake.llm.url_filters import judge_urls
from evidencelake.plans.tables import table as _table



def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, Jaccard similarity of 0.85 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), Similarity(words=3, percent=85))


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with those that ``labels`` calls good as the target."""
    return flagged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents against the good ones."""
    return lm_scoring.score_documents(_good(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; crc32(doc_id) mod 3 = 1 is held out of learning."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)))
    labels = _table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 3) != 1)
    found = toxicity.score_toxicity(docs, toxicity.learn(docs.where(~F.col("held_out")), labels), carry=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


#: The listed rules for urls.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls."""
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and whether they decode to the text."""
    import public_tokenizers

    vocabulary = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    rows = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    size = F.coalesce(F.size("tokens"), F.lit(0)).cast("long")
    return rows.select("doc_id", size.alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards the good ones; half of the rows are drawn."""
    return quality.resample(_table(spark, sf_dir, "documents"), _good(spark, sf_dir))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two replicas of the WARC records of all pages.

    In the second replica pages with crc32(page_id) mod 19 = 3 have their first
    character replaced, which the audit has to find; files of 1,000 records or so.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = max(1, pages.count() // 1000)
    broken = F.when(crc_remainder("page_id", 19) == 3, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    replicas = (pages, pages.withColumn("html", broken))
    return fixity.audit(*(fixity.Tree(fixity.lay_out(fixity.page_records(p), files)) for p in replicas))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; crc32(doc_id) mod 4 = 2 is held out of learning."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)))
    found = language_id.identify(docs, language_id.learn(docs.where(~F.col("held_out"))), carry=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in all documents."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_near")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared prefix of turns of all rebuilt conversations."""
    return prefix_nodes(_table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings on up to 32 components."""
    embeddings = _table(spark, sf_dir, "embeddings")
    whitened, model = whitening.whiten(embeddings)
    error = whitening.identity_error(whitening.usable(embeddings, "embedding"), "embedding", model) if model else None
    return whitening.by_component(whitened, model, error)


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: a ledger begins empty and one update scans every distinct text."""
    ledger = secrets.Ledger(spark, f"{shared_folder(spark)}/evidencelake-{uuid.uuid4().hex}/ledger")
    known = ledger.update(_table(spark, sf_dir, "documents"), path="doc_id")
    return secrets.secret_report(ledger, known).withColumnRenamed("path", "doc_id").withColumn("blob", F.lower(F.hex("blob")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_lm_scoring,
        op3_toxicity,
        op4_url_filters,
        op5_document_fingerprints,
        op6_sentencepiece,
        op7_quality_resampling,
        op8_warc_fixity,
        op9_language_id,
        op10_benchmark_decontamination,
        op11_conversation_prefix_trie,
        op12_embedding_whitening,
        op13_secret_scans,
    )
}



def _spans_sql() -> str:
    """Spans of every kind: the lengths of matches and of what lies between them add up to places."""
    size = "lambda x: length(x)"
    parts = []
    for place, r in enumerate(secrets.RULES):
        # a run of one class of characters, or a literal and such a run, may as well ask for its length itself
        pattern = r.pattern.replace("(?ai)", "(?i)").replace("'", "''")
        pattern = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}.get(r.kind, pattern)
        own = f"regexp_extract_all(t, '{pattern}', {r.group})"
        found = f"SELECT doc_id, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}') AS m, {own} AS g FROM texts WHERE regexp_matches(t, '{pattern}')"
        low = f"list_sum(list_transform(s[1 : i], {size})) + coalesce(list_sum(list_transform(m[1 : i - 1], {size})), 0)"
        parts.append(f"SELECT doc_id, '{r.kind}' AS kind, {place} AS place, {r.least} AS least, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'low': ({low})::BIGINT, 'n': length(m[i]), 'own': length(g[i])}})) AS x FROM ({found})")
    return " UNION ALL ".join(parts)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The others need Python: a field, automata, mined rules, samples or hashes that SQL lacks; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
        links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT DISTINCT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
        SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
        FROM sets LEFT JOIN least ON doc_id = x""",
    "op10_benchmark_decontamination": rf"""
        WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        wanted AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS part
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM wanted),
        had AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS part
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
        found AS (SELECT doc_id, item_id, i, h.n FROM had h JOIN wanted q ON h.n = q.n AND h.part = q.part),
        hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
        own AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
            sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN own ON d.doc_id = own.doc_id""",
    "op11_conversation_prefix_trie": """
        WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        keyed AS (SELECT conv_id, i, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS k FROM turns),
        crc AS (SELECT conv_id, max(i) AS n, xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT),
                lambda c, b: list_reduce(range(8)::UBIGINT[], lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(c, b)),
                4294967295::UBIGINT)) % 9 AS h FROM turns GROUP BY conv_id),
        lead AS (SELECT c.conv_id, i AS d, k, bytes FROM crc c JOIN keyed t ON t.conv_id = c.conv_id - c.conv_id % 5 AND i <= h),
        had AS (SELECT c.conv_id, count(l.d) AS m FROM crc c LEFT JOIN lead l ON c.conv_id = l.conv_id GROUP BY c.conv_id),
        again AS (SELECT * FROM lead UNION ALL
            SELECT c.conv_id, m + i - h, k, bytes FROM crc c JOIN had USING (conv_id) JOIN keyed t ON t.conv_id = c.conv_id AND i > h),
        paths AS (SELECT c.conv_id, coalesce(list(k ORDER BY d) FILTER (d IS NOT NULL), []) AS p, coalesce(list(bytes ORDER BY d) FILTER (d IS NOT NULL), []) AS b
            FROM crc c LEFT JOIN again a ON c.conv_id = a.conv_id GROUP BY c.conv_id),
        members AS (SELECT conv_id, len(p) AS n, unnest(range(0, len(p) + 1)) AS d, p, b FROM paths),
        nodes AS (SELECT array_to_string(p[1 : d], '') AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d = 0 THEN 0 ELSE b[d] END) AS bytes,
                coalesce(array_to_string(list(conv_id ORDER BY conv_id) FILTER (n = d), ','), '') AS ends FROM members GROUP BY 1, 2),
        kids AS (SELECT left(node, 64 * (d - 1)) AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
        up AS (SELECT left(node, 64 * a) AS node, a AS d, sum(leaf) AS n_leaves, sum(saved) AS saved FROM
            (SELECT n.node, unnest(range(0, n.d + 1)) AS a, CASE WHEN k.node IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * bytes AS saved
                FROM nodes n LEFT JOIN kids k ON n.node = k.node AND n.d = k.d) GROUP BY 1, 2)
        SELECT n.conv_id, n.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
            n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN up ON up.node = n.node AND up.d = n.d LEFT JOIN kids k ON k.node = n.node AND k.d = n.d
            LEFT JOIN nodes parent ON n.d > 0 AND parent.node = left(n.node, 64 * (n.d - 1)) AND parent.d = n.d - 1""",
    "op13_secret_scans": f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        every AS (SELECT doc_id, kind, place, x.low AS low, concat_ws(':', kind, x.low, x.low + x.n) AS span FROM ({_spans_sql()}) WHERE x.own >= least),
        own AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(span, ',' ORDER BY low, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY low, place) AS spans FROM every GROUP BY doc_id)
        SELECT doc_id, sha256(t) AS blob, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM texts LEFT JOIN own USING (doc_id)""",
}
