"""Every opN query on the smallest tables: its columns, and what they must be by brute force or SQL."""

import hashlib
import os
import re
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from evidencelake.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def run(spark, name):
    rows = [r.asDict(True) for r in QUERIES[name](spark, DATA).collect()]
    key = "page_id" if name.startswith("op4") else "doc_id"
    if not name.startswith("op8"):
        assert len(rows) == len(table("pages" if key == "page_id" else "documents"))
    return rows, {r.get(key): r for r in rows}


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    wanted = connection.execute(ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    got = QUERIES[name](spark, DATA).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


def test_op2_counts_all_documents(spark):
    rows, _ = run(spark, "op2_lm_scoring")
    assert all((r["difference"] is None) == (r["n_tokens"] == 0) for r in rows)


def test_op3_scores_and_holds_out(spark):
    rows, _ = run(spark, "op3_toxicity")
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], 3) == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_op4_fits_the_listed_rules(spark):
    _, got = run(spark, "op4_url_filters")
    for p in table("pages"):
        r, url = got[p["page_id"]], p["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        assert (r["host"], r["path"]) == (host, path)
        fits = []
        for verdict, rule in URL_RULES:
            name, slash, start = rule.partition("/")
            if (host == name or host.endswith(f".{name}")) and path.startswith(slash + start):
                fits.append((len(rule), rule, verdict))
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] in ("allow", "block") and (not fits or r["verdict"] == max(fits)[2])


def test_op5_edits_by_the_next_document(spark):
    _, got = run(spark, "op5_document_fingerprints")
    docs = sorted(table("documents"), key=lambda d: -d["doc_id"])
    same = {}
    for d, following in zip(docs, docs[1:] + docs[:1], strict=True):
        r, text = got[d["doc_id"]], d["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + (following["text"] or "")[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert same.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_op6_round_trips(spark):
    rows, _ = run(spark, "op6_sentencepiece")
    assert all(r["round_trip"] for r in rows)


def test_op7_draws_half(spark):
    rows, _ = run(spark, "op7_quality_resampling")
    assert sum(r["selected"] for r in rows) == -(-len(rows) // 2)
    assert min(r["key"] for r in rows if r["selected"]) >= max(r["key"] for r in rows if not r["selected"])


def test_op8_finds_the_changed_pages(spark):
    rows, _ = run(spark, "op8_warc_fixity")
    changed = sorted(str(p["page_id"]) for p in table("pages") if remainder(p["page_id"], 19) == 3 and p["html"] is not None and p["html"][:1] != "#")
    assert sorted(r["record_id"] for r in rows if r["status"] == "corrupt") == changed
    assert {r["status"] for r in rows} <= {"corrupt", "moved"} and all(r["hash_one"] != r["hash_two"] for r in rows if r["status"] == "corrupt")


def test_op9_learns_and_holds_out(spark):
    rows, _ = run(spark, "op9_language_id")
    docs = {d["doc_id"]: d for d in table("documents")}
    learned = {d["lang"] for d in docs.values() if d["lang"] is not None and remainder(d["doc_id"], 4) != 2}
    right = []
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")
        assert r["lang_pred"] in learned if letters else r["lang_pred"] == "und"
        if r["held_out"] and letters and docs[r["doc_id"]]["lang"]:
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert sum(right) >= 0.95 * len(right)
