"""Stored indexes, searches, parsers, passes, packets and upserts on small tables."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import evaluation, keyword, packets, pages, parsers, ranges, reports, research, resolve, search, stored

TEXTS = [(1, "one two two"), (2, "two, three!"), (3, ""), (4, None), (5, "three three three four")]


def chunks(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "chunk_id long, text string")


def test_keyword_index_is_published_as_a_whole(spark, tmp_path):
    store = stored.Store(spark, f"file://{tmp_path}/index")
    assert store.current() is None and store.runs().count() == 0
    with pytest.raises(stored.BuildError):
        store.table("postings")
    first = stored.build_keyword(store, chunks(spark), {"inputs": "a"})
    assert (first.number, first.manifest) == (1, {"inputs": "a", "chunks": 5, "postings": 6, "words": 9})
    asked = spark.createDataFrame([(1, "two"), (1, "three")], "query_id long, term string")
    wanted = {(r["chunk_id"], round(r["raw"], 9)) for r in keyword.scores(asked, keyword.build_index(chunks(spark))).collect()}
    got = {(r["chunk_id"], round(r["raw"], 9)) for r in keyword.scores(asked, stored.stored_keyword(store)).collect()}
    assert got == wanted and {c for c, _ in got} == {1, 2, 5}
    second = stored.build_keyword(store, chunks(spark, TEXTS[:2]))
    assert store.current() == second and store.table("metadata").count() == 2 and store.table("metadata", first).count() == 5
    with pytest.raises(stored.BuildError, match="repeated chunks"):
        stored.build_keyword(store, chunks(spark, [*TEXTS, TEXTS[0]]))
    assert store.current() == second
    back = store.roll_back()
    assert (back.number, back.name) == (3, first.name) and store.table("metadata").count() == 5
    assert [(r["operation"], r["status"]) for r in store.runs().orderBy("finished_at").collect()] == [("keyword_index", "published"), ("keyword_index", "published"), ("keyword_index", "failed"), ("roll_back", "published")]
    with pytest.raises(stored.BuildError):
        store.roll_back(5)


def test_two_writers_take_two_numbers(spark, tmp_path):
    one, two = (stored.Store(spark, f"file://{tmp_path}/index") for _ in "ab")
    points = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    stored.build_vectors(one, points)
    taken = two._point("elsewhere", {})
    assert taken.number == 2 and one._point("again", {}).number == 3
    (tmp_path / "index/pointers/0000000009").write_text("")  # a pointer that is still being written
    assert one.current().number == 3


def test_vector_builds_are_checked(spark, tmp_path):
    store = stored.Store(spark, f"file://{tmp_path}/index")
    kind = "id long, vector array<double>"
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], kind)
    assert stored.build_vectors(store, good, good.select(F.col("id").alias("chunk_id"))).manifest == {"points": 2, "dimension": 2}
    for rows in ([(1, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [float("nan")])], [(1, None)]):
        with pytest.raises(stored.BuildError):
            stored.build_vectors(store, spark.createDataFrame(rows, kind))
    for ids in ([1], [1, 3], [1, 2, 3]):
        with pytest.raises(stored.BuildError, match="chunks"):
            stored.build_vectors(store, good, spark.createDataFrame([(i,) for i in ids], "chunk_id long"))
    assert store.current().number == 1


def test_embedding_text(spark):
    rows = spark.createDataFrame([("题", ["上", "下"], "文"), ("题", [], "文"), (None, None, " 文 ")], "title string, path array<string>, text string")
    assert [r[0] for r in rows.select(stored.embedding_text(F.col("title"), F.col("path"), F.col("text"))).collect()] == ["题\n上 > 下\n文", "题\n\n文", "文"]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, rank int")


def test_searches_lose_branches(spark):
    words, near = ranked(spark, [(1, 10, 1), (1, 11, 2)]), ranked(spark, [(1, 11, 1), (1, 12, 2)])
    both = search.hybrid(lambda: words, lambda: near, 2)
    assert both.mode == "hybrid_rrf" and not both.lost and [r["id"] for r in both.hits.orderBy("rank").collect()] == [11, 10]
    failing = near.withColumn("id", F.when(F.col("id") == 12, F.raise_error(F.lit("damaged"))).otherwise(F.col("id")))
    for lost in (lambda: failing, lambda: near.select("nothing"), lambda: 1 / 0):
        one = search.hybrid(lambda: words, lost, 1)
        assert one.mode == "keyword_only" and list(one.lost) == ["vector"]
        assert [(r["id"], r["keyword_rank"], r["vector_rank"], r["rrf_score"], r["rank"]) for r in one.hits.collect()] == [(10, 1, None, None, 1)]
    assert search.hybrid(lambda: failing, lambda: near, 5).mode == "vector_only"
    with pytest.raises(search.SearchError):
        search.hybrid(lambda: failing, lambda: 1 / 0, 5)
    assert [search.candidates(k, c) for k, c in ((1, 0), (10, 0), (50, 0), (5, 4))] == [30, 40, 100, 48]


def test_planned_searches(spark):
    kind = "query_id long, variant string, id long, rank int"
    words = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 11, 2)], kind)
    near = spark.createDataFrame([(1, "a", 11, 1), (1, "b", 11, 1), (1, "b", 13, 2)], kind)
    found, gaps = search.planned(lambda: words, lambda: near, 2, 5)
    assert found.mode == "planned_hybrid_rrf" and [(r["id"], r["variants"]) for r in found.hits.orderBy("rank").collect()] == [(11, 2), (10, 1)]
    assert [tuple(r) for r in gaps.collect()] == [(1, "b")]
    found, _ = search.planned(lambda: 1 / 0, lambda: near, 2, 5)
    assert found.mode == "planned_vector_only" and list(found.lost) == ["keyword"]


def test_similarity_is_that_of_matching_blocks():
    r = random.Random(2)
    texts = ["", "a", "abcd", "bcde", "aaaa", "aaab", "中文字", "文字中文", "\U0001f600x\U0001f600"]
    for alphabet, n in (("ab", 60), ("abcdefgh", 200), ("的一是不了人我在有他这", 300)):
        base = r.choices(alphabet, k=n)
        texts.append("".join(base))
        for _ in range(n // 8):
            base[r.randrange(n)] = r.choice(alphabet)
        texts.append("".join(base))
    for a in texts:
        for b in texts:
            assert parsers.similarity(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)


def test_parsers_are_compared(spark):
    rows = [("d", 1, "one", "甲 乙\n丙", None), ("d", 1, "two", "甲乙丁�", None), ("d", 1, "three", None, "Broken: x"), ("d", 2, "one", None, None), ("d", 2, "two", "x", None), ("d", 2, "three", "", None)]
    frame = spark.createDataFrame(rows, "document_id string, pdf_page int, parser string, text string, error string")
    got = {(r["pdf_page"], r["parser"]): r for r in parsers.compare_parsers(frame, "one").collect()}
    assert len(got) == 6 and got[1, "one"]["similarity"] == 1.0 and got[1, "two"]["similarity"] == round(4 / 7, 4)
    assert (got[1, "two"]["character_count"], got[1, "two"]["cjk_character_count"], got[1, "two"]["replacement_character_count"]) == (4, 3, 1)
    assert (got[1, "three"]["status"], got[1, "three"]["similarity"], got[1, "three"]["error"]) == ("failed", None, "Broken: x")
    assert (got[2, "one"]["status"], got[2, "two"]["similarity"], got[2, "three"]["similarity"]) == ("failed", 0.0, 1.0)
    assert got[1, "one"]["preview"] == "甲 乙 丙"
    assert parsers.compare_parsers(frame.limit(0), "one").count() == 0


def test_places_in_a_total_order(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int").repartition(5)
    assert all(r["place"] == r["v"] + 1 for r in ranges.numbered(rows, "v").collect())
    assert ranges.numbered(rows.limit(0), "v").count() == 0


def hit(query, rank, start, end=None, document="doc"):
    return (query, rank, document, start, end)


def test_greedy_ndcg(spark):
    import math

    hits = [hit(1, 1, 99), hit(1, 2, 10), hit(1, 3, 11), hit(2, 1, 10), hit(2, 2, 10), hit(2, 3, 11), hit(3, 1, 10, 11), hit(3, 2, 10, 11), hit(4, 1, 10), hit(6, 1, 10, 12, "other"), hit(7, 1, 9, 10), hit(7, 2, 10, 11)]
    gold = [(q, "doc", p, g, q != 4) for q in (1, 2, 3, 4, 6, 7) for p, g in ((10, 2), (11, 1))] + [(5, "doc", 1, 0, True)]
    rows = evaluation.greedy_ndcg(spark.createDataFrame(hits, "query_id int, rank int, document_id string, start int, end int"), spark.createDataFrame(gold, "query_id int, document_id string, page int, grade int, complete boolean"), 5).collect()
    got, ideal = {r["query_id"]: (r["ndcg"], r["reason"]) for r in rows}, 3 + 1 / math.log2(3)
    assert got[1] == (pytest.approx((3 / math.log2(3) + 1 / math.log2(4)) / ideal), "evaluated")
    assert got[2] == (pytest.approx((3 + 1 / math.log2(4)) / ideal), "evaluated")
    assert got[3] == (None, "ambiguous_pages") and got[4] == (None, "incomplete_or_no_gain") and got[5] == (None, "incomplete_or_no_gain")
    assert got[6] == (0.0, "evaluated")
    assert got[7] == (pytest.approx(1.0), "evaluated")  # the second hit still gains for the page that the first did not take


def test_ocr_pass_goes_on_within_its_budget(spark):
    kind = "document_id string, place int, pdf_page int, file_sha256 string, status string, normalized_text string, images int, quality_flags array<string>"
    records = spark.createDataFrame(
        [("b", 1, p, "h", "ocr_required", "", 1, ["image_only_page"]) for p in (1, 2, 3)] + [("a", 2, p, "h", "ocr_required", "旧", 0, []) for p in (1, 2)] + [("a", 2, 9, "h", "extracted", "x", 0, [])], kind)
    empty = "document_id string, pdf_page int, file_sha256 string, status string, normalized_text string, character_count long, ocr_confidence double, quality_flags array<string>, extractor_version string, error string"
    nothing = spark.createDataFrame([], empty)
    asked = []

    def engine(rows):
        asked.append(sorted((r["document_id"], r["pdf_page"]) for r in rows.collect()))
        error = F.when((F.col("document_id") == "b") & (F.col("pdf_page") == 2), "no image")
        return rows.withColumns({"text": F.when(F.col("document_id") == "a", "很短").otherwise("这一页读出了许多字" * 4), "confidence": F.lit(0.5), "error": error})

    first, summary = pages.ocr_pass(records, nothing, engine, "v1", 4)
    assert asked == [[("a", 1), ("b", 1), ("b", 2), ("b", 3)]]
    rows = {(r["document_id"], r["pdf_page"]): r for r in first.collect()}
    assert rows["b", 2]["status"] == "failed" and rows["b", 2]["ocr_confidence"] is None
    assert "ocr_from_image_only_page" in rows["b", 1]["quality_flags"] and {"ocr_from_existing_text_layer", "ocr_low_substantive_text"} <= set(rows["a", 1]["quality_flags"])
    columns = ["document_id", "candidates", "processed", "reused", "failed", "remaining"]
    assert [tuple(r) for r in summary.select(columns).orderBy("document_id").collect()] == [("a", 2, 1, 0, 0, 1), ("b", 3, 3, 0, 1, 0)]
    second, summary = pages.ocr_pass(records, first, engine, "v1")
    assert asked[1] == [("a", 2), ("b", 2)] and second.count() == 5  # what failed is tried again
    assert [tuple(r) for r in summary.select(columns).orderBy("document_id").collect()] == [("a", 2, 1, 1, 0, 0), ("b", 3, 1, 2, 1, 0)]
    pages.ocr_pass(records, second, engine, "v2", selected=spark.createDataFrame([("b", 3), ("a", 9)], "document_id string, pdf_page int"))
    assert asked[2] == [("b", 3)]


def test_packets(spark):
    anchors = spark.createDataFrame([(f, s, e, f"n{e}", "d", 1) for f, s, events in (("a", "b", range(6)), ("a", "c", range(4)), ("b", "c", range(3))) for e in events], "first string, second string, event_id int, name string, document_id string, pdf_page int")
    proven = spark.createDataFrame([("a", "b", 1, "p", 7, "e2"), ("a", "b", 1, "p", 5, "e1"), ("a", "b", 2, "p", 3, "e3"), ("a", "c", 1, "p", 3, "e4")], "first string, second string, event_id int, document_id string, pdf_page int, evidence_id string")
    known = spark.createDataFrame([(5,)], "event_id int")
    fields = ["first", "second", "event_id", "name", "document_id", "pdf_page"]
    packet = packets.review_packet(anchors, proven, known, "s", 5, 1).cache()
    rows = packet.orderBy("place").collect()
    assert [r["place"] for r in rows] == [1, 2, 3, 4] and {(r["first"], r["second"]) for r in rows} == {("a", "b"), ("a", "c")}
    assert {(r["document_id"], r["pdf_page"]) for r in rows if r["document_id"] == "p"} <= {("p", 5), ("p", 3)} and sum(r["document_id"] == "p" for r in rows) == 2
    assert all(r["event_id"] != 5 for r in rows)
    assert [tuple(r) for r in packets.review_packet(anchors, proven, known, "s", 5, 1).orderBy("place").collect()] == [tuple(r) for r in rows]
    assert packets.review_packet(anchors, proven, known, "s", 1, 2).count() == 4
    good = {"expected": F.lit(True), "reason": F.lit("看过整页后的判断"), "reviewed_by": F.lit("a"), "reviewed_at": F.lit("2026-01-02")}
    cases = [({}, None), ({"name": F.lit("x")}, "content_changed"), ({"expected": F.lit(None).cast("boolean")}, "label_missing"), ({"reason": F.lit(" ")}, "reason_missing"), ({"reason": F.lit("Connected.")}, "reason_generic"), ({"reviewed_by": F.lit(None).cast("string")}, "reviewer_missing"), ({"reviewed_at": F.lit("02/01/2026")}, "date_not_iso")]
    for changes, wanted in cases:
        errors = packets.packet_errors(packet.withColumns(good).withColumns(changes), fields)
        assert {r["error"] for r in errors.collect()} == ({wanted} if wanted else set())
    assert packets.packet_errors(packet.withColumns(good).withColumn("reason", F.lit("yes")), fields, generic=True).count() == 0


def test_upserts_by_content(spark):
    kind = "id int, name string, extraction_method string, extractor_version string, review_status string"
    current = spark.createDataFrame([(1, "a", "rule", "v", "unreviewed"), (2, "a", "rule", "v", "unreviewed"), (3, "a", "rule", "v", "needs_review"), (4, "a", "rule", "v", "confirmed"), (5, "a", "rule", "old", "unreviewed"), (6, "a", "manual", "v", "unreviewed"), (7, None, "rule", "v", "confirmed")], kind)
    new = spark.createDataFrame([(1, "a", "v"), (2, "a", "v"), (3, "b", "v"), (4, "b", "v"), (5, "b", "v"), (6, "b", "v"), (7, None, "v"), (8, "a", "v")], "id int, name string, extractor_version string")
    child = "id int, evidence_id string"
    old_rows, new_rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], child), spark.createDataFrame([(1, "y"), (1, "x"), (1, "x"), (2, "z")], child)
    got = {r["id"]: r["action"] for r in research.upsert_generated(current, new, "id", ["name"], {"evidence": (old_rows, new_rows)}).collect()}
    assert got == {1: "skipped", 2: "updated", 3: "updated", 4: "protected", 5: "protected", 6: "protected", 7: "skipped", 8: "created"}


def test_build_warnings(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "document_id string, chunk_id int, text string")
    digest = reports.digest_of(reports.artifact_digests(rows, "document_id", ["chunk_id"]), "document_id")
    same = reports.digest_of(reports.artifact_digests(rows.repartition(3), "document_id", ["chunk_id"]), "document_id")
    assert digest.first() == same.first()
    other = reports.digest_of(reports.artifact_digests(rows.withColumn("text", F.upper("text")), "document_id", ["chunk_id"]), "document_id")
    builds = spark.createDataFrame([("r1", 1, True, "gone"), ("r2", 2, False, digest.first()[0])], "run_id string, finished_at int, whole boolean, sha256 string")
    said = lambda b, d: sorted(r[0] for r in reports.build_warnings(b, d).collect())
    assert said(builds, digest) == ["partial_build"] and said(builds, other) == ["artifacts_changed", "partial_build"]
    assert said(builds.limit(0), digest) == ["no_build"]


def test_canonical_candidates(spark):
    kind = "component int, event_id int, name string, event_type string, start_value string, precision string, certainty string, end_value string, location string, organizations array<string>, description string, documents array<string>, review_status string, confidence double"
    row = lambda c, i, **more: tuple({"component": c, "event_id": i, "name": f"n{i}", "event_type": "activity", "start_value": "1950-01-01", "precision": "day", "certainty": "exact", "end_value": None, "location": None, "organizations": [f"o{i}"], "description": "d" * i, "documents": ["x"], "review_status": "unreviewed", "confidence": 0.9, **more}.values())
    rows = [row(1, 1), row(1, 2, event_type="meeting", certainty="inferred"), row(3, 3), row(3, 4, precision="month"), row(5, 5, certainty="inferred"), row(5, 6, certainty="inferred"), row(7, 7, event_type="visit"), row(7, 8, event_type="meeting", review_status="confirmed"), row(7, 9, organizations=None)]
    pair = lambda c, a, b, **more: tuple({"component": c, "a": a, "b": b, "relation": "exact_day", "score": 0.9, "containment": 0.8, "jaccard": 0.5, "shared": 1, "mutual": True, **more}.values())
    pairs = [pair(1, 1, 2), pair(3, 3, 4), pair(5, 5, 6), pair(7, 7, 8), pair(7, 8, 9, score=0.7)]
    members, scored = spark.createDataFrame(rows, kind), spark.createDataFrame(pairs, "component int, a int, b int, relation string, score double, containment double, jaccard double, shared int, mutual boolean")
    got = {r["component"]: r for r in resolve.canonical_candidates(members, scored, "v1").collect()}
    assert {c: (r["candidate_kind"], r["review_status"]) for c, r in got.items()} == {1: ("high_confidence", "unreviewed"), 3: ("uncertain", "needs_review"), 5: ("uncertain", "needs_review"), 7: ("uncertain", "needs_review")}
    assert (got[1]["event_type"], got[1]["representative_id"], got[1]["organizations"]) == ("meeting", 1, ["o1", "o2"])
    assert (got[7]["event_type"], got[7]["representative_id"], got[7]["organizations"], got[7]["confidence"]) == ("meeting", 8, ["o7", "o8"], 0.8)
    hashes = lambda m, s, v="v1": {r["component"]: r["input_hash"] for r in resolve.canonical_candidates(m, s, v).collect()}
    base = hashes(members, scored)
    assert hashes(members.repartition(3), scored) == base and not set(hashes(members, scored, "v2").values()) & set(base.values())
    changed = hashes(members.withColumn("location", F.when(F.col("event_id") == 9, "there")), scored)
    assert changed[7] != base[7] and changed[1] == base[1]
    for low in ({"containment": 0.7}, {"mutual": False}, {"relation": "same_month"}, {"score": 0.79}):
        weak = spark.createDataFrame([pair(1, 1, 2, **low)], scored.schema)
        assert resolve.canonical_candidates(members.where("component = 1"), weak, "v1").first()["candidate_kind"] == "uncertain"
