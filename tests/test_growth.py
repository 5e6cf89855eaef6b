"""Steps that the larger tables of round 3 found wrong or growing too fast, on small tables that show it."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.functions import dates
from evidencelake.operators import holding, joint, keyword, meeting, pages, positions, resolve, segments, stored, vector
from evidencelake.operators.best import Best
from evidencelake.plans import answers, research, retrieval


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(folder, sql, *names):
    connection = duckdb.connect()
    for name in names:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return sorted(connection.sql(sql).fetchall())


def test_index_tokens_of_years_equal_sql(spark, tmp_path):
    rows = [(1, "In 1950 and 1950, x1812y 2085.5"), (2, "1950"), (3, None), (4, "")]
    folder = written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    wanted = by_sql(folder, retrieval.ORACLE_SQL["k2_index_tokens"], "documents")
    assert sorted(map(tuple, retrieval.k2_index_tokens(spark, folder).select("term", "tokens", "documents").collect())) == wanted
    assert ("1950", 3, 2) in wanted


def test_nearest_vectors_tie_at_six_places(spark):
    # a batch of twelve points, all but equal: the smaller ids are the farther ones by less than what is ranked
    points = spark.createDataFrame([(i, [1.0, 1e-4 * (13 - i)]) for i in range(1, 13)], "id long, vector array<float>").coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    got = [(r["id"], r["rank"]) for r in vector.search(points, asked, 3).orderBy("rank").collect()]
    wanted = sorted(((-round(1 / (1 + (1e-4 * (13 - i)) ** 2) ** 0.5, 6), i) for i in range(1, 13)))[:3]
    assert got == [(i, n + 1) for n, (_, i) in enumerate(wanted)]


def test_best_holds_what_a_whole_sort_finds():
    random = np.random.default_rng(3)
    scores, ids = np.round(random.random((5, 400)), 1), random.permutation(400)
    scores[:, ::7] = -np.inf
    best = Best(5, 9)
    for low in range(0, 400, 37):
        best.add(0, scores[:2, low : low + 37], ids[low : low + 37])
        best.add(2, scores[2:, low : low + 37], ids[low : low + 37])
    for q in range(5):
        order = np.lexsort((ids, -scores[q]))[:9]
        assert best.id[q].tolist() == ids[order].tolist() and best.score[q].tolist() == scores[q][order].tolist()
    assert sum(len(b) for b in Best(3, 4).batches(np.arange(3), ("a", "b", "c"))) == 0


def test_words_are_counted_in_their_row(spark):
    texts = [(1, "b a b, A!"), (2, ""), (3, None), (4, "..."), (5, "é é z2")]
    got = {r["chunk_id"]: (r["length"], r["terms"], r["tfs"]) for r in keyword.counted(spark.createDataFrame(texts, "chunk_id long, text string")).collect()}
    assert got == {1: (4, ["a", "b"], [2, 2]), 2: (0, [], []), 3: (None, [], []), 4: (0, [], []), 5: (3, ["z2", "é"], [1, 2])}


def test_best_chunks_are_those_of_the_whole_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword, "BLOCK", 3)  # several blocks of queries
    words = "a b c d e f g h".split()
    texts = [(i, " ".join(words[(i * j) % (3 + i % 6)] for j in range(i % 9))) for i in range(150)] + [(150, None)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    store = stored.Store(spark, f"file://{tmp_path}/index")
    stored.build_keyword(store, chunks)
    index = stored.stored_keyword(store)
    asked = spark.createDataFrame([(q, w) for q in range(4) for w in words[q : q + 4] + ["unknown"]], "query_id long, term string")
    whole = keyword.scores(asked, keyword.build_index(chunks)).withColumn("score", F.round("raw", 6))
    wanted = keyword.top(whole, 7, F.col("score")).select("query_id", "chunk_id", "score", "rank")
    found = keyword.best(asked, index, 7)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect())) == sorted(map(tuple, wanted.collect()))
    # no row of a pair of query and chunk is shuffled: a join would have stood before the scoring
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    gains = chunks.where("chunk_id % 2 = 0").select("chunk_id", (F.col("chunk_id") % 3 * 1.0).alias("gain"))
    boosted = keyword.top(whole.join(gains, "chunk_id").withColumn("score", F.round(F.col("raw") + F.col("gain"), 6)), 7, F.col("score"))
    assert sorted(map(tuple, keyword.best(asked, index, 7, gains).select("query_id", "chunk_id", "score").collect())) == sorted(map(tuple, boosted.select("query_id", "chunk_id", "score").collect()))
    groups = chunks.select("chunk_id", F.when(F.col("chunk_id") % 5 > 0, F.concat(F.lit("g"), (F.col("chunk_id") % 5).cast("string"))).alias("group"))
    over = whole.where("raw > 0.6").join(groups, "chunk_id").select("query_id", "group").distinct()
    assert sorted(map(str, keyword.groups_over(asked, index, 0.6, groups).collect())) == sorted(map(str, over.collect()))


def test_postings_that_are_not_those_of_the_words_are_refused(spark):
    words = keyword.counted(spark.createDataFrame([(1, "a b"), (2, "b b")], "chunk_id long, text string")).withColumn("text_sha256", F.lit("")).drop("text")
    tables = {"words": words, "postings": stored._postings(words), "metadata": words.select("chunk_id", "length"), "statistics": words.agg(F.count("*").alias("n"), F.avg("length").alias("average"))}
    assert stored.check_keyword(tables, 2) == {"chunks": 2, "postings": 3, "words": 4}
    with pytest.raises(stored.BuildError, match="postings"):  # another chunk's posting, counts and sums as they were
        stored.check_keyword(tables | {"postings": tables["postings"].withColumn("chunk_id", F.lit(1).cast("long"))})


def test_listed_pages_are_not_carried_by_records(spark):
    records = spark.createDataFrame([(d, p, [], 9) for d in (1, 2, 3) for p in (1, 2)], "document_id long, pdf_page long, quality_flags array<string>, character_count long")
    catalog = spark.createDataFrame([(1, "pages", [2, 2, None]), (2, "full", None), (3, "pages", [])], "document_id long, ocr_strategy string, ocr_pages array<long>")
    found = pages.with_ocr_policy(records, catalog)
    assert sorted((r["document_id"], r["pdf_page"], r["status"]) for r in found.collect()) == [(1, 1, "extracted"), (1, 2, "ocr_required"), (2, 1, "ocr_required"), (2, 2, "ocr_required"), (3, 1, "extracted"), (3, 2, "extracted")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(ocr_pages" not in plan


def test_a_phrase_is_worked_out_once(spark):
    rows = spark.createDataFrame([("国务院副总理",), ("学校校长",), ("和平部长和主席",), ("外交部长",), (None,)], "t string")
    found = rows.select(positions.position(F.col("t")).alias("p"))
    assert [tuple(r["p"]) if r["p"] else None for r in found.collect()] == [("国务院", "副总理"), None, None, ("外交部", "部长"), None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3, plan.count("regexp_replace")


def test_month_pairs_lose_no_candidate_and_send_no_texts_to_the_driver(spark):
    random = np.random.default_rng(5)
    starts, people, words = ["1950-01-02", "1950-01-02", "1950-01-03", "1950-01", "1950"], "pqr", "abcd"
    rows = []
    for i in range(240):
        text = "".join(random.choice(list(words), int(random.integers(0, 14)))) if i % 3 else ("abcdefghij" if i % 2 else "jihgfe")[: int(random.integers(3, 11))] + random.choice(list(words))
        who = [str(p) for p in random.choice(list(people), int(random.integers(0, 4)))] + ([None] if i % 9 == 0 else [])
        about = [str(people[i % 3])] if i % 4 else []
        rows.append((i, starts[i % 5], ["visit", "activity"][i % 2], text, None if i % 11 == 0 else who, [f"o{i % 3}"], [None, "here", ""][i % 3], [f"d{i % 4}"], about))
    events = spark.createDataFrame(rows, "event_id long, start_value string, event_type string, description string, people array<string>, organizations array<string>, location string, documents array<string>, subjects array<string>")

    def grams(text):
        return {text[j : j + 2] for j in range(len(text) - 1)} or ({text} if text else set())

    def wanted(least):
        for a, s, k, x, p, o, w, d, u in rows:
            for b, t, l, y, q, r, v, e, z in rows:
                if a >= b or s[:7] != t[:7] or set(d) & set(e):
                    continue
                g, h = grams(x), grams(y)
                i = len(g & h)
                c, j = (i / min(len(g), len(h)), i / len(g | h)) if g and h else (0.0, 0.0)
                shared = set(filter(None, p or [])) & set(filter(None, q or []))
                mutual = len({*u, *z}) >= 2 and {*u, *z} <= shared
                relation = "exact_day" if s == t and len(s) == 10 else "same_value" if s == t else "same_month"
                score = round(min(1, {"exact_day": 0.34, "same_value": 0.24, "same_month": 0.18}[relation] + 0.22 * c + 0.1 * j + 0.07 * min(len(shared), 2) + 0.1 * mutual + 0.04 * bool(set(o) & set(r)) + 0.03 * (w == v and bool(w)) + 0.03 * (k == l == "visit")), 6)
                c, j = round(c, 6), round(j, 6)
                if relation == "exact_day" and (score >= least or c >= 0.82 and j >= 0.55) or relation != "exact_day" and score >= max(0.6, least - 0.1) and c >= 0.8 and j >= 0.45 and shared and (mutual or c >= 0.9):
                    yield a, b, score

    for least in (0.5, 0.7):
        pairs = resolve.month_pairs(events, least)
        found = sorted((r["a"], r["b"], r["score"]) for r in resolve.candidates(pairs, least).collect())
        assert len(found) > 40 and found == sorted(wanted(least))
    # by the size of the scan, all grams would go through the driver
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_month_leave_their_task_only_as_candidates(spark, monkeypatch):
    # one day and month of many like events, cut into pieces
    rows = [(i, "1950-01-02" if i % 4 else "1950-01", "visit", f"abcdefgh{i % 10}{i % 7}" if i % 11 else None, [str(i % 3), str(i % 2)], ["o"], "here", [str(i % 5)], [str(i % 5)]) for i in range(90)]
    events = spark.createDataFrame(rows, "event_id long, start_value string, event_type string, description string, people array<string>, organizations array<string>, location string, documents array<string>, subjects array<string>")
    whole = resolve.month_pairs(events)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # events are shuffled, pairs are not
    wanted = sorted(map(str, resolve.candidates(whole).collect()))
    monkeypatch.setattr(resolve, "PIECE", 7)
    assert sorted(map(str, resolve.candidates(resolve.month_pairs(events)).collect())) == wanted and len(wanted) > 300
    # a text that is not known has no likeness, and as in SQL the score is the largest
    assert {(r["containment"], r["jaccard"], r["score"]) for r in whole.where("a % 11 = 0 OR b % 11 = 0").collect()} == {(0.0, None, 1.0), (None, None, 1.0)}


def test_common_codes_of_strips_are_those_of_sets(monkeypatch):
    random = np.random.default_rng(4)
    held = [set(random.integers(0, 40, int(n)).tolist()) | ({1} if n % 2 else set()) for n in random.integers(0, 9, 60)]
    row, code = np.array([(r, c) for r, s in enumerate(held) for c in s]).T
    some = meeting.Sets(row, code, 60, 40)
    for cheaper in (0, 5, 10**9):  # lists alone, both, products alone
        monkeypatch.setattr(meeting, "CHEAPER", cheaper)
        for low, middle, right, high in ((0, 60, 0, 60), (0, 25, 25, 60)):
            both = meeting.Meeting(some, low, middle, right, high)
            assert both.counts(low + 3, low + 20, right + 5).tolist() == [[len(held[r] & held[c]) for c in range(right + 5, high)] for r in range(low + 3, low + 20)]
    x, y = random.integers(0, 60, 500), random.integers(0, 60, 500)
    for table in (0, meeting.TABLE):
        monkeypatch.setattr(meeting, "TABLE", table)
        assert meeting.Sets(row, code, 60, 40).common(x, some, y).tolist() == [len(held[r] & held[c]) for r, c in zip(x, y, strict=True)]
        assert some.common(x, meeting.Sets(row, code, 60, 40), y).tolist() == [len(held[r] & held[c]) for r, c in zip(x, y, strict=True)]
    grams = meeting.character_pairs(pa.array(["abab", "", None, "x", "yxab"]))
    assert grams.size.tolist() == [2, 0, 0, 1, 3] and grams.common(np.array([0, 3]), grams, np.array([4, 4])).tolist() == [1, 0]


def test_components_of_blocks_take_no_rounds(spark, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(f"m{i % 3}", int(x) * 3 + i % 3, int(y) * 3 + i % 3) for i, (x, y) in enumerate(random.integers(0, 60, (90, 2))) if x < y] + [("long", i, i + 3) for i in range(1000, 1300, 3)] + [("turn", 2000 - i, 1999 - i) for i in range(50)]
    pairs = spark.createDataFrame(rows, "month string, a long, b long").repartition(3)
    asked = []
    monkeypatch.setattr(resolve, "cut", lambda df: asked.append(df) or df)
    found = resolve.components_within(pairs, "month")
    least = {n: n for _, a, b in rows for n in (a, b)}
    for _ in least:
        for _, a, b in rows:
            least[a] = least[b] = min(least[a], least[b])
    assert {(r["node"], r["component"]) for r in found.collect()} == set(least.items()) and found.count() == len(least)
    assert not asked and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    # in more than one go
    monkeypatch.setattr(resolve, "LINKS", 7)
    linked = resolve._Linked()
    for i in range(0, len(rows), 5):
        linked.add(*np.array([r[1:] for r in rows[i : i + 5]]).T)
    node, first = linked.settle()
    assert dict(zip(node.tolist(), first.tolist(), strict=True)) == least


def test_canonical_candidates_are_made_in_few_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("canonical", "")
    try:
        answers.m14_canonical_candidates(spark, "/root/testdata/sf0.001")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(tracker.getJobIdsForGroup("canonical")) <= 12


def test_canonical_candidates_send_no_events_to_the_driver(spark):
    plan = answers.m14_canonical_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("Scan parquet") == 2  # events and facts: candidates are not worked out again


def test_pages_are_cut_into_pieces_once_and_dates_read_once(spark):
    rows = [(1, 1, "1月2日 甲\n同日 乙\n[1] 注", "ocr", 1950), (1, 2, "丙\n1月2日 丁", "ocr", 1950), (1, 4, "次日 戊", "ocr", 1950), (1, 5, None, "ocr", None)]
    pages = spark.createDataFrame(rows, "document_id long, pdf_page long, text string, method string, year int")
    found = segments.split_date_entries(pages, pages)
    got = [(r["entry"], r["date"]["start"]["value"], r["text"], r["pages"], r["flags"]) for r in found.orderBy("entry").collect()]
    assert got == [
        (1, "1950-01-02", "1月2日\n甲", [1], ["footnotes_excluded"]),
        (2, "1950-01-02", "同日\n乙\n丙", [1, 2], ["footnotes_excluded"]),
        (3, "1950-01-02", "1月2日\n丁", [2], ["page_gap"]),
        (4, "1950", "次日\n戊", [4], []),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert segments.FOOTNOTE[:12] not in plan and plan.count("_parsed(") <= 2, plan
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert dates._known("1月2日", 1950) is dates._known("1月2日", 1950)


def test_people_of_an_action_meet_in_its_row(spark):
    kinds = "event_id long, action string, basis string, method string, clause string, anchor string, people array<struct<name: string, role: string>>"
    rows = [
        (1, "x", "e", "m", "c", None, [("a", "r"), ("b", "s"), ("c", None), ("a", "r"), ("b2", "s")]),
        (1, "x", "e", "m", "c", None, [("a", "r"), ("b", "s")]),  # once more
        (2, "x", "e", None, "c", "b", [("a", "r"), ("b", "s"), ("c", "r"), ("unknown", "r")]),
        (3, "x", "e", "m", "c", None, [("a", "r")]),
        (4, "x", "e", "m", "c", None, []),
    ]
    people = spark.createDataFrame([("a", 3), ("b", 2), ("b2", 2), ("c", 1), ("c", 7)], "name string, person_id long")
    found = joint.joint_pairs(spark.createDataFrame(rows, kinds), people)
    got = sorted((tuple(r[c] for c in ("event_id", "first", "first_role", "second", "second_role")) for r in found.collect()), key=lambda r: (r[:2], r[3]))
    wanted = [(1, 1, None, 2, "s"), (1, 1, None, 3, "r"), (1, 1, None, 7, None), (1, 2, "s", 3, "r"), (1, 2, "s", 7, None), (1, 3, "r", 7, None), (2, 1, "r", 2, "s"), (2, 2, "s", 3, "r"), (2, 2, "s", 7, "r")]
    assert got == sorted(wanted, key=lambda r: (r[:2], r[3])) and found.columns == ["event_id", "action", "basis", "method", "clause", "first", "first_role", "second", "second_role"]
    # people are named by one join, and texts are in no other
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_quotes_are_found_wherever_words_begin(spark, tmp_path, monkeypatch):
    texts = ["The quick-brown fox, it jumps", "the quickbrown FOX it jumps over", "one two three", "ab", "a b", None, "", "...", "国务院副总理，在会上", "one two three four five six seven eight nine ten eleven twelve thirteen", "aaaaaaaaab", "b"]
    asked = ["quick brown fox it jumps", "two three", "a", "ab", "a-b", None, "", "...", "务院副", "副总理在会", "three four five six seven eight nine ten eleven twelve", "aaab", "two three", "not there at all", "onetwothree"]
    folder = written(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    written(spark, tmp_path, "benchmark", list(enumerate(asked)), "item_id long, text string")
    written(spark, tmp_path, "embeddings", [(0, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum())
    wanted = {(q, d) for q, a in enumerate(asked) for d, t in enumerate(texts) if a is not None and t is not None and plain(a) in plain(t)}
    for block, part in ((holding.BLOCK, holding.SLICE), (40, 12)):
        monkeypatch.setattr(holding, "BLOCK", block)
        monkeypatch.setattr(holding, "SLICE", part)
        assert sorted(map(tuple, research.g11_quote_matches(spark, folder).collect())) == sorted(wanted)
    got = sorted((tuple(r) for r in research.g1_recall_mrr(spark, folder).collect()), key=str)
    assert got == sorted(by_sql(folder, research.ORACLE_SQL["g1_recall_mrr"], "documents", "benchmark", "embeddings"), key=str)


def test_quotes_of_every_length_are_met():
    random = np.random.default_rng(8)
    pages = ["".join(random.choice(list("abcde"), int(n))) for n in random.integers(0, 400, 40)]
    quotes = list(dict.fromkeys([p[i : i + n] for p in pages for i, n in zip(random.integers(0, 300, 12).tolist(), random.integers(0, 70, 12).tolist(), strict=True)] + ["".join(random.choice(list("abcdef"), n)) for n in range(70)]))
    page, quote = holding.Quotes(quotes).held(pages)
    found = list(zip(page.tolist(), quote.tolist(), strict=True))
    assert len(set(found)) == len(found) and set(found) == {(p, q) for p, text in enumerate(pages) for q, part in enumerate(quotes) if part in text}
