"""The text-preparation operators on awkward rows, against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import _text, decontamination, fingerprints, fixity, language_id, lm_scoring, pieces, quality, toxicity, url_filters
from evidencelake.llm.components import connected_components
from evidencelake.llm.near_dedup import Similarity, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, spans string, score string"


def documents(spark, texts):
    """Rows with ids from 0, a null id, an exact repeat, and columns whose names clash with results."""
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "of no id at all in these few words", "x", "y")], DOCS)


def prose(seed, words=200, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{min(r.randrange(vocabulary), r.randrange(vocabulary))}" for _ in range(words))


AWKWARD = [None, "", " \n\t ", "one", "Two words", "Ünïcode WORDS hier", "x " * 3000, "a\x00b", "▁ mark"]


def test_word_hashes_agree_with_regular_expressions():
    texts = [t or "" for t in AWKWARD] + [prose(1)]
    for low, _, words, first in _text.tokens(pa.array(texts), _text.ALNUM):
        for i in range(len(first) - 1):
            wanted = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[low + i].translate(LOWER))
            own = words[first[i] : first[i + 1]]
            assert len(own) == len(wanted)
            assert len(set(own.tolist())) == len(set(wanted))


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, percent):
    s = [sets(t, k) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))], [len(x) for x in s]


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(3)
    texts = list(AWKWARD)
    base = prose(9, 120).split()
    for n in range(40):  # a crowd of copies with more and more edits
        w = list(base)
        for _ in range(n % 9):
            w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [prose(i) for i in range(20)] + [prose(1), "all rights reserved by them " + "q7", "all rights reserved by them q8"]
    wanted, sizes = brute_components(texts, 3, 85)
    got = near_duplicates(documents(spark, texts), Similarity(words=3, percent=85, together=4, common=8)).collect()
    assert len(got) == len(texts) + 2
    rows = {r["doc_id"]: r for r in got}
    assert [rows[i]["component_id"] for i in range(len(texts))] == wanted
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert rows[None]["component_id"] is None and rows[None]["kept"]


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (60, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40}


def test_toxic_words_are_found_and_clean_texts_left(spark):
    bad = ["grumbly", "grumblier", "snarkish"]
    texts = [prose(i, 60) for i in range(160)]
    r = random.Random(5)
    label = [i % 4 == 0 for i in range(160)]
    for i, toxic in enumerate(label):
        if toxic:
            w = texts[i].split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
            texts[i] = " ".join(w)
    docs = documents(spark, texts + AWKWARD)
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(label) if i < 120] + [(None, 1), (5, None)], "doc_id long, toxic int")
    field = toxicity.learn(docs, labels)
    rows = toxicity.score_toxicity(docs, field, carry=("doc_id",)).collect()
    assert len(rows) == len(texts) + len(AWKWARD) + 2
    got = {r["doc_id"]: r for r in rows}
    assert all((got[i]["score"] >= 0.7) == label[i] for i in range(160))
    assert all(0 <= r["score"] < 0.7 and not r["spans"] for r in (got[160 + i] for i in range(len(AWKWARD))))
    for i in (120, 124):
        assert {texts[i][s["start"] : s["end"]] for s in got[i]["spans"]} <= set(bad) and got[i]["spans"]


def test_marginals_match_enumeration():
    field = toxicity.Field(np.array([1, 2], dtype=np.uint64), np.array([3.0, 1.5, -2.0]), np.array([[0.5, -0.4], [-0.3, -1.0]]), np.zeros(3))
    length, places, features = 7, np.array([1, 4, 5]), np.array([[0, 2, 2, 2, 2], [1, 2, 2, 2, 2], [0, 1, 2, 2, 2]])
    potential = np.full(length, -2.0)
    potential[places] = field.potentials(features)
    total, ones = 0.0, np.zeros(length)
    for tags in itertools.product((0, 1), repeat=length):
        s = sum(potential[i] * t for i, t in enumerate(tags)) + sum(field.transitions[a, b] for a, b in itertools.pairwise(tags))
        total += np.exp(s)
        ones += np.exp(s) * np.array(tags)
    assert np.allclose(field.marginals(places, field.potentials(features), length), (ones / total)[places])


def test_toxicity_without_labels(spark):
    docs = documents(spark, AWKWARD)
    field = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["score"] < 0.01 for r in toxicity.score_toxicity(docs, field).collect())


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Example.com/en/1?q", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://www.example.com/fr/#x", "www.example.com", "/fr/", "com/", "allow"),
    ("ftp://x.net/es/a://b", "x.net", "/es/a://b", "net/es/", "block"),
    ("http://com", "com", "", None, "allow"),
    ("http://notexample.org/en/", "notexample.org", "/en/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
])
def test_listed_rules(spark, url, host, path, rule, verdict):
    from evidencelake.llm.queries import URL_RULES

    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, verdict string")
    r = url_filters.judge_urls(pages, URL_RULES).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_mined_rules(spark):
    rules = [("block", "net/ads/"), ("allow", "com/")]
    urls = [f"http://h{i}.net/ads/{i}" for i in range(40)] + [f"http://h{i}.com/news/{i}" for i in range(40)] + ["http://h.org/ads/1", "http://h.org/news/2", "http://h.org/other"]
    got = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("rule IS NULL").orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block", "allow", "allow"]
    assert [r["confidence"] for r in got] == [1.0, 1.0, None]


def test_every_labelled_url_is_mined(spark):
    urls = spark.range(42_400).select(F.col("id").alias("page_id"), F.expr("CASE WHEN id < 8400 THEN 'http://a.net/t' WHEN id < 10400 THEN 'http://a.com/t' ELSE 'http://a.net/u' END").alias("url"))
    pages = urls.union(spark.createDataFrame([(-1, "http://x.org/t")], "page_id long, url string"))
    got = url_filters.judge_urls(pages, [("block", "net/"), ("allow", "com/")]).where("rule IS NULL").first()
    assert got["verdict"] == "block" and abs(got["confidence"] - 8400 / 10400) < 1e-12


def test_fingerprints(spark):
    texts = [t or "" for t in AWKWARD] + [prose(i) for i in range(12)] + [prose(3)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents(spark, texts)).collect()}
    order = [i for i in range(len(texts) - 1, -1, -1)]
    words = lambda t: Counter(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w)
    for at, i in enumerate(order):
        t = texts[i]
        following = texts[order[at + 1]] if at + 1 < len(order) else "of no id at all in these few words"
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = words(t), words(edited)
        if a and b:
            assert abs(got[i]["near_edited"] - sum((a & b).values()) / sum((a | b).values())) < 0.3
    assert got[len(texts) - 1]["fingerprint"] == got[texts.index(prose(3))]["fingerprint"]
    assert len(got) == len(texts) + 1


def test_fingerprints_of_few_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(none).collect() == []
    rows = fingerprints.fingerprint_edits(spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_edited"], r["near_next"]) for r in rows] == [(1, 0, 1.0, 1.0)] * 2
    same = fingerprints.fingerprint_edits(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()
    assert [r["edited_sha256"] for r in same] == [hashlib.sha256(b"abab").hexdigest()]


def test_long_texts_without_a_word_in_common_are_not_alike(spark):
    words = [[f"{i}x{j}" for j in range(8000)] for i in range(2)]
    texts = spark.createDataFrame(list(enumerate(map(" ".join, (*words, words[0][:4000] + words[1][4000:], words[0] * 2)))), "k long, text string")
    got = {r["k"]: r["signature"] for r in fingerprints.signatures(texts, ["k"], ["text"]).collect()}
    equal = lambda a, b: sum(x == y for x, y in zip(got[a], got[b], strict=True)) / fingerprints.SLOTS
    assert equal(0, 1) == 0
    # 4,000 of 12,000 words are common; the same words twice
    assert abs(equal(0, 2) - 1 / 3) < 0.2 and abs(equal(0, 3) - 0.5) < 0.2


def test_fingerprints_use_no_python(spark):
    plan = fingerprints.fingerprint_edits(documents(spark, [prose(1), prose(2)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PIECES = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "é"]


def vocabulary():
    names = [*PIECES, *(f"<0x{i:02X}>" for i in range(256))]
    kinds = [2, *([0] * (len(PIECES) - 1)), *([1] * 256)]
    scores = [0.0, -3.0, -2.0, -2.5, -2.2, -3.1, -4.0, -4.6, -2.9, -4.4, -5.0, *([0.0] * 256)]
    return pieces.Vocabulary(tuple(names), tuple(scores), tuple(kinds))


def brute_best(coder, text):
    v = coder.vocabulary
    table = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True) if k == 0}
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        found = [best[b] + table[text[b:end]] for b in range(end) if text[b:end] in table]
        if text[end - 1] not in table:
            found.append(best[end - 1] + coder.unknown)
        best[end] = max(found)
    return best[-1]


def test_pieces_match_brute_force():
    coder = pieces.Coder(vocabulary())
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("aabbcé x\n▁") for _ in range(r.randrange(14)))
        ids = coder.encode(text)
        assert coder.decode(ids) == text
        if "▁" in text or "\n" in text or not text:
            continue
        score, run = 0.0, 0
        for i in ids:
            if coder.vocabulary.kinds[i] == 1:
                run -= 1
                if run < 0:
                    score, run = score + coder.unknown, 0
            else:
                score += coder.vocabulary.scores[i]
        assert abs(score - brute_best(coder, (" " + text).replace(" ", "▁"))) < 1e-9


def test_pieces_round_trip(spark):
    rows = pieces.decode(pieces.encode(documents(spark, AWKWARD).withColumn("tokens", F.lit(1)), vocabulary()), vocabulary()).collect()
    assert len(rows) == len(AWKWARD) + 2
    assert all(r["decoded"] == r["text"] and (r["tokens"] is None) == (r["text"] is None) for r in rows)


def test_quality_draws_exactly_k(spark):
    texts = [("good stuff here " * 20 if i % 2 else "bad junk there " * 20) + str(i) for i in range(200)]
    docs = documents(spark, texts)
    target = docs.withColumn("target", F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False)))
    rows = quality.resample(docs, target, quality.Resampling(share=0.25, ranked=3)).collect()
    chosen = [r for r in rows if r["selected"]]
    assert len(rows) == 202 and len(chosen) == 51
    assert min(r["key"] for r in chosen) >= max(r["key"] for r in rows if not r["selected"])
    assert sum(r["doc_id"] is not None and r["doc_id"] % 2 == 1 for r in chosen) > 45


@pytest.mark.parametrize("per", [None, 20.0])
def test_importance_weights_match_brute_force(spark, per):
    texts = [prose(i, 5 + 7 * (i % 5), 60) for i in range(30)] + AWKWARD
    docs = documents(spark, texts)
    rows = docs.withColumn("target", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return [(w,) for w in words] + list(itertools.pairwise(words))

    size = 997
    number = {}
    # the bucket of an n-gram is taken from the operator's hash, everything else is counted anew
    for low, high, hashes, first in _text.tokens(pa.array([t or "" for t in texts] + ["of no id at all in these few words"]), _text.NON_SPACE):
        row = np.searchsorted(first[1:], np.arange(len(hashes)), side="right")
        found, own = quality._grams(hashes, row, size)
        for i in range(low, high):
            text = texts[i] if i < len(texts) else "of no id at all in these few words"
            number.update(zip(grams(text), found[own == i - low].tolist(), strict=True))
    counts = np.ones((2, size))
    for r in rows.collect():
        for g in grams(r["text"]):
            counts[0, number[g]] += 1
            counts[1, number[g]] += r["target"]
    log = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    r = quality.Resampling(buckets=size, per=per)
    got = {x["doc_id"]: x for x in quality.resample(docs, rows, r).collect()}
    for i, t in enumerate(texts):
        own = [log[number[g]] for g in grams(t)]
        wanted = sum(own) if per is None else per * sum(own) / max(1, len(own))
        assert got[i]["n_grams"] == len(own) and abs(got[i]["weight"] - wanted) < 1e-9


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.resample(none, none.withColumn("target", F.lit(True))).collect() == []


def test_language_models_prefer_their_own(spark):
    texts = [("the cat sat on the mat " if i % 2 else "zzz qqq vvv ppp kkk ") * 10 for i in range(40)] + AWKWARD
    target = documents(spark, texts).withColumn("target", (F.col("doc_id") < 40) & (F.col("doc_id") % 2 == 1))
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(target).collect()}
    assert max(got[i]["difference"] for i in range(1, 40, 2)) < min(got[i]["difference"] for i in range(0, 40, 2))
    assert got[40]["n_tokens"] == 0 and got[40]["difference"] is None and got[44]["n_tokens"] == 2


def test_language_models_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, target boolean")
    assert lm_scoring.score_documents(none).collect() == []
    got = lm_scoring.score_documents(spark.createDataFrame([(1, "a b", None), (2, None, True)], "doc_id long, text string, target boolean")).collect()
    uniform = {r["doc_id"]: r["target_loss"] for r in got}
    assert abs(uniform[1] - np.log(3)) < 1e-6 and uniform[2] is None


def test_language_models_know_every_word_and_bigram(spark):
    texts = [prose(i, 60, 90) for i in range(12)] + [None, "", "one", "ONE two"]
    docs = documents(spark, texts)
    rows = docs.withColumn("target", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))
    every = [(r["text"] or "", r["target"]) for r in rows.collect()]
    words, contexts, pairs = ([Counter(), Counter()] for _ in range(3))
    for text, target in every:
        w = text.lower().split()
        for i in range(1 + target):
            words[i].update(w)
            contexts[i].update(w[:-1])
            pairs[i].update(itertools.pairwise(w))

    def loss(text, i, k=4.0):
        w = text.lower().split()
        p = lambda x: (words[i][x] + 1) / (words[i].total() + len(words[0]) + 1)
        return -(np.log(p(w[0])) + sum(np.log((pairs[i][v, x] + k * p(x)) / (contexts[i][v] + k)) for v, x in itertools.pairwise(w))) / len(w)

    scored = [*texts, "never seen w1 w2 before"]
    other = spark.createDataFrame([(100, scored[-1], True, False)], "doc_id long, text string, target boolean, counted boolean")
    found = []
    for plan in (lm_scoring.Plan(), lm_scoring.Plan(step=300, slice=700)):
        got = {r["doc_id"]: r for r in lm_scoring.score_documents(rows.withColumn("counted", F.lit(True)).unionByName(other, True), plan).collect()}
        got[len(texts)] = got.pop(100)
        for i, t in enumerate(scored):
            if not t:
                assert got[i]["n_tokens"] == 0 and got[i]["target_loss"] is None
                continue
            assert got[i]["n_tokens"] == len(t.split())
            assert abs(got[i]["background_loss"] - loss(t, 0)) < 1e-6 and abs(got[i]["target_loss"] - loss(t, 1)) < 1e-6
        found.append(got)
    assert found[0] == found[1]


def test_corrupt_records_are_located(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(300)] + [(None, None, None), (7, "http://h/7", "<p>7</p>" * 2)], "page_id long, url string, html string")
    bad = pages.withColumn("html", F.when(F.col("page_id").isin(10, 77, 299), F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    trees = [fixity.Tree(fixity.lay_out(fixity.page_records(p), 3)) for p in (pages, bad)]
    bad = {("corrupt", i): 1 for i in ("10", "77", "299")}
    assert statuses(*trees, offsets=False) == bad
    # the records behind them have moved
    assert {x: n for x, n in statuses(*trees).items() if x[0] != "moved"} == bad
    assert fixity.audit(trees[0], trees[0]).collect() == []


def statuses(one, two, **options):
    return Counter((r["status"], r["record_id"]) for r in fixity.audit(one, two, **options).collect())


def test_lost_added_moved_and_swapped_records(spark):
    rows = [(0, 10 * i, 10, f"h{i}", f"r{i}") for i in range(300)] + [(1, 0, 5, "x", "only")]
    tree = lambda rows: fixity.Tree(spark.createDataFrame(rows, "file long, offset long, size long, hash string, record_id string"))
    whole = tree(rows)
    lost = tree([(f, o - 10 * (f == 0 and o > 1000), s, h, r) for f, o, s, h, r in rows if r != "r100"])
    behind = {("moved", f"r{i}"): 1 for i in range(101, 300)}
    assert statuses(whole, lost) == {("missing", "r100"): 1, **behind}
    assert statuses(lost, whole) == {("extra", "r100"): 1, **behind}
    assert statuses(whole, lost, offsets=False) == {("missing", "r100"): 1}
    shifted = tree([(f, o + 7, s, h, r) for f, o, s, h, r in rows])
    assert len(statuses(whole, shifted)) == 301 and not statuses(whole, shifted, offsets=False)
    swapped = tree([(f, {50: 200, 200: 50}.get(o // 10, o // 10) * 10 if f == 0 else o, s, h, r) for f, o, s, h, r in rows])
    assert statuses(whole, swapped) == {("moved", "r50"): 1, ("moved", "r200"): 1}
    bad = tree([(f, o, s, h + "!" * (r in ("r0", "r299")), r) for f, o, s, h, r in rows if f == 0])
    assert statuses(whole, bad) == {("corrupt", "r0"): 1, ("corrupt", "r299"): 1, ("missing", "only"): 1}
    nothing = tree([])
    assert statuses(whole, nothing) == {("missing", r[4]): 1 for r in rows} and not statuses(nothing, nothing)
    twice = tree([(0, 0, 3, "a", None), (0, 3, 3, "a", None)])
    assert statuses(twice, tree([(0, 0, 3, "a", None)])) == {("missing", ""): 1}


def test_only_differing_nodes_are_descended(spark):
    rows = [(0, 10 * i, 10, f"h{i}", f"r{i}") for i in range(2000)]
    one, two = (fixity.Tree(spark.createDataFrame([(f, o, s, h + x * (r == "r900"), r) for f, o, s, h, r in rows], "file long, offset long, size long, hash string, record_id string")) for x in ("", "!"))
    for a, b in zip(one.levels[1:], two.levels[1:], strict=True):
        assert a.select("file", "id", "hash").exceptAll(b.select("file", "id", "hash")).count() == 1


def test_written_replicas_are_audited(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(40)], "page_id long, url string, html string")
    texts = [r[0].encode() for r in pages.orderBy("page_id").select(fixity.record("page_id", "url", "html")).collect()]
    for name, change in (("one", lambda t: t), ("two", lambda t: t.replace(b"<p>12</p>", b"<p>1Z</p>"))):
        for part in range(2):
            (tmp_path / name / f"part{part}").mkdir(parents=True)
            (tmp_path / name / f"part{part}" / "a.warc").write_bytes(b"".join(map(change, texts[part::2])))
    trees = [fixity.Tree(fixity.read_warc(spark, f"{tmp_path}/{name}")) for name in ("one", "two")]
    assert [(r["file"], r["status"], r["record_id"]) for r in fixity.audit(*trees).collect()] == [("part0/a.warc", "corrupt", "<urn:record:12>")]


def test_warc_files_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>ü</p>"), (2, "http://b/", "")], "page_id long, url string, html string")
    texts = [r[0] for r in pages.orderBy("page_id").select(fixity.record("page_id", "url", "html")).collect()]
    (tmp_path / "a.warc").write_bytes("".join(texts).encode())
    rows = fixity.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [bytes(r["body"]).decode() for r in rows] == ["<p>ü</p>", ""]
    assert [r["hash"] for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert [(r["offset"], r["size"]) for r in rows] == [(0, len(texts[0].encode())), (len(texts[0].encode()), len(texts[1].encode()))]


def test_cross_parsing_matches_the_automaton():
    samples = {"aa": language_id.normalise("the cat sat on the mat and the rat"), "bb": language_id.normalise("der hund und die katze über dem haus")}
    model = language_id.fit(samples)
    automata = [language_id.SuffixAutomaton(samples[k]) for k in ("aa", "bb")]
    quote = "the cat sat on the mat and the rat "
    texts = ["The cat!", "ÜBER dem Haus 12", "zzz", "", "x" * 700, "die   katze, the mat", quote * 60, "zq" * 300 + quote * 40 + "über dem haus " * 200]
    data, offsets = _text.buffers(pa.array(texts))
    letters, bits = language_id.parse(model, data, offsets)
    for i, t in enumerate(texts):
        form = language_id.normalise(t)
        n = sum(c != " " for c in form)
        assert letters[i] == n
        for k, automaton in enumerate(automata):
            count = automaton.phrases(form)
            assert n == 0 or abs(bits[i, k] - count * model.bits[k] / n) < 1e-9


@pytest.mark.parametrize("dense", [0, 3, 250])
def test_letters_of_many_scripts_are_all_known(dense):
    r = random.Random(3)
    scripts = {"hangul": 0xAC00, "han": 0x4E00, "latin": 0x61}
    word = lambda lang: "".join(chr(scripts[lang] + r.randrange(26 if lang == "latin" else 400)) for _ in range(4))
    samples = {lang: " ".join(word(lang) for _ in range(300)) + (" qz" if lang == "han" else "") for lang in scripts}
    model = language_id.fit(samples, dense)
    texts = [samples["hangul"][100:900], samples["han"][50:700] + "aqz", "한국 中文 mixed " + samples["latin"][:90], "жжж 漢" + samples["han"][:9]]
    letters, bits = language_id.parse(model, *_text.buffers(pa.array(texts)))
    for k, lang in enumerate(model.languages):
        automaton = language_id.SuffixAutomaton(samples[lang])
        for i, t in enumerate(texts):
            form = language_id.normalise(t)
            count = automaton.phrases(form)
            assert abs(bits[i, k] - count * model.bits[k] / letters[i]) < 1e-9
    assert [model.languages[i] for i in bits[:2].argmin(axis=1)] == ["hangul", "han"] and bits[:2].min() < 1


def test_quotes_go_to_the_language_that_has_them(spark):
    r = random.Random(8)
    points = r.sample(range(0x4E00, 0x9FA0), 12000)
    samples = {lang: "".join(map(chr, points[i::2])) for i, lang in enumerate(("a", "b"))}
    model = language_id.fit(samples)
    texts = [samples[lang][at : at + 200] for lang in samples for at in (0, 2500, 5700)]
    _, bits = language_id.parse(model, *_text.buffers(pa.array(texts)))
    assert bits.argmin(axis=1).tolist() == [0, 0, 0, 1, 1, 1]


def test_whole_documents_are_learned_from(spark):
    filler = "lorem " * 2000
    rows = spark.createDataFrame([(i, filler + "zyxw " * 4000, "long") for i in range(40)] + [(100, "kurz und gut", "short")], "doc_id long, text string, lang string")
    model = language_id.learn(rows, language_id.Sampling(documents=20))
    assert model.languages == ["long", "short"]
    _, bits = language_id.parse(model, *_text.buffers(pa.array(["zyxw zyxw zyxw zyxw", "kurz und gut"])))
    assert bits.argmin(axis=1).tolist() == [0, 1] and bits[0, 0] < 2


def test_no_documents_have_no_language(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(none, language_id.learn(none)).collect() == []


def test_languages(spark):
    texts = ["the cat and the dog are here with the others " * 3] * 5 + ["der hund und die katze sind nicht hier " * 3] * 5 + AWKWARD + ["123 !"]
    rows = spark.createDataFrame([(i, t, "en" if i < 5 else "de" if i < 10 else None, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in language_id.identify(rows, language_id.learn(rows)).collect()}
    assert [got[i]["lang_pred"] for i in range(10)] == ["en"] * 5 + ["de"] * 5
    assert [got[i]["lang_pred"] for i in (10, 11, 12, len(texts) - 1)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.identify(rows, language_id.learn(rows.where("lang IS NULL"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def brute_contamination(texts, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = find(t)
        n = min(k, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("slice_words", [2_000_000, 30])
def test_contamination_matches_brute_force(spark, slice_words):
    items = [(1, prose(100, 30)), (2, prose(101, 12)), (10, "Two words"), (3, prose(100, 30).upper()), (4, None), (5, "..."), (6, prose(102, 40)), (None, prose(103, 15))]
    texts = AWKWARD + [prose(1, 50) + " " + prose(100, 30) + ", " + prose(2, 50), prose(101, 12), prose(102, 40)[20:], prose(102, 40)[:120].replace(" ", "; "), prose(103, 15), prose(4, 300), "two words two words"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contamination(documents(spark, texts), benchmark, decontamination.Matching(slice_words=slice_words)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, [x for x in items if x[0] is not None])
    assert len(rows) == len(texts) + 2
    assert all(r["n_near"] >= r["n_items"] for r in rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma " + "z " * 50 + "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["n_near"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (False, 1), 2: (False, 0)}


def test_no_benchmark(spark):
    docs = documents(spark, AWKWARD)
    rows = decontamination.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(rows) == len(AWKWARD) + 2 and not any(r["contaminated"] for r in rows)
