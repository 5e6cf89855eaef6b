"""Whole results of queries without SQL, recomputed from the tables in plain Python."""

import itertools
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from evidencelake.llm import _text, language_id, quality
from evidencelake.llm.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def good():
    """doc_id, text and whether the labels call the document good."""
    chosen = {r["doc_id"] for r in table("labels") if r["quality"] == 1}
    return [(d["doc_id"], d["text"] or "", d["doc_id"] in chosen) for d in table("documents")]


def test_op2_losses(spark):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    rows = [(i, split(t), target) for i, t, target in good()]
    words, contexts, pairs = ([Counter(), Counter()] for _ in range(3))
    for _, w, target in rows:
        for i in range(1 + target):
            words[i].update(w)
            contexts[i].update(w[:-1])
            pairs[i].update(itertools.pairwise(w))
    totals = [w.total() + len(words[0]) + 1 for w in words]

    def loss(w, i, k=4.0):
        p = lambda x: (words[i][x] + 1) / totals[i]
        return -(np.log(p(w[0])) + sum(np.log((pairs[i][v, x] + k * p(x)) / (contexts[i][v] + k)) for v, x in itertools.pairwise(w))) / len(w)

    got = {r["doc_id"]: r for r in QUERIES["op2_lm_scoring"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, w, _ in rows:
        assert got[i]["n_tokens"] == len(w)
        if w:
            background, target = loss(w, 0), loss(w, 1)
            assert abs(got[i]["background_loss"] - background) < 1e-6 and abs(got[i]["target_loss"] - target) < 1e-6
            assert abs(got[i]["difference"] - (target - background)) < 2e-6
        else:
            assert got[i]["difference"] is None


def test_op7_weights_and_draw(spark):
    rows, size = good(), quality.Resampling().buckets
    grams = lambda w: [(x,) for x in w] + list(itertools.pairwise(w))
    found = [grams(re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))) for _, t, _ in rows]
    number = {}
    # the bucket of an n-gram is the operator's hash of it; everything else is counted anew
    for low, high, hashes, first in _text.tokens(pa.array([t for _, t, _ in rows]), _text.NON_SPACE):
        row = np.searchsorted(first[1:], np.arange(len(hashes)), side="right")
        buckets, own = quality._grams(hashes, row, size)
        for i in range(low, high):
            number.update(zip(found[i], buckets[own == i - low].tolist(), strict=True))
    counts = np.ones((2, size))
    for own, (_, _, target) in zip(found, rows, strict=True):
        for g in own:
            counts[0, number[g]] += 1
            counts[1, number[g]] += target
    log = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_resampling"](spark, DATA).collect()}
    for own, (i, _, _) in zip(found, rows, strict=True):
        assert got[i]["n_grams"] == len(own) and abs(got[i]["weight"] - sum(log[number[g]] for g in own)) < 1e-6
    ordered = sorted(got.values(), key=lambda r: (-r["key"], r["doc_id"]))
    assert [r["selected"] for r in ordered] == [n < -(-len(ordered) // 2) for n in range(len(ordered))]
    noise = np.array([r["key"] - r["weight"] for r in ordered])
    assert 0.2 < noise.mean() < 1.0 and noise.min() > -3  # Gumbel: a mean of 0.58, and no long tail below


def test_op9_languages(spark, monkeypatch):
    kept = {}
    fit = language_id.fit

    def capturing(samples, *more, **options):
        kept.update(samples)
        return fit(samples, *more, **options)

    monkeypatch.setattr(language_id, "fit", capturing)
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, DATA).collect()}
    model, docs = fit(kept), table("documents")
    assert set(kept) == {d["lang"] for d in docs if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2}
    automata = {lang: language_id.SuffixAutomaton(kept[lang]) for lang in model.languages}
    assert len(got) == len(docs)
    for d in docs:
        r, form = got[d["doc_id"]], language_id.normalise(d["text"] or "")
        letters = sum(c != " " for c in form)
        if not letters:
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        bits = [automata[lang].phrases(form) * b / letters for lang, b in zip(model.languages, model.bits, strict=True)]
        first, second = sorted(bits)[:2]
        assert abs(r["bits"] - first) < 1e-6 and abs(r["score"] - second / (first + second)) < 1e-6
        assert bits[model.languages.index(r["lang_pred"])] <= first + 1e-9
