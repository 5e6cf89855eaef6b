"""The prefix trie, whitening and the secret ledger on awkward rows, against brute force."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import prefix_trie, secrets, whitening
from evidencelake.llm.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


# the trie


def trie_by_hand(rows):
    """Rows (conv_id, turn, role, text) to the set of result rows, from the definitions alone."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    figures = {}
    for p in sorted(members, key=len, reverse=True):
        kids = [q for q in figures if q[:-1] == p and len(q) == len(p) + 1]
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        figures[p] = (len(kids), sum(figures[k][1] for k in kids) or 1, saved + sum(figures[k][2] for k in kids))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), *figures[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, rows, **options):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("clash"), "keys": F.lit(0), "node": F.lit(1)})
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in prefix_trie.prefix_nodes(frame, **options).select(*columns).collect()]


def same(got, wanted):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(wanted, key=key)


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def talks(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(-5, n):
        if c % 17 == 3:
            continue
        length = r.choice([1, 2, 3, 5, 9, 14])
        hot = c % 3 == 0  # a third of all conversations is the same
        rows += [(c, t, "user" if t % 2 else None, f"hé{t}" if hot else f"w{r.randrange(2)}" if t < 4 else r.choice([None, "", "z" * t])) for t in range(3 if hot else length)]
    return rows


def test_trie_matches_brute_force_over_many_ranges(spark, many_ranges, monkeypatch):
    rows = talks(1, 160)
    monkeypatch.setattr(prefix_trie, "PENDING", 5)
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    same(nodes(spark, rows), trie_by_hand(rows))
    same(nodes(spark, rows, sent_bytes=0), trie_by_hand(rows))


def test_small_sweep_limits_reach_the_tasks():
    """The same sweep without Spark, with bounds that force every way of giving nodes back."""
    rows = sorted({(tuple(random.Random(i).choices("ab", k=random.Random(i).randrange(6))), i) for i in range(60)})
    for cuts in ([], [20], [7, 8, 30, 59], list(range(1, 60))):
        edges = [0, *cuts, len(rows)]
        parts = [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        out = []
        old = prefix_trie.PENDING, prefix_trie.CHUNK
        prefix_trie.PENDING, prefix_trie.CHUNK = 2, 2
        for i, part in enumerate(parts):
            left = prefix_trie._common(parts[i - 1][-1][0], part[0][0]) if i else -1
            right = prefix_trie._common(part[-1][0], parts[i + 1][0][0]) if i + 1 < len(parts) else -1
            sweep = prefix_trie._Sweep(i, left, right)
            for keys, conv in part:
                sweep.add([k.encode() for k in keys], [3] * len(keys), conv)
            sweep.finish()
            out += sweep.out
        prefix_trie.PENDING, prefix_trie.CHUNK = old
        wanted = {}
        for keys, conv in rows:
            for d in range(len(keys) + 1):
                wanted.setdefault(keys[:d], []).append(conv)
        shared = {}
        for r in out:
            if r[0] == "part":
                p = shared.setdefault(r[1], [r[4], [], 0])
                p[1].append(r[3])
                p[2] += r[6]
        got = [(r[4], r[3], r[6]) for r in out if r[0] == "node"] + [(d, min(m), n) for d, m, n in shared.values()]
        assert sorted(got) == sorted((len(p), min(m), len(m)) for p, m in wanted.items())


def test_trie_defined_cases(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "a", "b")]) == []
    # 3 takes its turns from 0, which is absent, and has fewer of its own than h: it ends in the root
    rows = [(3, 0, "u", "x")]
    same(nodes(spark, rows), trie_by_hand(rows))
    # ties of one number go by role and text, nulls come first, repeated rows are turns of their own
    rows = [(5, 1, "b", "later"), (5, 1, "a", "x"), (5, None, "z", "z"), (5, 1, "a", "x"), (5, 1, "a", None), (6, None, None, None), (7, 2, "u", "y" * 100_000)]
    same(nodes(spark, rows), trie_by_hand(rows))


def test_op11_matches_brute_force(spark):
    wanted = trie_by_hand([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")])
    same([tuple(r) for r in QUERIES["op11_conversation_prefix_trie"](spark, DATA).collect()], wanted)


# whitening


def test_primes_and_remainders():
    for bound in (1, 10**6, 10**20, 10**60):
        moduli = whitening.primes(bound)
        assert math.prod(moduli) > 2 * bound and len(set(moduli)) == len(moduli)
        assert whitening.BLOCK * (whitening.PRIME_LIMIT // 2) ** 2 < 1 << 53
        for x in (0, 1, -1, bound, -bound, bound // 7):
            assert whitening.remaindered([x % p for p in moduli], moduli) == x


def whitened(spark, vectors, components=32, more=()):
    rows = [(i, v, 7, "y") for i, v in enumerate(vectors)] + [(None if m else 1, v, 8, "z") for m, v in more]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened string")
    found, model = whitening.whiten(frame, components=components)
    error = whitening.identity_error(whitening.usable(frame, "embedding"), "embedding", model) if model else None
    return whitening.by_component(found, model, error).collect(), model


def exact_deviations(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    return x, sums, [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def compare(rows, vectors, components):
    x, sums, deviations = exact_deviations(vectors)
    n = len(x)
    centred = np.array([[n * c - s for c, s in zip(row, sums, strict=True)] for row in x], dtype=object)
    v = np.array([[float((centred[:, i] * centred[:, j]).sum()) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    w = (centred / n).astype(float) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    by = {}
    for r in rows:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == list(range(1, components + 1))
    for k, own in by.items():
        got = np.array([own[i]["whitened"] for i in range(n)])
        sign = np.sign(got @ w[:, k - 1])
        assert np.abs(got * sign - w[:, k - 1]).max() < 1e-6
        for i, r in own.items():
            assert r["n"] == n and r["deviation_exact"] == str(deviations[i])
            assert r["deviation"] == (deviations[i] if deviations[i] < 1 << 63 else None)
            assert abs(r["explained"] * values.sum() / values[k - 1] - 1) < 1e-9
            assert r["identity_error"] <= 1e-4


def test_whitening_matches_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(300, 6)) * [9, 5, 3, 1, 0.5, 0.2]).tolist()
    rows, _ = whitened(spark, vectors)
    compare(rows, vectors, 6)
    rows, _ = whitened(spark, vectors, components=2)
    compare(rows, vectors, 2)


def test_whitening_of_large_entries_is_exact(spark):
    r = np.random.default_rng(6)
    vectors = (r.normal(size=(40, 3)) * [1e12, 1e11, 1e12]).tolist()
    rows, model = whitened(spark, vectors)
    compare(rows, vectors, 3)
    assert any(row["deviation"] is None for row in rows)


def test_whitening_defined_cases(spark):
    assert whitened(spark, [])[0] == []
    assert whitened(spark, [[1.0, 2.0]])[0] == []
    assert whitened(spark, [[1.0, 2.0]] * 5)[0] == []
    good = [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0], [1.0, 0.0], [3.0, 0.0]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0], [1e300, float("-inf")]]
    rows, model = whitened(spark, [*good, *bad])
    assert {r["vec_id"] for r in rows} == set(range(5)) and {r["component"] for r in rows} == {1}  # the second entry never varies
    assert model.n == 5 and rows[0]["explained"] == pytest.approx(1.0)
    rows, model = whitened(spark, good, more=[(True, [9.0, 1.0]), (False, [2.0, 2.0])])
    assert model.n == 7 and len(rows) == 14 and sum(r["vec_id"] is None for r in rows) == 2
    rows, _ = whitened(spark, [[1e308, 0.0], [-1e308, 1.0], [0.0, 2.0]])  # held within 2 ** 62
    assert {r["vec_id"] for r in rows} == {0, 1, 2}


def test_op12_matches_brute_force(spark):
    vectors = [r["embedding"] for r in sorted(table("embeddings"), key=lambda r: r["vec_id"])]
    ids = sorted(r["vec_id"] for r in table("embeddings"))
    assert ids == list(range(len(ids)))
    compare(QUERIES["op12_embedding_whitening"](spark, DATA).collect(), vectors, 32)


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def by_hand(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def words(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def reported(rows):
    for r, text in rows:
        base = by_hand(text)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(f[1] == i for f in base) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(words(base).encode()).hexdigest()
        kept = [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert ",".join(kept) == words(base)


HEX = "0123456789abcdef" * 2
TEXTS = [None, "", "plain words", f"é PASSWORD = 'abcdef' {HEX}", "secret=token:abcdef api_key: abc apikey:\"abcdef.", "AKIA" + "X" * 16 + " AKIAAKIA" + "Y" * 11, "toKen==abcde " + "x" * 200_000 + " passwd: zzzzzz", f"hash {HEX} and {HEX}", "paſſword = abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", f"glpat-{'a1-' * 9}"]


def ledger_of(spark, tmp_path):
    return secrets.Ledger(spark, f"file://{tmp_path}/ledger")


def versions(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", 1) for i, t in enumerate(texts)], "path long, text string, blob string, spans long")


def check(ledger, known, texts, first=0, copies=1):
    rows = secrets.secret_report(ledger, known).collect()
    assert len(rows) == copies * len(texts)
    reported([(r, texts[r["path"] - first]) for r in rows])


def test_ledger_scans_each_pair_once(spark, tmp_path, monkeypatch):
    ledger = ledger_of(spark, tmp_path)
    known = ledger.update(versions(spark, TEXTS).unionByName(versions(spark, TEXTS)))
    check(ledger, known, TEXTS, copies=2)
    distinct = {t or "" for t in TEXTS}
    assert ledger.rows().count() == len(distinct) and ledger.rows().select("blob").distinct().count() == len(distinct)
    # the same texts under other paths: nothing is scanned
    known = ledger.update(versions(spark, TEXTS, 100))
    assert ledger.rows().count() == len(distinct)
    check(ledger, known, TEXTS, 100)
    # new texts among old ones: only the new ones are, by a join by shuffle as well
    monkeypatch.setattr(secrets, "SENT_BYTES", 0)
    known = ledger.update(versions(spark, [*TEXTS, "one token = newer1", "one token = newer1"], 200))
    assert ledger.rows().count() == len(distinct) + 1
    check(ledger, known, [*TEXTS, "one token = newer1", "one token = newer1"], 200)
    # a new version of one rule: that rule alone runs again, and its old spans go
    longer = tuple(secrets.Rule("hex", 2, r"[0-9a-f]+", 33) if r.kind == "hex" else r for r in secrets.RULES)
    before = ledger.rows().count()
    known = ledger.update(versions(spark, TEXTS, 300), rules=longer)
    added = ledger.rows().where(F.array_contains("rules", "hex@2")).collect()
    assert len(added) == len(distinct) and {tuple(r["rules"]) for r in added} == {("hex@2",)} and ledger.rows().count() == before + len(distinct)
    assert {r["n_hex"] for r in secrets.secret_report(ledger, known, longer).collect()} == {0}
    # rows of a scan that ran twice are taken once
    ledger.rows().repartition(1).write.parquet(f"file://{tmp_path}/again")
    spark.read.parquet(f"file://{tmp_path}/again").write.mode("append").parquet(ledger.folder)
    check(ledger, known, TEXTS, 300)


def test_ledger_defined_cases(spark, tmp_path):
    ledger = ledger_of(spark, tmp_path)
    known = ledger.update(versions(spark, []))
    assert secrets.secret_report(ledger, known).count() == 0
    rows = spark.createDataFrame([(None, f"token: {HEX}"), (None, f"token: {HEX}"), (1, f"token: {HEX}")], "path long, text string")
    known = ledger.update(rows)
    assert [r["spans"] for r in secrets.secret_report(ledger, known).collect()] == ["assign:0:39,hex:7:39"] * 3
    assert ledger.rows().count() == 1
    kinds = {s.split(":")[0] for r in secrets.secret_report(ledger, ledger.update(versions(spark, TEXTS))).collect() for s in r["spans"].split(",") if s}
    assert kinds == {"assign", "access", "hex", "armour", "prefixed"}


def test_op13_matches_brute_force(spark):
    texts = {d["doc_id"]: d["text"] for d in table("documents")}
    rows = QUERIES["op13_secret_scans"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    reported([(r, texts[r["doc_id"]]) for r in rows])
