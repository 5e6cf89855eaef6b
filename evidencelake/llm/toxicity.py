"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are tagged 0 (plain) or 1 (toxic); the features of a token are its word
and the first bytes of it, so that inflected forms count together.  Document
labels become token labels through a lexicon: features that occur in
significantly more toxic documents of a bounded labelled sample, taken greedily
until each toxic document is explained several times, so that words which only
copies of one document share stay out.  A token of a toxic document with a
feature in the lexicon is a labelled toxic token, any other a plain one.  The
field has a weight for each feature of the lexicon, one for every token, and one
for each transition; it is fitted by gradient ascent on the likelihood, with
forward-backward over many windows at once.

A whole text is then scored by forward-backward.  All tokens without a lexicon
feature have the same potentials, so the stretch between two others is one power
of a 2 x 2 matrix, taken from its eigenvalues: the marginals are those of the
full chain at the cost of the lexicon tokens alone.  The score is a logistic
function, fitted on the same sample, of the largest marginal and the expected
number of toxic tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import _text
from evidencelake.llm._sample import bounded_sample

SPANS = "array<struct<start: int, end: int, probability: double>>"


#: Lengths in bytes of the prefixes that are features besides the word itself.
PREFIXES = (7, 6, 5, 4)
SLOTS = len(PREFIXES) + 1


@dataclass(frozen=True)
class Fitting:
    """Bounds and settings: toxic and plain documents; least toxic documents, odds and z of a feature; features that explain a document; windows and their length.

    Of the windows of the sampled documents every n-th is fitted, at most half of ``windows`` with lexicon tokens.
    """

    documents: int = 1000
    plain: int = 2400
    least_documents: int = 3
    least_odds: float = 8.0
    least_z: float = 4.0
    cover: int = 12
    features: int = 1024
    windows: int = 4000
    window: int = 64
    rounds: int = 80
    decay: float = 0.5


def token_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token indices, feature hashes) of the words, then of each prefix of longer words."""
    yield np.arange(len(starts)), _text.word_hashes(data, starts, ends)
    for n in PREFIXES:
        longer = np.flatnonzero(ends - starts > n)
        yield longer, _text.mix(_text.word_hashes(data, starts[longer], starts[longer] + n) + _text.U64(n))


@dataclass
class Field:
    """Fitted weights: sorted feature hashes, a weight for each, then one of all tokens; log transitions; logistic coefficients."""

    lexicon: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    logistic: np.ndarray

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens with lexicon features, and their features (tokens x SLOTS; the lexicon's size where there is none)."""
        size = len(self.lexicon)
        if not size:
            return np.zeros(0, np.int64), np.zeros((0, SLOTS), np.int64)
        low = _text.U64(0xFFFF)
        maybe = np.zeros(1 << 16, bool)
        maybe[self.lexicon & low] = True
        at, slots, which = [], [], []
        for slot, (tokens, hashes) in enumerate(token_features(data, starts, ends)):
            some = np.flatnonzero(maybe[hashes & low])
            place = np.minimum(np.searchsorted(self.lexicon, hashes[some]), size - 1)
            hit = self.lexicon[place] == hashes[some]
            at.append(tokens[some[hit]])
            which.append(place[hit])
            slots.append(np.full(int(hit.sum()), slot))
        tokens, inverse = np.unique(np.concatenate(at), return_inverse=True)
        features = np.full((len(tokens), SLOTS), size)
        features[inverse, np.concatenate(slots)] = np.concatenate(which)
        return tokens, features

    def potentials(self, features: np.ndarray) -> np.ndarray:
        """Log potential of tag 1 for tokens with these features."""
        return self.weights[-1] + np.append(self.weights[:-1], 0.0)[features].sum(axis=-1)

    def marginals(self, places: np.ndarray, potentials: np.ndarray, length: int) -> np.ndarray:
        """Probability of tag 1 at the lexicon tokens of a text of ``length`` tokens."""
        if not len(places):
            return np.zeros(0)
        move = np.exp(self.transitions)
        start = np.array([1.0, np.exp(self.weights[-1])])
        values, vectors = np.linalg.eig(move * start)
        order = np.argsort(-np.abs(values))
        ratio, vectors = float((values[order[1]] / values[order[0]]).real), vectors[:, order].real
        inverse = np.linalg.inv(vectors)

        def power(n: int) -> np.ndarray:
            return vectors @ (np.array([[1.0], [ratio**n]]) * inverse)

        emit = np.column_stack([np.ones(len(places)), np.exp(potentials)])
        ahead = np.zeros((len(places), 2))
        for i, p in enumerate(places):
            if i:
                v = ahead[i - 1] @ power(int(p - places[i - 1] - 1)) @ move
            else:
                v = start @ power(int(p) - 1) @ move if p else np.ones(2)
            v = np.maximum(v * emit[i], 1e-300)
            ahead[i] = v / v.sum()
        back = power(int(length - 1 - places[-1])) @ np.ones(2)
        out = np.zeros(len(places))
        for i in range(len(places) - 1, -1, -1):
            back = np.maximum(back, 1e-300) / back.sum()
            both = ahead[i] * back
            out[i] = both[1] / both.sum()
            if i:
                back = power(int(places[i] - places[i - 1] - 1)) @ (move @ (emit[i] * back))
        return out

    def score(self, probabilities: np.ndarray) -> float:
        return float(_sigmoid(_features(probabilities) @ self.logistic))


def _features(probabilities: np.ndarray) -> np.ndarray:
    if not len(probabilities):
        return np.array([1.0, 0.0, 0.0])
    return np.array([1.0, probabilities.max(), np.log1p(probabilities.sum())])


def _entropy(yes: np.ndarray, both: np.ndarray, share: float) -> np.ndarray:
    """Log likelihood ratio of ``yes`` of ``both`` toxic documents against a common ``share``."""
    no = both - yes
    return yes * np.log(np.maximum(yes, 1) / (both * share)) + no * np.log(np.maximum(no, 1) / (both * (1 - share)))


def _lexicon(texts: list[np.ndarray], toxic: np.ndarray, f: Fitting) -> np.ndarray:
    """Features that set toxic documents apart, from the distinct features of each text."""
    sizes = np.array([toxic.sum(), (~toxic).sum()], dtype=float)
    if not sizes.all():
        return np.zeros(0, _text.U64)
    vocabulary, inverse = np.unique(np.concatenate(texts), return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    bad = toxic[owner]
    yes, no = np.bincount(inverse[bad], minlength=len(vocabulary)), np.bincount(inverse[~bad], minlength=len(vocabulary))
    a, b = yes + 0.5, no + 0.5
    odds = np.log(a / (sizes[0] + 1 - a)) - np.log(b / (sizes[1] + 1 - b))
    # the root of the likelihood ratio: features that few documents have are judged fairly even if no plain one has them
    z = np.sqrt(2 * (_entropy(yes, yes + no, sizes[0] / sizes.sum())))
    good = np.flatnonzero((yes >= min(f.least_documents, 2 + sizes[0] / 20)) & (odds > np.log(f.least_odds)) & (z > min(f.least_z, 1.5 + sizes[0] / 100)))
    good = good[np.argsort(-yes[good], kind="stable")][: 8 * f.features]
    if not len(good):
        return np.zeros(0, _text.U64)
    number = np.full(len(vocabulary), -1)
    number[good] = np.arange(len(good))
    has = np.zeros((len(good), len(texts)), bool)
    kept = number[inverse] >= 0
    has[number[inverse[kept]], owner[kept]] = True
    has = has[:, toxic]
    wrong = no[good] * 10.0 * sizes[0] / sizes[1]
    left, chosen, taken = np.full(has.shape[1], f.cover), [], set()
    gain = has.sum(axis=1) - wrong
    for _ in range(f.features):
        best = int(np.argmax(gain))
        if gain[best] < min(f.least_documents, 2 + sizes[0] / 20):
            break
        gain[best] = -1.0
        key = has[best].tobytes()
        if key not in taken:  # a feature of the same documents adds nothing
            chosen.append(best)
            taken.add(key)
            explained = has[best] & (left == 1)
            left = left - has[best]
            gain = gain - has[:, explained].sum(axis=1)
    return np.sort(vocabulary[good[chosen]])


def _gradient(features: np.ndarray, tags: np.ndarray, valid: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
    """Observed minus expected counts of all windows (steps x lanes)."""
    steps, lanes = tags.shape
    emit = np.stack([np.ones((steps, lanes)), np.exp(weights[-1] + np.append(weights[:-1], 0.0)[features].sum(axis=-1))], axis=-1)
    emit[~valid] = 1.0
    move = np.exp(transitions)
    ahead, back = np.zeros((steps, lanes, 2)), np.ones((steps, lanes, 2))
    ahead[0] = emit[0] / emit[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        v = np.where(valid[t][:, None], (ahead[t - 1] @ move) * emit[t], ahead[t - 1])
        ahead[t] = v / v.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        joint = ahead[t - 1][:, :, None] * move[None] * (emit[t] * back[t])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[valid[t]].sum(axis=0)
        v = np.where(valid[t][:, None], (emit[t] * back[t]) @ move.T, back[t])
        back[t - 1] = v / v.sum(axis=1, keepdims=True)
    both = ahead * back
    wrong = np.where(valid, tags - both[:, :, 1] / both.sum(axis=2), 0.0)
    difference = np.append(np.bincount(features.ravel(), weights=np.repeat(wrong.ravel(), SLOTS), minlength=len(weights))[: len(weights) - 1], wrong.sum())
    seen = np.zeros((2, 2))
    later = valid[1:]
    np.add.at(seen, (tags[:-1][later], tags[1:][later]), 1)
    return difference, seen - pairs


def _fit_chain(found: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray, size: int, f: Fitting) -> tuple[np.ndarray, np.ndarray]:
    weights, transitions = np.zeros(size + 1), np.zeros((2, 2))
    weights[-1] = -2.0
    if not size:
        return weights, transitions
    hit, plain = [], []
    for (places, features, length), bad in zip(found, toxic, strict=True):
        part = places // f.window
        for k in range(-(-length // f.window)):
            own = part == k
            (hit if own.any() else plain).append((places[own] - k * f.window, features[own], min(f.window, length - k * f.window), bad))
    half = f.windows // 2
    chosen = hit[:: max(1, -(-len(hit) // half))] + plain[:: max(1, -(-len(plain) // half))]
    features = np.full((f.window, len(chosen), SLOTS), size)
    tags, valid = np.zeros(features.shape[:2], np.int64), np.zeros(features.shape[:2], bool)
    for i, (places, own, length, bad) in enumerate(chosen):
        features[places, i], valid[:length, i] = own, True
        tags[places, i] = int(bad)
    squares_w, squares_t = np.full(weights.shape, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(f.rounds):
        dw, dt = _gradient(features, tags, valid, weights, transitions)
        dw, dt = dw - f.decay * weights, dt - f.decay * transitions
        squares_w += dw**2
        squares_t += dt**2
        weights = weights + dw / np.sqrt(squares_w)
        transitions = transitions + dt / np.sqrt(squares_t)
    return weights, transitions


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_logistic(features: np.ndarray, label: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton steps of bounded length on the penalised likelihood."""
    out = np.zeros(features.shape[1])
    decay = np.diag([1e-3, 0.1, 0.1])
    for _ in range(rounds):
        p = _sigmoid(features @ out)
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + decay, features.T @ (label - p) - decay @ out)
        out = out + step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
    return out


def fit(texts: list[str], toxic: list[int], f: Fitting = Fitting()) -> Field:
    """A field from labelled texts.  Without texts of both labels the lexicon is empty, and every score is the share of toxic texts."""
    label = np.array(toxic, dtype=bool)
    sets = [np.zeros(0, _text.U64)] * len(texts)
    spots = []
    data, offsets = _text.buffers(pa.array(texts, pa.string()))
    for low, high in _text.steps(offsets):
        part = data[offsets[low] : offsets[high]]
        starts, ends, first = _text.spans(part, offsets[low : high + 1] - offsets[low], _text.ALNUM)
        all_tokens, hashes = (np.concatenate(x) for x in zip(*token_features(part, starts, ends), strict=True))
        row = np.searchsorted(first, all_tokens, side="right") - 1
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(high - low + 1))
        for i in range(high - low):
            sets[low + i] = np.unique(hashes[order[cuts[i] : cuts[i + 1]]])
        spots.append((part, starts, ends, first))
    field = Field(_lexicon(sets, label, f) if len(texts) else np.zeros(0, _text.U64), np.zeros(1), np.zeros((2, 2)), np.zeros(3))
    if not len(field.lexicon):
        share = float(label.mean()) if len(label) else 0.0
        field.logistic[0] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return field
    found = []
    for part, starts, ends, first in spots:
        at, features = field.found(part, starts, ends)
        cuts = np.searchsorted(at, first)
        found += [(at[cuts[i] : cuts[i + 1]] - first[i], features[cuts[i] : cuts[i + 1]], int(first[i + 1] - first[i])) for i in range(len(first) - 1)]
    field.weights, field.transitions = _fit_chain(found, label, len(field.lexicon), f)
    rows = [_features(field.marginals(at, field.potentials(features), length)) for at, features, length in found]
    field.logistic = _fit_logistic(np.array(rows), label.astype(float))
    return field


def _tagger(field: Field, tagged: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column("text"))
            for low, high in _text.steps(offsets):
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                starts, ends, first = _text.spans(part, at, _text.ALNUM)
                found, features = field.found(part, starts, ends)
                potentials = field.potentials(features)
                cuts = np.searchsorted(found, first)
                score, spans = np.full(high - low, field.score(np.zeros(0))), [[] for _ in range(high - low)]
                for i in np.flatnonzero(np.diff(cuts)):
                    own = found[cuts[i] : cuts[i + 1]]
                    p = field.marginals(own - first[i], potentials[cuts[i] : cuts[i + 1]], int(first[i + 1] - first[i]))
                    score[i] = field.score(p)
                    text = part[at[i] : at[i + 1]]
                    point = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                    for k, q in zip(own, p, strict=True):
                        if q >= tagged:
                            spans[i].append({"start": int(point[starts[k] - at[i]]), "end": int(point[ends[k] - at[i]]), "probability": float(q)})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
                rest = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score), pa.array(spans, kind)], names=[*rest.schema.names, "score", "spans"])

    return run


def learn(docs: DataFrame, labels: DataFrame, f: Fitting = Fitting()) -> Field:
    """A field from ``labels`` (doc_id, toxic) and the texts of those documents, on a bounded sample of each label.

    Rows with a null id or label are left out; of several labels of one document the largest counts.
    """
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = bounded_sample(rows.join(docs.select("doc_id").where("text IS NOT NULL"), "doc_id", "left_semi"), "toxic", {1: f.documents, 0: f.plain})
    spark = docs.sparkSession
    if not picked:
        return fit([], [], f)
    chosen = F.broadcast(spark.createDataFrame([(int(r["doc_id"]), int(r["toxic"])) for r in picked], "doc_id long, toxic int"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = sorted((r["doc_id"], r["toxic"], r["text"]) for r in found.collect())
    field = fit([t[2] for t in texts], [t[1] for t in texts], f)
    _text.release_memory()
    return field


def score_toxicity(docs: DataFrame, field: Field, text: str = "text", carry: tuple[str, ...] = ("doc_id",), tagged: float = 0.5) -> DataFrame:
    """The columns ``carry`` of each row, with score (0 to 1) and spans, the code-point offsets of toxic tokens.

    A token is in spans if its marginal is at least ``tagged``.  A null or
    wordless text has no span and the score of a text without lexicon words.
    Repeated rows come back as often, each with the same result; other columns
    are not looked at.
    """
    _text.small_batches(docs.sparkSession)
    rows = docs.select(*(c for c in carry if c != "text"), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return rows.mapInArrow(_text.releasing(_tagger(field, tagged)), f"{kinds}, score double, spans {SPANS}").drop(*({"text"} - set(carry)))
