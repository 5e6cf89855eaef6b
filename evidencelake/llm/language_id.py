"""Language identification by cross-parsing against suffix automata.

For every language a suffix automaton of a bounded labelled sample recognises
exactly the substrings of that sample.  A text is parsed greedily into longest
matches; a language close to the text needs few of them.  The cross-parsing
entropy of a text of n letters in c phrases against a sample of N letters is
c * log2(N) / n bits a letter, and the language with the least of it wins.

Only letters count: they are lower-cased, and every run of other characters is
one space.  Many stretches of ``BLOCK`` symbols are parsed at a time: one table look-up a
symbol and language, with the phrase count in the low bits of the entry.  A stretch
that does not begin in the state where the one before it has ended is parsed
again from there, until none is left, so phrases run through the whole text.  The table has columns for the most frequent letters only;
transitions of all other learned letters are in a sorted list.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import _text
from evidencelake.llm._sample import bounded_sample

UNDETERMINED = "und"
BLOCK = 512
#: Letters with columns in the table, at most, and entries of the table, about so many at most.
DENSE, ENTRIES = 60, 1 << 24
SPACE = " "


@dataclass(frozen=True)
class Sampling:
    """Bounds of the sample that is learned: documents of a language, pieces of a document and code points of a piece.

    A document of at most pieces * characters code points is learned whole, of a
    longer one a piece at a hashed place of each of as many equal parts.
    """

    documents: int = 100
    pieces: int = 4
    characters: int = 100


def fold(c: str) -> str:
    """The symbol of a character: its lower-case letter, or a space."""
    return c.lower()[0] if c.isalpha() else SPACE


def normalise(text: str) -> str:
    """Lower-cased letters, and each run of anything else as one space; none at the start."""
    out, last = [], SPACE
    for c in map(fold, text):
        if c != SPACE or last != SPACE:
            out.append(c)
        last = c
    return "".join(out)


class SuffixAutomaton:
    """The minimal automaton of all substrings of a text, built online."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            last = self._extend(last, c)

    def _extend(self, last: int, c: str) -> int:
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] != self.length[p] + 1:
                copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = copy
                    p = self.link[p]
                self.link[q] = copy
                q = copy
            self.link[new] = q
        return new

    def _state(self, following: dict[str, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def phrases(self, text: str) -> int:
        """Longest matches that ``text`` takes, one after the other; an unknown symbol is a phrase."""
        count, state = 0, 0
        for c in text:
            if c in self.next[state]:
                state = self.next[state][c]
                continue
            count += state != 0
            state = self.next[0].get(c, 0)
            count += state == 0
        return count + (state != 0)


@dataclass
class Model:
    """Tables of all languages, one after the other.

    A state is the offset of its row; an entry holds the next state times four,
    plus the phrases that end there (none, the one before, or that and an unknown
    symbol).  ``codes`` gives the symbol of every code point: 0 pads, 1 is a
    space, 2 a letter outside the alphabet, then the alphabet, the most frequent
    letters first.  Symbols from ``width`` on have no column; ``keys`` has their
    transitions, sorted, as state * number of symbols + symbol, and ``targets`` the
    states that they lead to.
    """

    languages: list[str]
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    codes: np.ndarray
    width: int
    number: int
    keys: np.ndarray
    targets: np.ndarray

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """State after each symbol without a column, or -1."""
        if not len(self.keys):
            return np.full(len(states), -1, np.int32)
        wanted = states.astype(np.int64) * self.number + symbols
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], -1)

    def entries(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Entry of each language's states (a row each) at the symbols of the lanes."""
        rare = np.flatnonzero(symbols >= self.width)
        if not len(rare):
            return self.table[states + symbols]
        out = self.table[states + np.where(symbols < self.width, symbols, 2)]
        own = states[:, rare].ravel()
        letters = np.tile(symbols[rare], len(states))
        roots = np.repeat(self.roots, len(rare))
        to, again = self.follow(own, letters), self.follow(roots, letters)
        found = np.where(to >= 0, to * 4, np.where(again >= 0, again * 4 + 1, out[:, rare].ravel()))
        out[:, rare] = found.reshape(len(states), -1)
        return out


def fit(samples: dict[str, str], dense: int = DENSE) -> Model:
    """A model of normalised samples; languages with an empty sample are left out.

    ``dense`` letters at most have columns in the table; results do not depend on it.
    """
    languages = sorted(lang for lang, text in samples.items() if text.strip())
    often = Counter()
    for lang in languages:
        often.update(samples[lang])
    del often[SPACE]
    alphabet = sorted(often, key=lambda c: (-often[c], c))
    symbol = {c: i + 3 for i, c in enumerate(alphabet)} | {SPACE: 1}
    # an automaton has fewer than two states a symbol
    states = sum(2 * len(samples[lang]) for lang in languages)
    width = 3 + max(0, min(len(alphabet), dense, ENTRIES // max(1, states) - 3))
    number = len(alphabet) + 3
    codes = np.ones(0x110000, dtype=np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            codes[point] = symbol.get(fold(c), 2)
    every = np.empty(states * width + width, dtype=np.int32)
    roots, bits, base = [], [], 0
    keys, targets = array("q"), array("q")
    for lang in languages:
        automaton = SuffixAutomaton(samples[lang])
        rows = len(automaton.next)
        root = np.full(width, -1, dtype=np.int64)
        for c, to in automaton.next[0].items():
            if symbol[c] < width:
                root[symbol[c]] = base + to * width
        unknown = root < 0
        # no transition: the phrase has ended, and the next begins at the root
        if (base + rows * width) * 4 > np.iinfo(np.int32).max:
            raise ValueError("the samples are too large: take fewer documents of each language")
        table = every[base : base + rows * width].reshape(rows, width)
        table[:] = np.where(unknown, base * 4 + 2, root * 4 + 1)
        table[0] = np.where(unknown, base * 4 + 1, root * 4)
        for state, following in enumerate(automaton.next):
            for c, to in following.items():
                if symbol[c] < width:
                    table[state, symbol[c]] = (base + to * width) * 4
                else:
                    keys.append((base + state * width) * number + symbol[c])
                    targets.append(base + to * width)
        table[:, 0] = (base + np.arange(rows) * width) * 4
        roots.append(base)
        bits.append(math.log2(max(2, len(samples[lang]))))
        base += rows * width
    table = every[:base]
    rare, to = np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int32)
    order = np.argsort(rare)
    return Model(languages, table, np.array(roots, dtype=np.int32), np.array(bits), codes, width, number, rare[order], to[order])


def _advance(model: Model, symbols: np.ndarray, low: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each stretch of ``symbols``, and the state after it, for each language (a row each) from its ``entry``."""
    order = np.argsort(-length, kind="stable")
    length = length[order]
    columns = symbols[low[order][None, :] + np.arange(int(length[0]))[:, None]]
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    state, count = entry[:, order], np.zeros(entry.shape, dtype=np.int64)
    for t, n in enumerate(active):
        found = model.entries(state[:, :n], columns[t, :n])
        count[:, :n] += found & 3
        state[:, :n] = found >> 2
    back = np.argsort(order, kind="stable")
    return count[:, back], state[:, back]


def parse(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each row, and its entropy in bits a letter under each language (infinite without a letter)."""
    rows, k = len(offsets) - 1, len(model.languages)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    symbols = model.codes[points]
    gap = symbols == 1
    again = gap.copy()
    again[1:] &= gap[:-1]
    starts = at[:-1][at[:-1] < at[1:]]
    again[starts] = gap[starts]
    total = np.concatenate([[0], np.cumsum(~again)])
    symbols, at = symbols[~again], total[at]
    letters = np.diff(np.concatenate([[0], np.cumsum(symbols != 1)])[at])
    blocks = -(-np.diff(at) // BLOCK)
    row = np.repeat(np.arange(rows), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = at[row] + number * BLOCK
    length = np.minimum(BLOCK, at[row + 1] - low)
    phrases = np.zeros((k, rows))
    if len(row) and k:
        padded = np.concatenate([symbols, np.zeros(BLOCK, np.int32)])
        opens = number == 0
        entry = np.repeat(model.roots[:, None], len(row), axis=1)
        leave, count = entry.copy(), np.zeros(entry.shape, dtype=np.int64)
        pending = np.arange(len(row))
        while len(pending):
            count[:, pending], leave[:, pending] = _advance(model, padded, low[pending], length[pending], entry[:, pending])
            after = pending[pending + 1 < len(row)] + 1
            after = after[~opens[after]]
            pending = after[(entry[:, after] != leave[:, after - 1]).any(axis=0)]
            entry[:, pending] = leave[:, pending - 1]
        closes = np.append(opens[1:], True)
        count += closes & (leave != model.roots[:, None])
        for i in range(k):
            phrases[i] = np.bincount(row, weights=count[i], minlength=rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        return letters, np.where(letters[:, None] > 0, phrases.T * model.bits / letters[:, None], np.inf)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            data, offsets = _text.buffers(batch.column("text"))
            for low, high in _text.steps(offsets):
                letters, bits = parse(model, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                known = (letters > 0) & bool(model.languages)
                if model.languages:
                    best = np.argmin(bits, axis=1)
                    two = np.sort(np.column_stack([bits, np.full(len(bits), np.inf)]), axis=1)[:, :2]
                    score = np.ones(len(bits))
                    rival = known & np.isfinite(two[:, 1])
                    score[rival] = two[rival, 1] / (two[rival, 0] + two[rival, 1])
                    least = np.where(known, two[:, 0], np.nan)
                else:
                    best, score, least = np.zeros(high - low, int), np.zeros(high - low), np.full(high - low, np.nan)
                out = pa.RecordBatch.from_arrays([pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(least, mask=~known)], names=["lang_pred", "score", "bits"])
                rest = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rest.columns, *out.columns], names=[*rest.schema.names, *out.schema.names])

    return run


def learn(rows: DataFrame, sampling: Sampling = Sampling()) -> Model:
    """A model from ``rows`` (doc_id, text, lang): a bounded sample of the rows of each language."""
    n, size = F.length("text"), sampling.characters
    part = F.floor(n / sampling.pieces).cast("int")
    place = lambda i: F.lit(i) * part + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(part - size + 1, F.lit(1))).cast("int")
    spread = F.concat_ws(SPACE, *(F.substring(F.col("text"), place(i) + 1, F.lit(size)) for i in range(sampling.pieces)))
    texts = rows.select("doc_id", "lang", F.when(n > sampling.pieces * size, spread).otherwise(F.col("text")).alias("text"))
    learned: dict[str, list[str]] = {}
    for r in bounded_sample(texts.where("text IS NOT NULL"), "lang", sampling.documents):
        learned.setdefault(r["lang"], []).append(normalise(r["text"]))
    model = fit({lang: SPACE.join(p) for lang, p in learned.items()})
    _text.release_memory()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of each row of ``docs``, with lang_pred, score and bits.

    lang_pred is the language of the least cross-parsing entropy (ties: the first
    in natural order), or ``und`` if the text is null or has no letter, or if the
    model knows no language.  score is e2 / (e1 + e2) of the two least entropies,
    so 0.5 is a tie and 1 a certain case; 0 with ``und``.  bits is e1, null with
    ``und``.  Repeated rows come back as often; other columns are not looked at.
    """
    _text.small_batches(docs.sparkSession)
    rows = docs.select(*(c for c in carry if c != "text"), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_text.releasing(_predictor(shared)), f"{kinds}, lang_pred string, score double, bits double").drop(*({"text"} - set(carry)))
