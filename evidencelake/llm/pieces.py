"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

A text gets a space in front, and spaces become the mark ``▁``.  The automaton of
all pieces reads it once; at each position its output links give every piece that
ends there, longest first, and each relaxes the best score of that position from
the one of the piece's start.  A character that is no piece costs a fixed penalty
and becomes its UTF-8 bytes.

No piece crosses from another character to a mark, and none contains a line
break, so that a text falls apart at these places without changing the best
path; the best path of a part is kept and used again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import _text

MARK = "▁"
#: Pieces of a lower score are a last resort and count like unknown characters, which cost so much more than the worst other piece.
_RESORT, _PENALTY = -1e8, 10.0
_MARK_BYTES = MARK.encode()
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Parts whose paths a worker keeps in each of two generations.
_KEPT_PARTS = 150_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores by id, and the kind of each: 0 text, 1 byte, 2 control or unknown."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The vocabulary of a SentencePiece model file with byte fallback."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = tuple(1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in ids)
        if sum(k == 1 for k in kinds) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        return cls(tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), kinds)


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.bytes = [0] * 256
        self.unknown = min((s for s, k in zip(vocabulary.scores, vocabulary.kinds, strict=True) if k == 0 and s > _RESORT), default=0.0) - _PENALTY
        for i, (piece, score, kind) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)):
            if kind == 1:
                self.bytes[int(_BYTE.fullmatch(piece)[1], 16)] = i
            elif kind == 0:
                if MARK in piece[1:].lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} spans words")
                self.automaton.add_word(piece, (len(piece), score if score > _RESORT else self.unknown, i))
        self.automaton.make_automaton()
        self.of_byte = {i: b for b, i in enumerate(self.bytes)}
        raw = [bytes([self.of_byte[i]]) if k == 1 else p.replace(MARK, " ").encode() if k == 0 else b"" for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True))]
        self.sizes = np.array([len(x) for x in raw], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.known: dict[bytes, bytes] = {}
        self.aged: dict[bytes, bytes] = {}

    def best(self, text: str) -> tuple[int, ...]:
        """The ids of the best path through ``text``; of equal scores the longest last piece."""
        n = len(text)
        score: list[float] = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done, single = 0, False  # ends up to ``done`` are final; whether a one-character piece ends at it

        def close(upto: int) -> None:
            nonlocal done, single
            while done < upto:
                if done and not single:
                    s = score[done - 1] + self.unknown
                    if s > score[done]:
                        score[done], back[done] = s, (1, -1)
                done, single = done + 1, False

        for end, (length, value, i) in self.automaton.iter(text):
            end += 1
            if done < end:
                close(end)
            s = score[end - length] + value
            if s > score[end]:
                score[end], back[end] = s, (length, i)
            single = single or length == 1
        close(n + 1)
        out: list[int] = []
        while n:
            length, i = back[n]
            out.extend([i] if i >= 0 else [self.bytes[b] for b in reversed(text[n - 1].encode())])
            n -= length
        return tuple(reversed(out))

    def part(self, raw: bytes) -> bytes:
        """The ids of one part of a text, see ``parts``, as 32-bit numbers."""
        ids = self.known.get(raw)
        if ids is not None:
            return ids
        ids = self.aged.get(raw)
        if ids is None:
            path = [self.bytes[b] for b in raw] if raw in (b"\n", _MARK_BYTES) else self.best(raw.decode().replace(" ", MARK))
            ids = array("i", path).tobytes()
        if len(raw) <= 64:
            if len(self.known) >= _KEPT_PARTS:  # what has not been used again since the last time goes
                self.aged, self.known = self.known, {}
            self.known[raw] = ids
        return ids

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row's begin (and the total)."""
        full = np.flatnonzero(np.diff(offsets))
        text = np.insert(data, offsets[full], 0x20)
        grown = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        if not len(text):
            return np.zeros(0, np.int32), grown
        starts = parts(text, grown)
        ends = np.append(starts[1:], len(text))
        _, first, inverse = np.unique(_text.word_hashes(text, starts, ends, _text.EXACT), return_index=True, return_inverse=True)
        raw = text.tobytes()
        paths = [self.part(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        sizes = np.fromiter(map(len, paths), dtype=np.int64, count=len(paths)) // 4
        pool = np.frombuffer(b"".join(paths), dtype=np.int32)
        each = sizes[inverse]
        flat = _text.gather(pool, (np.cumsum(sizes) - sizes)[inverse], each)
        return flat, np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, grown)]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0].tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of rows of ids: the bytes of all pieces, without the first space."""
        sizes = self.sizes[ids]
        raw = _text.gather(self.pool, self.begins[ids], sizes).tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0]


def parts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the parts of rows of bytes: runs of spaces with what follows, line breaks, marks, and the rest between them."""
    space, line = text == 0x20, text == 0x0A
    begins = line.copy()
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    begins[0] = True
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    mark = np.flatnonzero(text[:-2] == _MARK_BYTES[0]) if len(text) > 2 else np.zeros(0, np.int64)
    mark = mark[(text[mark + 1] == _MARK_BYTES[1]) & (text[mark + 2] == _MARK_BYTES[2])]
    begins[mark] = True
    after = mark + 3
    begins[after[after < len(text)]] = True
    return np.flatnonzero(begins)


_CODERS: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """The worker's coder: made once, kept between tasks."""
    if shared.value_id not in _CODERS:
        _CODERS.clear()
        _CODERS[shared.value_id] = Coder(shared.broadcast.value)
    return _CODERS[shared.value_id]


@dataclass
class _Shared:
    broadcast: object
    value_id: int


def _share(df: DataFrame, vocabulary: Vocabulary) -> _Shared:
    return _Shared(df.sparkSession.sparkContext.broadcast(vocabulary), hash((vocabulary.pieces, vocabulary.scores)))


def _encoder(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            column = batch.column("text")
            data, offsets = _text.buffers(column)
            for low, high in _text.steps(offsets):
                ids, at = coder.encode_all(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                part = batch.slice(low, high - low)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=column.slice(low, high - low).is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "tokens"])

    return run


def _decoder(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                tokens = part.column("tokens")
                size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = coder.decode_all(tokens.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=tokens.is_null().to_numpy(zero_copy_only=False))], names=[*part.schema.names, "decoded"])

    return run


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns of ``docs`` (text, ...) and tokens, the ids of the whole text; a column tokens of its own is replaced.

    A null text has null tokens, an empty one none.  Repeated rows each come back.
    """
    _text.small_batches(docs.sparkSession)
    rows = docs.drop("tokens").withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_encoder(_share(docs, vocabulary)), f"{_kinds(rows)}, tokens array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns of ``rows`` (tokens, ...) and decoded, the text; a column decoded of its own is replaced.

    Null tokens decode to null.  What ``encode`` has made of a text decodes to
    exactly that text.
    """
    _text.small_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decoder(_share(rows, vocabulary)), f"{_kinds(rows)}, decoded string")
