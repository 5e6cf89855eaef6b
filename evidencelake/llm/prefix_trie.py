"""The trie of conversation prefixes, from globally sorted turn arrays.

A turn is known by 16 bytes of the SHA-256 of its role and text, so an array of turns is
16 bytes a turn and texts are read once and never sorted.  Arrays are sorted by range over
all partitions.  Neighbours in that order share a prefix of so many turns (their LCP),
and the nodes of the trie are the intervals of arrays that share it.  One sweep over
a partition holds the nodes of the current array on a stack: the next array
closes those deeper than its LCP and opens its own rest.

A node whose interval crosses a boundary of partitions is among the LCP of the last array
before the boundary and the first one behind it.  The sweep of each partition knows those
two LCPs, and gives such nodes back open, as a part.  Every figure of a node is a sum over its parts, because
what is counted once for a node (its bytes, its place among its parent's
children, whether it is a leaf) is counted by one part only: the first, or for leaves
the one in which the last of its own arrays lies.  Parts of a node meet by a digest of its prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm._store import cut

KEY_BYTES = 16
#: Closed nodes whose parent is still open and that a sweep holds, and member ids that are put in words at once.
PENDING, CHUNK = 1 << 14, 1 << 12

_FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_SWEPT = "kind string, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, piece long"
_TURN = "struct<turn:bigint,key:binary,bytes:bigint>"


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (an array of turn, key, bytes, in order) of each conversation.

    Turns follow one another by turn, null first; turns of one number by role and then
    text.  A null role or text is empty; rows without a conv_id belong to no conversation.
    Conversations in which different turns share a number are read a second time for their
    texts; all others are put in order by keys alone.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    size = F.octet_length("role").cast("string")
    digest = F.sha2(F.concat(size, F.lit(":"), "role", "text").cast("binary"), 256)
    key = F.unhex(F.left(digest, F.lit(2 * KEY_BYTES)))
    keyed = rows.withColumns({"key": key, "bytes": F.octet_length("text").cast("long")})
    arrays = cut(keyed.select("conv_id", F.struct("turn", "key", "bytes").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")), "turns")
    arrays = arrays.withColumn("turns", _nulls_first(F.col("turns")))
    ambiguous = F.exists(F.sequence(F.lit(1), F.size("turns") - 1), lambda i: F.get("turns", i)["turn"].eqNullSafe(F.get("turns", i - 1)["turn"]) & (F.get("turns", i)["key"] != F.get("turns", i - 1)["key"]))
    tied = cut(arrays.where((F.size("turns") > 1) & ambiguous).select("conv_id"), "tied")
    if tied.isEmpty():
        return arrays
    full = F.struct(F.col("turn").isNotNull().alias("has"), "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "key", "bytes")
    again = keyed.join(tied, "conv_id", "left_semi").select("conv_id", full.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    ordered = again.select("conv_id", F.transform("t", lambda t: F.struct(t.turn.alias("turn"), t.key.alias("key"), t.bytes.alias("bytes"))).cast(f"array<{_TURN}>").alias("turns"))
    return arrays.join(tied, "conv_id", "left_anti").unionByName(ordered)


def _nulls_first(turns: Column) -> Column:
    """A sorted array of turns with those of no number in front."""
    return F.concat(F.filter(turns, lambda t: t.turn.isNull()), F.filter(turns, lambda t: t.turn.isNotNull()))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """conv_id c with keys and bytes of its rebuilt turns: the first h of conversation c - c % 5, then its own from the h-th on; h = crc32(c) % 9."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    bases = arrays.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("opening"))
    joined = arrays.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": h}).join(bases, "base", "left")
    none = F.array().cast(f"array<{_TURN}>")
    turns = F.concat(F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return joined.select("conv_id", turns.alias("turns")).select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.bytes").alias("bytes"))


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def _lcps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range the LCP of its first array with the one before it, and of its last with the one behind it; -1 where there is none."""
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("range", "first", "last", "before", "after")}
        left, right = ([-1 if y is None else _common(x, y) for x, y in zip(c[m], c[n], strict=True)] for m, n in (("first", "before"), ("last", "after")))
        yield pa.RecordBatch.from_arrays([pa.array(c["range"], pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["range", "left", "right"])


def boundaries(ranged: DataFrame) -> DataFrame:
    """range, left and right (see ``_lcps``): one row for each range that has rows."""
    ends = ranged.groupBy("range").agg(F.min("keys").alias("first"), F.max("keys").alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("range")
    return ends.select("*", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after")).mapInArrow(_lcps, "range int, left int, right int")


class _Node:
    """An open node: its figures so far, the ids of its own arrays, and closed children that wait for its least id."""

    __slots__ = ("bytes", "children", "chunk", "conv", "digest", "hash", "known", "leaves", "n", "new", "pending", "saved", "started")

    def __init__(self, size: int, conv: int, new: bool):
        self.bytes, self.conv, self.new = size, conv, new
        self.n = self.children = self.leaves = self.saved = 0
        self.known, self.started, self.digest, self.hash = False, False, None, None
        self.chunk: list[int] = []
        self.pending: list[tuple] = []


class _Sweep:
    """The stack sweep over the arrays of one partition, in order; ``out`` gathers the rows of ``_SWEPT``."""

    def __init__(self, at: int, left: int, right: int):
        self.at, self.left, self.right = at, left, right
        self.stack: list[_Node] = []
        self.keys: list[bytes] = []
        self.out: list[tuple] = []
        self.first, self.held, self.pieces = True, 0, 0

    def _digest(self, depth: int) -> bytes:
        """The digest of the node of the current array at ``depth``, chained from the root's."""
        low = depth
        while low and self.stack[low].digest is None:
            low -= 1
        if not low and self.stack[0].digest is None:
            self.stack[0].digest = b"root".ljust(KEY_BYTES, b"\0")
        for i in range(low + 1, depth + 1):
            self.stack[i].digest = hashlib.sha256(self.stack[i - 1].digest + self.keys[i - 1]).digest()[:KEY_BYTES]
        return self.stack[depth].digest

    def _shared(self, depth: int, last: bool) -> bool:
        """Whether the node at ``depth`` of the current array has parts in other partitions."""
        return not self.stack[depth].new or last and depth <= self.right

    def _words(self, depth: int, give: bool) -> None:
        """Take the ids gathered so far into the hash of a node's own arrays; give them back in words too if it has, or may have, other parts."""
        node = self.stack[depth]
        words = ",".join(map(str, node.chunk))
        node.hash = node.hash or hashlib.sha256()
        node.hash.update(("," * node.started + words).encode())
        node.chunk, node.started = [], True
        if give:
            self.out.append(("ends", self._digest(depth), *[None] * 8, words, self.at << 32 | self.pieces))
            self.pieces += 1

    def _release(self) -> None:
        """Give waiting children back with the digest of their parent, which then tells its least id itself."""
        for depth, node in enumerate(self.stack):
            if node.pending:
                digest, node.known = self._digest(depth), True
                self.out += [("node", None, digest, *row[:2], None, *row[2:], None) for row in node.pending]
                node.pending = []
        self.held = 0

    def _close(self, last: bool) -> None:
        depth = len(self.stack) - 1
        node = self.stack[depth]
        shared = self._shared(depth, last)
        node.saved += node.n * node.bytes - (node.bytes if node.new else 0)
        figures = (node.n, node.children, node.leaves, node.saved)
        if shared or node.known:
            digest = self._digest(depth)
            self.out += [("node", None, digest, *row[:2], None, *row[2:], None) for row in node.pending]
        else:
            self.out += [("node", None, None, *row[:2], node.conv, *row[2:], None) for row in node.pending]
        self.held -= len(node.pending)
        if node.chunk:
            self._words(depth, shared)
        if shared:
            self.out.append(("part", self._digest(depth), self._digest(depth - 1) if depth else None, node.conv, depth, None, *figures, None, None))
        else:
            row = (node.conv, depth, *figures, (node.hash or hashlib.sha256()).hexdigest())
            if node.known:
                self.out.append(("least", self.stack[depth].digest, None, node.conv, *[None] * 8))
            if depth:
                self.stack[depth - 1].pending.append(row)
                self.held += 1
            else:
                self.out.append(("node", None, None, *row[:2], None, *row[2:], None))
        self.stack.pop()
        if depth:
            above = self.stack[-1]
            above.n, above.conv = above.n + node.n, min(above.conv, node.conv)
            above.children, above.leaves, above.saved = above.children + node.new, above.leaves + node.leaves, above.saved + node.saved
        del self.keys[max(0, depth - 1) :]

    def add(self, keys: list[bytes], sizes: list[int], conv: int) -> None:
        common = _common(self.keys, keys)
        if self.stack and common < len(self.keys):
            self.stack[-1].leaves += 1  # no longer array goes on from the last one
            while len(self.stack) > common + 1:
                self._close(False)
        for depth in range(len(self.stack), len(keys) + 1):
            self.stack.append(_Node(sizes[depth - 1] if depth else 0, conv, not (self.first and depth <= self.left)))
        self.keys, self.first = keys, False
        end = self.stack[-1]
        end.n, end.conv = end.n + 1, min(end.conv, conv)
        end.chunk.append(conv)
        if len(end.chunk) >= CHUNK:
            self._words(len(keys), not end.new or len(keys) <= self.right)
        if self.held > PENDING:
            self._release()

    def finish(self) -> None:
        if self.stack:
            if self.right < len(self.keys):
                self.stack[-1].leaves += 1
            while self.stack:
                self._close(True)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split(" ")[0] for part in _SWEPT.split(", ")]
    kinds = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[part.split(" ")[1]] for part in _SWEPT.split(", ")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    sweep = None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("range", "left", "right", "keys", "bytes", "conv_id")]
        for at, left, right, keys, sizes, conv in zip(*columns, strict=True):
            if sweep is None or sweep.at != at:
                if sweep:
                    sweep.finish()
                    yield table(sweep.out)
                sweep = _Sweep(at, left, right)
            sweep.add(keys, sizes, conv)
            if len(sweep.out) >= PENDING:
                yield table(sweep.out)
                sweep.out = []
    if sweep:
        sweep.finish()
        yield table(sweep.out)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of all words of each node; its pieces follow one another."""
    node, state, done = None, None, []
    for batch in batches:
        for own, words in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if own != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(words.encode())
            else:
                state.update(f",{words}".encode())
    if state:
        done.append((node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends"])


def prefix_nodes(conversations: DataFrame, sent_bytes: int = 64 << 20) -> DataFrame:
    """The nodes of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Returns conv_id (the least of a node's members), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.  A conversation without a rebuilt turn
    ends in the root.  Without a conversation there is no root and no row.  Rows that repeat are
    turns of their own.  Other columns are not looked at.

    The array of one conversation is one row, 24 bytes a turn.  A SHA-256 takes its input
    in one go, so the ids of equal arrays over many partitions come together in one task, as
    words of 4,096 ids each that are streamed and not held.
    """
    ranged = cut(rebuilt(turn_arrays(conversations)).repartitionByRange("keys", "conv_id").withColumn("range", F.spark_partition_id()), "ranges")
    bounds = cut(boundaries(ranged), "boundaries")  # a row for each range
    ranges = (bounds.agg(F.max("range")).first()[0] or 0) + 1
    dealt = ranged.join(F.broadcast(bounds), "range").repartitionById(ranges, F.col("range"))
    swept = cut(dealt.sortWithinPartitions("range", "keys", "conv_id").mapInArrow(_swept, _SWEPT), "swept")
    of = lambda kind: swept.where(F.col("kind") == kind)
    words = of("ends").select("node", "piece", "ends").repartition("node").sortWithinPartitions("node", "piece").mapInArrow(_ends, "node binary, ends string")
    parts = of("part").groupBy("node", "depth").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in _FIGURES))
    whole = cut(parts.join(words, "node", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))), "parts")
    # only shared nodes, and those with more children than a sweep holds, are looked up by their children
    least = cut(whole.select("node", "conv_id").unionByName(of("least").select("node", "conv_id")).select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), "least")
    least = F.broadcast(least) if least.count() * 64 < sent_bytes else least
    columns = ["parent", "conv_id", "depth", "parent_conv_id", *_FIGURES, "ends"]
    nodes = of("node").select(*columns).unionByName(whole.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    told = nodes.join(least, "parent", "left")
    return told.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *_FIGURES, F.col("ends").alias("ends_sha256"))
