"""Secret scans over an incremental ledger of blobs.

A version of a path is known by its blob, the SHA-256 of its text; equal texts are one
blob, whatever paths and times they stand under.  The ledger is a Parquet table of
scans: a blob, the rules (name and version) that a scan ran on it, and the spans they found.
An update scans the pairs of a blob and a rule version that the ledger lacks, each
once, and appends them; findings are joined back to all paths by blob.  Raising a rule's
version makes all its pairs unseen; what the old version found stays in the ledger and
is no longer reported.

Texts stay where they are read: one scan of the paths gives their blobs, from which the one
row that is to be scanned for each blob is chosen, and a second scan runs the rules on those rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.llm import _text
from evidencelake.llm._store import cut

#: Bytes of chosen or passed-over rows up to which they are sent to all tasks, and of one such row.
SENT_BYTES, _ROW_BYTES = 64 << 20, 96
#: Bytes of what is reported of a blob besides its spans, and of a span.
_BLOB_BYTES, _SPAN_BYTES = 256, 64


@dataclass(frozen=True)
class Rule:
    """Spans of ``kind``: leftmost matches of ``pattern`` that do not overlap, of which those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds in their order.  (?a) keeps "either case" to ASCII letters.
BASE_RULES = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]+", 24),
)
#: Further kinds whose form alone tells them: keys in armour, tokens with a registered prefix, signed JSON tokens.
MORE_RULES = (
    Rule("armour", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("prefixed", 1, r"(?:ghp|gho|ghu|ghs|ghr|glpat|xoxb|xoxp)[_-][A-Za-z0-9-]+", 24),
    Rule("signed", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
RULES = (*BASE_RULES, *MORE_RULES)

_SPANS = "array<struct<rule:string,low:int,high:int>>"
_LEDGER = f"blob binary, rules array<string>, spans {_SPANS}"


def find(text: str, rule: Rule, compiled: re.Pattern | None = None) -> list[tuple[int, int]]:
    """The spans of one rule in one text, in code points, end exclusive."""
    compiled = compiled or re.compile(rule.pattern)
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: tuple[Rule, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name: (r, re.compile(r.pattern)) for r in rules}
        for batch in batches:
            blobs, names, found = [], [], []
            for blob, text, wanted in zip(batch.column("blob").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                own = text.as_py()
                blobs.append(blob)
                names.append(wanted)
                found.append([{"rule": n, "low": a, "high": b} for n in wanted for a, b in find(own, *compiled[n])])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(names, pa.list_(pa.string())), pa.array(found, kind)], names=["blob", "rules", "spans"])

    return run


def blob_of(text: str) -> Column:
    """The content address of a text; a null is an empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


class Ledger:
    """The scans stored under ``folder``, to which updates append.

    An update's rows appear when its one Spark job commits.  An update that fails
    leaves the ledger as it was; one that runs twice, or beside another, adds rows that
    say the same, which readers take once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """blob, rules, spans of all scans; no rows before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(self.folder)

    def unseen(self, blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The rows of ``blobs`` (a distinct blob, and any columns) on which some rule has not run, with wanted, the names of those rules."""
        names = F.array(*(F.lit(r.name) for r in rules))
        seen = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        wanted = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select(*blobs.columns, wanted.alias("wanted")).where(F.size("wanted") > 0)

    def update(self, versions: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen of ``versions`` and append it; returns path and blob of each of its rows.

        A null text is empty, and a null path one like any other.  Rows that repeat
        whole are merged before they are scanned.  Other columns are not looked at.
        """
        _text.small_batches(self.spark)
        known = cut(versions.select(F.col(path).alias("path"), blob_of(text).alias("blob")), "blobs")
        pairs = known.groupBy("blob", "path").agg(F.count("*").alias("rows"))
        # of each blob the row of its least path is scanned
        chosen = pairs.groupBy("blob").agg(F.min("path").alias("path"), F.max("rows").alias("rows"))
        wanted = cut(self.unseen(chosen, rules), "unseen")
        own = F.coalesce(F.col(text).cast("string"), F.lit(""))
        rows = versions.select(F.col(path).alias("path"), own.alias("text"), blob_of(text).alias("blob"))
        self._once(self._due(rows, pairs, wanted, [r.name for r in rules]), wanted).mapInArrow(_text.releasing(_scanner(rules)), _LEDGER).write.mode("append").parquet(self.folder)
        return known

    def _once(self, due: DataFrame, wanted: DataFrame) -> DataFrame:
        """``due`` with one row of each blob of which rows repeat whole; only these are shuffled, and merged in their tasks first."""
        repeated = wanted.where("rows > 1").select("blob")
        n = repeated.count()
        if not n:
            return due
        few = F.broadcast(repeated) if n * _ROW_BYTES < SENT_BYTES else repeated
        merged = due.join(few, "blob", "left_semi").groupBy("blob").agg(F.max("text").alias("text"), F.max("wanted").alias("wanted"))
        return due.join(few, "blob", "left_anti").unionByName(merged)

    def _due(self, rows: DataFrame, pairs: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
        """The rows that ``wanted`` names, with the rules that each lacks.

        Texts are not sorted.  If all wanted rows lack all rules, the rows to pass over can be
        joined instead, where they are fewer; either side is broadcast only after a count, and
        otherwise meets the texts in a hash join by blob and path.
        """
        match = lambda a, b: [a.blob == b.blob, a.path.eqNullSafe(b.path)]
        beside = lambda few, n: F.broadcast(few) if n * _ROW_BYTES < SENT_BYTES else few.hint("shuffle_hash")
        n = wanted.count()
        if wanted.where(F.size("wanted") < len(names)).isEmpty():
            m = pairs.count() - n  # every wanted row is one of the pairs
            if m < n:
                passed = pairs.join(wanted, match(pairs, wanted), "left_anti").select("blob", "path")
                kept = rows.join(beside(passed, m), match(rows, passed), "left_anti")
                return kept.select("blob", "text", F.array(*(F.lit(x) for x in names)).alias("wanted"))
        return rows.join(beside(wanted, n), match(rows, wanted)).select(rows.blob, "text", "wanted")

    def findings_bytes(self) -> int:
        """At least the bytes of all ``findings``, from the sizes of the stored spans."""
        n = self.rows().where(F.size("spans") > 0).agg(F.count("*").alias("blobs"), F.sum(F.size("spans")).alias("spans")).first()
        return n["blobs"] * _BLOB_BYTES + (n["spans"] or 0) * _SPAN_BYTES

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and spans (low, place, kind, high) of every blob in which these rule versions have found any, by low and the order of ``rules``."""
        place = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
        current = F.filter("spans", lambda s: F.array_contains(F.array(*(F.lit(r.name) for r in rules)), s.rule))
        rows = self.rows().select("blob", current.alias("spans")).where(F.size("spans") > 0)
        every = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
        named = F.transform("spans", lambda s: F.struct(s.low.alias("low"), place[s.rule].alias("place"), F.substring_index(s.rule, "@", 1).alias("kind"), s.high.alias("high")))
        return every.select("blob", F.array_sort(named).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.low.cast("string"), s.high.cast("string"))), ",")


def secret_report(ledger: Ledger, known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, counts of the base kinds, the SHA-256 of the base spans as text, and all spans as text, for each row of ``known`` (path, blob).

    What was found in a blob is put into words once; then all paths of the blob, which
    may be a large part of all rows, are joined to that one row: where they are, if all findings
    are small enough to be sent to them.
    """
    base = [r.kind for r in BASE_RULES]
    of = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    found = ledger.findings(rules).select("blob", *counts, F.sha2(as_text(of(*base)).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    joined = known.join(F.broadcast(found) if ledger.findings_bytes() < SENT_BYTES else found, "blob", "left")
    return joined.select("path", "blob", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base), F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
