"""URL verdicts from host rules and from association rules mined with FP-growth.

Listed rules decide the urls that they fit.  All of those urls are also the labelled
transactions of Spark's FP-growth: their tokens and their verdict are the items,
and rules from tokens to a verdict are kept by support and confidence.  Urls that
no listed rule fits get the verdict of the surest mined rule whose tokens they
hold, found by an inverted index from one token of each rule; failing that, the
default.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "verdict="


@dataclass(frozen=True)
class Mining:
    """Least support and confidence of a rule, most tokens, most rules."""

    support: float = 0.005
    confidence: float = 0.8
    tokens: int = 3
    rules: int = 100_000
    default: str = "allow"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest of ``rules`` (verdict, host/path) that fits the columns host and path; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        host = (F.col("host") == name) | F.endswith("host", F.lit(f".{name}"))
        fits = host & F.startswith("path", F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of host and path: labels and words, digits as one token."""
    split = lambda c, mark: F.transform(F.split(c, "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"), lambda t: F.when(t == "", F.lit(None)).otherwise(F.concat(F.lit(mark), F.when(t.rlike("^[0-9]+$"), "#").otherwise(F.lower(t)))))
    return F.array_distinct(F.array_compact(F.concat(split(F.col("host"), "h:"), split(F.col("path"), "p:"))))


def mine(labelled: DataFrame, m: Mining) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support) of the mined rules, surest first; ``labelled`` has tokens and verdict."""
    if labelled.select("verdict").distinct().count() < 2:
        return []
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=m.support, minConfidence=m.confidence, numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(items)
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit(_LABEL)) & (F.size("antecedent") <= m.tokens))
    if found.count() > m.rules:
        raise ValueError("more rules than can be shared: raise the least support or confidence")
    rules = [(tuple(sorted(r["antecedent"])), r["consequent"][0][len(_LABEL) :], r["confidence"], r["support"]) for r in found.collect()]
    return sorted(rules, key=lambda r: (-r[2], -r[3], len(r[0]), r[0], r[1]))


def _matcher(rules: list[tuple[tuple[str, ...], str, float, float]], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[str, int] = {}
        for words, *_ in rules:
            for w in words:
                often[w] = often.get(w, 0) + 1
        index: dict[str, list[int]] = {}
        for i, (words, *_) in enumerate(rules):
            index.setdefault(min(words, key=lambda w: (often[w], w)), []).append(i)
        sets = [frozenset(r[0]) for r in rules]
        for batch in batches:
            verdict, confidence = batch.column("verdict").to_pylist(), []
            for n, words in enumerate(batch.column("tokens").to_pylist()):
                best = None
                if verdict[n] is None:
                    own = frozenset(words)
                    best = min((i for w in own for i in index.get(w, ()) if sets[i] <= own), default=None)
                    verdict[n] = default if best is None else rules[best][1]
                confidence.append(None if best is None else rules[best][2])
            at = batch.schema.get_field_index("verdict")
            out = batch.set_column(at, "verdict", pa.array(verdict, pa.string())).drop_columns(["tokens"])
            yield out.append_column("confidence", pa.array(confidence, pa.float64()))

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], m: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of a mined rule, else null) of each row of ``pages`` (page_id, url).

    A null url or one without ``://`` has an empty host and path, fits no rule and
    gets the default verdict.  A rule fits its host and subdomains if the path
    starts with the rule's path, so one that ends in ``/`` does not fit an empty
    path.  Repeated rows come back alike.  Without labelled urls of two verdicts
    nothing is mined.  Other columns are not looked at.
    """
    host, path = host_and_path("url")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(rules)
    ready = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens().alias("tokens"))
    mined = mine(ready.where("verdict IS NOT NULL").select("tokens", "verdict"), m)
    return ready.mapInArrow(_matcher(mined, m.default), "page_id long, host string, path string, rule string, verdict string, confidence double")
