"""The corpus pipeline: raw ``documents`` to tokens, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it has
kept, and returns a DataFrame; ``run`` writes every stage's result as Parquet and
reads it back for the next.  All stages but the last return the columns of docs.

1. toxicity: documents whose score is 0.7 or more go.  The chain field is fitted
   on the documents of ``labels`` (crc32 of the id modulo 3 = 1 left out).
2. language: documents without a letter, or as far from every learned language as
   ``FAR_BITS`` says, go.  Learned from the lang column of docs (crc32 of the id
   modulo 4 = 2 left out).
3. near_duplicates: of each group, linked by a Jaccard similarity of 0.8 or more of
   5-word shingles, the document of the smallest id stays.
4. decontamination: documents with a window of ten words of a benchmark item go.
5. tokens: every document left gets the ids of its whole text.

A null or empty text passes the first stage and goes in the second.  A null doc_id
links with nothing and stays.  Rows that repeat share a fate, except that the third
stage keeps one row of a group; if an id repeats with different texts, all its rows
go there if one does, or one of them stays.  Columns of any name are carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.llm import language_id, pieces, toxicity
from evidencelake.llm._sample import crc_remainder
from evidencelake.llm._store import cut, forget, scope
from evidencelake.llm.decontamination import contamination
from evidencelake.llm.near_dedup import BROADCAST_BYTES, Similarity, near_duplicates

TOXIC = 0.7
#: A text of ``FAR_LENGTH`` characters or more that needs so many bits a letter is in no learned language.
FAR_BITS, FAR_LENGTH = 9.0, 60
VOCABULARY = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows of ``docs`` that ``keep`` holds for, where ``judge`` carries row and text and adds columns."""
    others = [c for c in docs.columns if c != "text"]
    found = judge(docs.select(F.struct(*others).alias("row"), "text")).where(keep)
    return found.select(*("text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scope(spark, "pipeline"):
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_remainder("doc_id", 3) != 1)
        field = toxicity.learn(docs, labels)
        return _judged(docs, lambda rows: toxicity.score_toxicity(rows, field, carry=("row", "text")), F.col("score") < TOXIC)


def drop_other_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scope(spark, "pipeline"):
        model = language_id.learn(docs.where(crc_remainder("doc_id", 4) != 2))
        known = (F.col("lang_pred") != language_id.UNDETERMINED) & ((F.col("bits") < FAR_BITS) | (F.length("text") < FAR_LENGTH))
        return _judged(docs, lambda rows: language_id.identify(rows, model, carry=("row", "text")), known)


def _without(docs: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """``docs`` without the rows whose ``by`` is among ``keys``; those are broadcast only after a count."""
    keys = cut(keys.select(by).where(F.col(by).isNotNull()).distinct(), "dropped")
    return docs.join(F.broadcast(keys) if keys.count() * 16 < BROADCAST_BYTES else keys, by, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scope(spark, "pipeline"):
        found = cut(near_duplicates(docs, Similarity(words=5, percent=80)), "classes")
        kept = _without(docs, found.where("NOT kept"), "doc_id").select(*docs.columns)
        again = cut(found.where("kept AND n_shingles > 0").groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
        if again.isEmpty():
            return kept
        return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scope(spark, "pipeline"):
        benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        row = F.xxhash64("doc_id", "text")
        bad = contamination(docs.select(row.alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("__row"))
        return _without(docs.withColumn("__row", row), bad, "__row").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scope(spark, "pipeline"):
        encoded = pieces.encode(docs.select("doc_id", "text"), pieces.Vocabulary.load(vocabulary_path()))
        return encoded.select("doc_id", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_other_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", tokenise),
]

#: Forward-backward, automata and Viterbi are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of what is left of ``documents``: doc_id, n_tokens, tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
