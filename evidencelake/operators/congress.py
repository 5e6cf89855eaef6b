"""Questions on numbered congresses: their ordinals, the best hit of each, and hits put in front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordinals, a congress by its short name, a range of two, words of a congress that meets, and the surest source.
ORDINALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十")
SHORT = "中共(?:第)?([一二三四五六七八九十]{1,3})大"
RANGE = SHORT + r"\s*(?:至|到|—|–|-|~|～)\s*" + SHORT
MEETS, OFFICIAL = ("召开", "举行"), "official_history"


def ordinals(question: Column) -> Column:
    """The ordinals that a question names, each once: those of ranges first, in their direction, then short names in order."""
    names = F.array(*map(F.lit, ORDINALS))
    number = lambda group: F.transform(F.regexp_extract_all(question, F.lit(RANGE), F.lit(group)), lambda o: F.array_position(names, o).cast("int"))
    ends = F.filter(F.arrays_zip(number(1).alias("a"), number(2).alias("b")), lambda r: (r["a"] > 0) & (r["b"] > 0))
    ranges = F.flatten(F.transform(ends, lambda r: F.transform(F.sequence(r["a"], r["b"]), lambda i: F.element_at(names, i))))
    return F.array_distinct(F.concat(ranges, F.regexp_extract_all(question, F.lit(SHORT), F.lit(1))))


def best_hits(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """question, ordinal and chunk_id of the best hit of each ordinal asked for; ordinals without a hit are left out.

    hits has question, rank, chunk_id, section, text and source_type; asked has question and ordinals.  A
    hit names the congress in its section or its text; those with the name in the section are
    better, then in the text, then where it meets, then in an official history, then of a lower rank.
    """
    each = asked.select("question", F.explode("ordinals").alias("ordinal"))
    marker = F.concat(F.lit("第"), F.col("ordinal"), F.lit("次全国代表大会"))
    met = hits.join(each, "question").withColumn("heading", F.contains("section", marker)).withColumn("body", F.contains("text", marker)).where("heading OR body")
    order = F.struct("heading", "body", F.col("text").rlike("|".join(MEETS)), F.col("source_type") == OFFICIAL, -F.col("rank"))
    return met.groupBy("question", "ordinal").agg(F.max_by("chunk_id", order).alias("chunk_id"))


def prepended(front: DataFrame, hits: DataFrame) -> DataFrame:
    """question, chunk_id and a new rank: ``front`` first, then ``hits`` (question, chunk_id, rank), each chunk once."""
    both = front.select("question", "chunk_id", "rank", F.lit(0).alias("part")).unionByName(hits.select("question", "chunk_id", "rank", F.lit(1).alias("part")))
    once = both.groupBy("question", "chunk_id").agg(F.min(F.struct("part", "rank")).alias("at"))
    return once.select("question", "chunk_id", F.row_number().over(Window.partitionBy("question").orderBy("at", "chunk_id")).alias("rank"))


def branch_mode(keyword: Column, vector: Column) -> Column:
    """What a search runs as, by whether its branches are available: hybrid, one of them only, or an error."""
    return F.when(keyword & vector, "hybrid").when(keyword, "keyword_only").when(vector, "vector_only").otherwise("error")
