"""Which of many names stand in which texts, by look-up and not by trying every name on every text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a name by which it is looked up.
HEAD = 2


def found(texts: DataFrame, key: list[str], body: str, forms: DataFrame, form: str) -> DataFrame:
    """``key``, the columns of ``forms`` and at, the first place (from 1), for every text and name (the column ``form``) that it holds.

    A name meets the texts that have its first two characters next to each other, and is then sought
    in those.  ``key`` tells the texts apart; a text meets a name once.  Null or empty names and
    null texts meet nothing.
    """
    named = forms.where(F.length(form) > 0).withColumn("__head", F.left(F.col(form), F.lit(HEAD)))
    held = texts.where(F.col(body).isNotNull()).select(*key, F.col(body).alias("__body"))
    at = F.sequence(F.lit(1), F.greatest(F.length("__body"), F.lit(1)))
    parts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substring("__body", i, F.lit(1)), F.substring("__body", i, F.lit(HEAD))))))
    met = held.select(*key, F.explode(parts).alias("__head")).join(named.select("__head").distinct(), "__head", "left_semi").join(named, "__head").drop("__head")
    return met.join(held, key).withColumn("at", F.position(F.col(form), F.col("__body"))).where("at > 0").drop("__body").distinct()
