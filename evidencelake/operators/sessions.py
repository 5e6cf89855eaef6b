"""Conversation history: retention, recent messages and prompt budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages kept and shown, and the budget of characters.
KEPT, SHOWN, CHARACTERS = 200, 12, 12_000


def sanitised(content: Column) -> Column:
    """Evidence marks replaced, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(content, r"\[E[0-9]+\]", "[历史引用]"), r"(?U)\s+", " "))


def retained(messages: DataFrame, session: str, order: str, most: int = KEPT) -> DataFrame:
    """The newest ``most`` messages of each session."""
    newest = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.withColumn("__n", newest).where(F.col("__n") <= most).drop("__n")


def latest(messages: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last ``n`` messages of each session with place, in ascending order."""
    return retained(messages, session, order, n).withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def prompt_messages(messages: DataFrame, session: str, order: str, content: str, most: int = SHOWN, characters: int = CHARACTERS) -> DataFrame:
    """The newest messages that fit a count and a budget of characters; the one at the budget's edge is shortened to kept characters."""
    back = Window.partitionBy(session).orderBy(F.desc(order))
    used = F.coalesce(F.sum(F.length(content)).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = messages.where(F.length(F.trim(content)) > 0).withColumn("__n", F.row_number().over(back)).withColumn("__used", used)
    return placed.where((F.col("__n") <= most) & (F.col("__used") < characters)).withColumn("kept", F.least(F.length(content), characters - F.col("__used")).cast("long")).drop("__n", "__used")
