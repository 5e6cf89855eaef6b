"""Questions: intent, people, years, expansion and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text as T

#: Stop terms and edge characters of queries, and the years of named periods.
STOP = ("哪些", "什么", "怎么", "如何", "主要", "有哪", "都有", "请问", "一下", "这个", "那个", "是否", "可以", "人物", "经历", "观点", "情况", "交集", "期间")
EDGES = "的了在和与及是有为于把被从对"
PERIODS = (("长征", 1934, 1936), ("抗日战争", 1937, 1945), ("全面抗战", 1937, 1945), ("解放战争", 1945, 1949), ("抗美援朝", 1950, 1953), ("大跃进", 1958, 1960), ("文化大革命", 1966, 1976), ("文革", 1966, 1976))
YEAR_RANGE = r"(?<![0-9])(?:18|19|20)[0-9]{2}年?\s*(?:至|到|—|–|-|~|～)\s*(?:18|19|20)[0-9]{2}年?(?![0-9])"


def terms(question: Column | str) -> Column:
    """The tokens a question searches for."""
    return T.query_tokens(question, STOP, EDGES)


def intent(question: Column, rules: list[tuple[str, str]], default: str = "general") -> Column:
    """The name of the first of ``rules`` (name, pattern) that a question matches."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(question.rlike(pattern), name).otherwise(out)
    return out


def has_range(question: Column) -> Column:
    return question.rlike(YEAR_RANGE)


def year_range(question: Column) -> Column:
    """[first, last] of the years a question names, else of the periods it names, else null."""
    years = T.years(question)
    named = F.array_compact(F.array(*(F.when(F.contains(question, F.lit(p)), F.array(F.lit(a), F.lit(b))) for p, a, b in PERIODS)))
    inside = F.flatten(named)
    return F.when(F.size(years) > 0, F.array(F.array_min(years), F.array_max(years))).when(F.size(inside) > 0, F.array(F.array_min(inside), F.array_max(inside)))


def filtered_people(people: Column, intent_: Column) -> Column:
    """People that a hit must name: none where the question asks for views."""
    return F.when(intent_.isin("viewpoint", "observation"), F.array().cast("array<string>")).otherwise(people)


def expanded(question: Column, hints: list[tuple[str, str]]) -> Column:
    """A question with the hint words of every marker (pattern, words) in it."""
    added = [F.when(question.rlike(pattern), F.lit(words)) for pattern, words in hints]
    return F.concat_ws(" ", question, *added)


def needs_context(question: Column, phrases: list[str]) -> Column:
    """Whether a question can only be read with what came before it."""
    return question.rlike("|".join(phrases))


def coverage(requested: Column, span: Column, timeline: Column) -> Column:
    """The coverage that holds: items of a timeline over five years or more are balanced instead."""
    return F.when((requested == "per_item") & timeline & (span >= 5), "balanced").otherwise(requested)


def sub_ranges(low: int, high: int, mode: str, most: int = 8) -> list[tuple[int, int]]:
    """Year ranges to ask for one by one: up to ``most`` single years, evenly spaced, or three spans."""
    n = high - low + 1
    if mode == "per_year":
        picks = range(n) if n <= most else sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})
        return [(low + i, low + i) for i in picks]
    if n < 3:
        return [(low, high)]
    cuts = [low + n * i // 3 for i in range(4)]
    return [(a, b - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def distinct_in_order(rows: DataFrame, group: str, value: str, order: str, most: int) -> DataFrame:
    """The first ``most`` distinct values of each group in the order they first come."""
    from pyspark.sql import Window

    once = rows.groupBy(group, value).agg(F.min(order).alias(order))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, value))).where(F.col("place") <= most)


#: References to the time or people of an earlier question, questions that need more than one look, and aspects that say nothing.
EARLIER_TIME = r"那年|当年|这一年|同年|次年|翌年|当时|同期|这一时期|那个时期|这段时期"
EARLIER_ENTITY = (
    r"(?:^|[，,。！？?!；;\s])(?:他|她|他们|她们|它|其)(?:的|在|于|后来|当时|又|还|曾|是否|如何|为何|为什么|做|说|提出|经历|观点)"
    r"|这位|那位|这个人|那个人|两人|双方|前者|后者|上述人物|这场|那场|该战役|这次|那次|这件事|那件事"
)
COMPLEX = r"详细|全面|系统|完整|经过|过程|前后|各阶段|主要经历|梳理|演变|变化|原因|影响|意义|比较|异同"
WIDE = ("event_overview", "comparison", "causal_analysis")
VAGUE = ("更多", "更多证据", "其他", "其余", "全部", "完整资料", "相关资料")


def guarded(plans: DataFrame, phrases: list[str]) -> DataFrame:
    """Plans without what only the history of a conversation says.

    plans has question, previous (the user's last question before, or null),
    normalized, start_year, end_year, entities (of text and canonical), queries,
    constraints and coverage.  Years hold if the question names them, or the previous
    one where the question refers to its time; entities likewise.  Queries and
    constraints with words of what was left out go too.  ``phrases`` tell a question,
    or an entity's text, that leans on its context.
    """
    key = lambda c: F.lower(T.compact(c))
    asked, previous = F.col("question"), F.coalesce("previous", F.lit(""))
    leans = F.col("previous").isNotNull() & needs_context(asked, phrases)
    own, earlier = year_range(asked), F.when(leans & asked.rlike(EARLIER_TIME), year_range(previous))
    rows = plans.withColumn("__years", F.coalesce(own, earlier)).withColumn("__look_back", leans & asked.rlike(EARLIER_ENTITY))

    def held(e: Column) -> Column:
        now = F.contains(key(asked), key(e["canonical"])) | (F.contains(key(asked), key(e["text"])) & ~needs_context(e["text"], phrases))
        before = F.contains(key(previous), key(e["text"])) | F.contains(key(previous), key(e["canonical"]))
        return now | (F.col("__look_back") & before)

    gone = F.flatten(F.transform(F.filter("entities", lambda e: ~held(e)), lambda e: F.array(e["text"], e["canonical"])))
    planned = F.array_compact(F.array("start_year", "end_year"))
    wrong = F.when(F.col("__years").isNull(), planned).otherwise(F.array_except(planned, F.col("__years")))
    banned = F.filter(F.concat(F.transform(wrong, lambda y: y.cast("string")), gone), lambda w: F.length(F.trim(w)) >= 2)
    rows = rows.withColumn("__banned", banned)
    clean = lambda c: ~F.exists("__banned", lambda w: F.contains(c, w))
    start, end = F.get("__years", F.lit(0)), F.get("__years", F.lit(1))
    return rows.withColumns(
        {
            "normalized": F.when(clean(F.col("normalized")), F.col("normalized")).otherwise(asked),
            "queries": F.filter("queries", clean),
            "constraints": F.filter("constraints", clean),
            "entities": F.filter("entities", held),
            "coverage": F.when(F.col("__years").isNull() & F.col("coverage").isin("per_year", "balanced_period"), "relevance").otherwise(F.col("coverage")),
            "start_year": start,
            "end_year": end,
        }
    ).drop("__years", "__look_back", "__banned")


def plan_error(start: Column, end: Column, unclear: Column, clarification: Column) -> Column:
    """What is wrong with a plan: incomplete_year_range, reversed_year_range, missing_clarification_question or null."""
    return (
        F.when(start.isNull() != end.isNull(), "incomplete_year_range")
        .when(start > end, "reversed_year_range")
        .when(unclear & (F.trim(F.coalesce(clarification, F.lit(""))) == ""), "missing_clarification_question")
    )


def reflects(question: Column, intent_: Column, coverage_: Column) -> Column:
    """Whether a question deserves a second look at its evidence."""
    return (coverage_ != "relevance") | intent_.isin(*WIDE) | question.rlike(COMPLEX)


def followups(question: Column, entities: Column, normalized: Column, constraints: Column, aspects: Column, most: int) -> Column:
    """Up to ``most`` further queries for missing aspects, in order and once each.

    Years that the question doesn't name are taken out of an aspect; aspects that are
    vague or of one character are left out.  ``entities`` are names.
    """
    spaced = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    named = F.trim(F.array_join(F.array_distinct(entities), " "))
    subject = F.when(named == "", normalized).otherwise(named)

    def cleaned(aspect: Column) -> Column:
        bare = F.regexp_replace(spaced(aspect), "^[，,。；;：:、\\- ]+|[，,。；;：:、\\- ]+$", "")
        foreign = F.array_except(T.years(bare), T.years(question))
        return spaced(F.aggregate(foreign, bare, lambda s, y: F.regexp_replace(s, F.concat(F.lit(r"(?<![0-9])"), y.cast("string"), F.lit(r"(?![0-9])\s*年?")), F.lit(""))))

    good = F.filter(F.transform(aspects, cleaned), lambda a: (F.length(a) >= 2) & ~a.isin(*VAGUE))
    rest = F.trim(F.array_join(constraints, " "))
    asked = F.transform(good, lambda a: F.array_join(F.filter(F.array(subject, a, rest), lambda w: w != ""), " "))
    return F.slice(F.filter(F.array_distinct(asked), lambda q: q != question), 1, most)
