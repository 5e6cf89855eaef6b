"""Quotes and excerpts of hits, extractive answers, salvage, years of timelines and batches of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators.enrichment import MARK

#: What ends a sentence, what stands for text left out, and lengths of quotes and excerpts.
ENDS, GAP = "。！？；", "……"
QUOTE, BEFORE, DATE_BEFORE, PAIR_BEFORE = 420, 180, 40, 110
EXCERPT, EXCERPT_BEFORE = 560, 140
SUMMARY, SENTENCE, SHOWN, BATCH, CANDIDATES = 180, 12, 5, 12, 36
#: Patterns of dates, of a month cut from its day, and of the years in titles.
MONTH_DAY = r"(?:(?:18|19|20)\d{2}\s*年\s*)?\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?"
CUT_MONTH = r"^(……)?\s*\d{1,2}\s*月(?!\s*(?:\d{1,2}\s*日|上旬|中旬|下旬))\s*"
TIMELINE_DATE = r"(?:((?:18|19|20)\d{2})\s*年\s*)?(1[0-2]|0?[1-9])\s*月(?:\s*(3[01]|[12]\d|0?[1-9])\s*日)?"
ANSWER_YEAR = r"(?<!\d)((?:18|19|20)\d{2})年"
HEADING = r"^\s{0,3}#{1,6}\s+"
TITLE_YEARS = r"(?<!\d)((?:18|19|20)\d{2})(?:\.\d{1,2})?\s*(?:—|–|-|至|~)\s*((?:18|19|20)\d{2})(?:\.\d{1,2})?(?!\d)"
#: First lines of extractive answers by intent, and the answer without evidence.
LEADS = {
    "timeline": "根据当前本地资料，可先按以下史料线索梳理：",
    "intersection": "根据当前本地资料，检索到以下涉及两位人物的史料线索，可据原文核查具体交集：",
    "viewpoint": "根据当前本地资料，相关观点主要见于以下原文：",
}
LEAD = "根据当前本地资料，检索到以下可核验线索："
NOTHING = "现有本地资料中没有检索到足以回答这个问题的证据。"


def squeezed(text: Column | str) -> Column:
    """One space for any white space, none at the ends."""
    return F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)\s+", " "))


def _literal(word: Column) -> Column:
    return F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))


def _places(text: Column, word: Column) -> Column:
    """Offsets, from 0, at which ``word`` stands in a text, without overlaps."""
    gaps = F.transform(F.split(text, _literal(word), -1), lambda p: F.length(p))
    none = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at"))
    met = F.aggregate(gaps, none, lambda s, n: F.struct(F.concat(s["found"], F.array(s["at"] + n)).alias("found"), (s["at"] + n + F.length(word)).alias("at")))["found"]
    # the last piece has no word behind it
    return F.slice(met, F.lit(1), F.size(met) - 1)


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def quotes(hits: DataFrame, text: str, people: str, terms: str, limit: int = QUOTE, ends: str = ENDS) -> DataFrame:
    """``hits`` with ``quote``: at most ``limit`` characters of the text around what was asked for.

    One person: the text begins with the sentence that names them first.  Two: around
    the closest mentions of both.  Else around the first person or term of two
    characters or more.  Quotes begin behind the end of a sentence or at a date where one
    is near.  A null text has a null quote; null or empty names count as none.
    """
    names = F.filter(F.array_distinct(F.coalesce(F.col(people), F.array().cast("array<string>"))), lambda p: p.isNotNull() & (p != ""))
    last = lambda part: F.length(F.regexp_extract(part, f"(?s)^.*[{ends}]", 0))
    tidy = lambda q: F.regexp_replace(q, CUT_MONTH, "$1")
    rows = hits.withColumn("__names", names).withColumn("__t", squeezed(text))

    at = F.when(F.size("__names") == 1, F.instr(F.col("__t"), F.get("__names", F.lit(0))) - 1).otherwise(0)
    since = F.greatest(F.col("__at") - BEFORE, F.lit(0))
    behind = F.when(F.col("__at") > 0, last(_part(F.col("__t"), since, F.col("__at")))).otherwise(0)
    rows = rows.withColumn("__at", at).withColumn("__cut", behind)
    rows = rows.withColumn("__t", F.when(F.col("__cut") > 0, F.concat(F.lit(GAP), F.substring(F.col("__t"), since + F.col("__cut") + 1, F.length("__t")))).otherwise(F.col("__t")))

    t, n = F.col("__t"), F.length("__t")
    mention = lambda p: F.transform(_places(t, p), lambda s: F.struct(s.alias("start"), (s + F.length(p)).alias("end"), p.alias("name")))
    rows = rows.withColumn("__m", F.array_sort(F.flatten(F.transform("__names", mention))))
    words = F.filter(F.transform(F.filter(F.coalesce(F.col(terms), F.array().cast("array<string>")), lambda w: F.length(w) >= 2), lambda w: F.instr(t, w) - 1), lambda i: i >= 0)
    rows = rows.withColumn("__centre", F.coalesce(F.get("__m", F.lit(0))["start"], F.array_min(words), F.lit(0)))
    m = F.col("__m")
    next_to = F.zip_with(F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))), F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))), lambda x, y: F.struct((y["end"] - x["start"]).alias("width"), x["start"].alias("start"), y["end"].alias("end"), (x["name"] != y["name"]).alias("both")))
    rows = rows.withColumn("__pair", F.when(F.size("__names") == 2, F.array_min(F.filter(next_to, lambda p: p["both"] & (p["width"] <= limit)))))

    pair, centre = F.col("__pair"), F.col("__centre")
    opens = F.greatest(F.lit(0), pair["end"] - limit, F.least(pair["start"] - PAIR_BEFORE, n - limit))
    near = F.greatest(centre - BEFORE, F.lit(0))
    dated = F.split(F.regexp_replace(_part(t, F.greatest(near - DATE_BEFORE, F.lit(0)), centre), f"({MONTH_DAY})", "\x01$1"), "\x01", -1)
    rows = rows.withColumn("__open", F.when(pair.isNotNull(), opens).otherwise(near))
    ended = F.when(pair.isNotNull(), F.length(F.regexp_extract(_part(t, F.col("__open"), pair["start"]), f"(?s)^[^{ends}]*[{ends}]", 0))).otherwise(last(_part(t, F.col("__open"), centre)))
    rows = rows.withColumn("__end", ended).withColumn("__dated", dated)
    by_date = F.when(F.size("__dated") > 1, centre - F.length(F.element_at("__dated", -1)))
    start = F.when((F.col("__end") > 0) | pair.isNotNull(), F.col("__open") + F.col("__end")).otherwise(F.coalesce(by_date, F.col("__open")))
    rows = rows.withColumn("__start", start)
    s = F.col("__start")
    window = F.concat(F.when(s > 0, GAP).otherwise(""), F.substring(t, s + 1, F.lit(limit)), F.when(s + limit < n, GAP).otherwise(""))
    quote = tidy(F.when(n <= limit, t).otherwise(window))
    return rows.withColumn("quote", quote).drop("__names", "__t", "__at", "__cut", "__m", "__centre", "__pair", "__open", "__end", "__dated", "__start")


def excerpt(text: Column, person: Column, limit: int = EXCERPT) -> Column:
    """At most ``limit`` characters of a text, from shortly before a person's first mention."""
    t = squeezed(text)
    start = F.greatest(F.coalesce(F.instr(t, person), F.lit(0)) - 1 - EXCERPT_BEFORE, F.lit(0))
    window = F.concat(F.when(start > 0, GAP).otherwise(""), F.substring(t, start + 1, F.lit(limit)), F.when(start + limit < F.length(t), GAP).otherwise(""))
    return F.when(F.length(t) <= limit, t).otherwise(window)


def extractive(questions: DataFrame, citations: DataFrame, ends: str = ENDS) -> DataFrame:
    """answer_id and answer of questions (answer_id, intent) from their first citations (answer_id, number, quote, years)."""
    pieces = F.filter(F.split("quote", f"(?<=[{ends}])"), lambda p: F.length(F.regexp_replace(F.trim(F.replace(p, F.lit("…"), F.lit(""))), "^。+|。+$", "")) >= SENTENCE)
    first = F.regexp_replace(F.trim(F.substring(F.coalesce(F.trim(F.get(pieces, F.lit(0))), F.col("quote")), 1, SUMMARY)), r"^[…，、\s]+", "")
    dated = F.when((F.col("intent") == "timeline") & (F.size("years") > 0), F.concat(F.array_join(F.transform(F.slice("years", 1, 3), lambda y: y.cast("string")), "、"), F.lit("年："))).otherwise("")
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("number"))
    shown = citations.withColumn("__place", place).where(F.col("__place") <= SHOWN).join(questions, "answer_id")
    lines = shown.select("answer_id", F.struct("number", F.concat(F.lit("- "), dated, first, F.lit(" [E"), F.col("number").cast("string"), F.lit("]")).alias("line")).alias("item"))
    listed = lines.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda i: i["line"]), "\n").alias("lines"))
    lead = F.lit(LEAD)
    for intent, words in LEADS.items():
        lead = F.when(F.col("intent") == intent, words).otherwise(lead)
    return questions.join(listed, "answer_id", "left").select("answer_id", F.when(F.col("lines").isNull(), NOTHING).otherwise(F.concat(lead, F.lit("\n\n"), F.col("lines"))).alias("answer"))


def salvaged(answer: Column) -> Column:
    """An answer without its lines that need a mark of evidence and have none; null if none is such or nothing is left.

    Headings and lines under twelve characters need no mark.
    """
    lines = F.split(answer, "\n", -1)
    kept = F.filter(lines, lambda x: x.rlike(MARK) | x.rlike(r"^\s*#") | (F.length(F.trim(x)) < SENTENCE))
    left = F.regexp_replace(F.array_join(kept, "\n"), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")
    clean = F.regexp_replace(left, r"^\s+|\s+$", "")
    return F.when((F.size(kept) < F.size(lines)) & (clean != ""), clean)


def ambiguous_years(answers: DataFrame) -> DataFrame:
    """answer_id and ambiguous of answers (answer_id, question, answer).

    Only questions on several years can be: where a line with evidence stands under no
    year, or where dates between two headings go back.
    """
    years = T.years(F.col("question"))
    several = F.coalesce(F.array_min(years) != F.array_max(years), F.lit(False))
    lines = answers.where(several).select("answer_id", F.posexplode(F.split("answer", "\r\n|\r|\n", -1)).alias("line", "text")).withColumn("text", F.trim("text"))
    heading, evidence = F.col("text").rlike(HEADING), F.contains("text", F.lit("[E"))
    own = F.regexp_extract("text", ANSWER_YEAR, 1)
    marked = lines.where(heading | evidence).withColumn("heading", heading).withColumn("own", F.when(own != "", own.cast("int")))
    part = Window.partitionBy("answer_id").orderBy("line")
    marked = marked.withColumn("part", F.sum(F.col("heading").cast("int")).over(part))
    groups = [F.regexp_extract_all("text", F.lit(TIMELINE_DATE), i) for i in (1, 2, 3)]
    number = lambda c: F.when(c != "", c.cast("int"))
    dates = F.transform(F.arrays_zip(*(g.alias(k) for g, k in zip(groups, "ymd", strict=True))), lambda d: F.struct(number(d["y"]).alias("y"), number(d["m"]).alias("m"), number(d["d"]).alias("d")))
    nothing = F.lit(None).cast("int")
    entered = F.array(F.struct(F.when(F.col("heading"), F.col("own")).alias("y"), nothing.alias("m"), nothing.alias("d")))
    tokens = marked.select("answer_id", "part", "line", "heading", "own", F.posexplode(F.when(F.col("heading"), entered).otherwise(F.concat(entered, dates))).alias("at", "date"))
    order = Window.partitionBy("answer_id", "part").orderBy("line", "at")
    held = tokens.withColumn("year", F.last("date.y", True).over(order))
    lost = ~F.col("heading") & (F.col("at") == 0) & F.col("own").isNull() & F.col("year").isNull()
    when = F.when(F.col("date.m").isNotNull() & F.col("year").isNotNull(), F.struct("year", F.col("date.m").alias("m"), F.coalesce("date.d", F.lit(0)).alias("d")))
    before = F.last("when", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = held.withColumn("lost", lost).withColumn("when", when).withColumn("back", F.coalesce(F.col("when") < before, F.lit(False)))
    flags = found.groupBy("answer_id").agg(F.max(F.col("lost") | F.col("back")).alias("ambiguous"))
    return answers.select("answer_id").join(flags, "answer_id", "left").select("answer_id", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def period_fits(title: Column, low: Column, high: Column) -> Column:
    """Whether the years in a title overlap those asked for; a title or question without years fits."""
    first, last = (F.regexp_extract(title, TITLE_YEARS, i).try_cast("int") for i in (1, 2))
    return F.coalesce((first <= high) & (low <= last), F.lit(True))


def batches(citations: DataFrame, size: int = BATCH) -> DataFrame:
    """Citations (answer_id, number) with batch and batches: so many at a time, in order."""
    group = Window.partitionBy("answer_id")
    place = F.row_number().over(group.orderBy("number"))
    dealt = citations.withColumn("batch", F.ceil(place / F.lit(size)))
    return dealt.withColumn("batches", F.max("batch").over(group))


def candidate_text(hits: DataFrame, person: str, most: int = CANDIDATES) -> DataFrame:
    """answer_id and block: the first hits of each question numbered, with title, page, years and excerpt."""
    listed = F.when(F.size("years") > 0, F.concat(F.lit("["), F.array_join(F.transform("years", lambda y: y.cast("string")), ", "), F.lit("]"))).otherwise("未标注")
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("rank"))
    top = hits.withColumn("__n", place).where(F.col("__n") <= most)
    head = F.concat(F.lit("[R"), F.col("__n").cast("string"), F.lit("] 文献：《"), F.col("title"), F.lit("》；PDF第"), F.col("page").cast("string"), F.lit("页；片段标注年份："), listed, F.lit("\n"), excerpt(F.col("text"), F.col(person)))
    return top.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", head.alias("block")))), lambda b: b["block"]), "\n\n").alias("block"))
