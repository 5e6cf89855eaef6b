"""Entries of chronologies whose dates may be split by line breaks and go on from the entry before.

Pages are put in runs: a run ends where the year changes, a page is missing or a page
belongs to no year.  Dates that refer to the one before them (the same day, the next
day, this month) are resolved along a run and never beyond it, so what is carried is at
most one year of one book.  The texts of pages are never sorted: a page's place in its run
comes from counts of its labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import dates
from evidencelake.functions import text as T
from evidencelake.operators.lineage import cut

#: Labels that begin a line, lines of footnotes, and headings of pages.
_DIGIT = r"\d(?:[ \t\n]*\d)?"
_TAIL = rf"(?:{_DIGIT}\s*月\s*)?{_DIGIT}\s*日"
LABEL = (
    r"(?m)^[ \t\x{3000}]*("
    rf"{_DIGIT}\s*月\s*{_DIGIT}\s*日(?:\s*[—－–~～至一、,，]\s*{_TAIL})*(?:前后|左右|前|后)?"
    rf"|{_DIGIT}\s*月\s*(?:中下旬|上旬|中旬|下旬|月初|初|末|底)"
    rf"|{_DIGIT}\s*月(?=[ \t\x{{3000}}\n])"
    r"|同日|翌日|次日|当日|本月|是月|本年|是年|[春夏秋冬](?=[ \t\n]))"
)
FOOTNOTE = r"^[ \t]*[〔\[（(【C]\s*[\dlI]{1,2}\s*[〕\]）)】Jj}]"
YEAR_HEADING = r"\A\s*(?:[\dlIO][\s.]*){4}年[ \t]*(?:\n[ \t]*)?(?:[一二三四五六七八九十百〇零\d\s]{1,15}岁|(?:\d\s*){1,2}月(?=[ \t]*\n))?"
NUMBER = r"\A\d{1,4}[ \t]*\n"
SAME_DAY, NEXT_DAY, SAME_MONTH, SAME_YEAR = ("同日", "当日"), ("翌日", "次日"), ("本月", "是月"), ("本年", "是年")

_STRIP = r"^\s+|\s+$"


def bodies(pages: DataFrame) -> DataFrame:
    """``pages`` with their text without its number, its heading and its footnotes, and noted (whether footnotes were cut); each step is worked out once."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _STRIP, ""), NUMBER, ""), YEAR_HEADING, "")
    lines = F.split(F.regexp_replace(F.regexp_replace(plain, r"\A\s+", ""), NUMBER, ""), "\r\n|\r|\n", -1)
    first = F.array_min(F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(FOOTNOTE), i))))
    kept = F.transform(F.slice("lines", F.lit(1), F.coalesce("first", F.size("lines"))), lambda x: F.regexp_replace(x, _STRIP, ""))
    return pages.withColumn("lines", lines).withColumn("first", first).withColumn("text", F.regexp_replace(F.array_join(kept, "\n"), _STRIP, "")).withColumn("noted", F.col("first").isNotNull()).drop("lines", "first")


def runs(pages: DataFrame, years: DataFrame) -> DataFrame:
    """``pages`` that have a year, with year, run and gap (whether a page is missing behind this one); all their columns are sorted."""
    by_page = Window.partitionBy("document_id").orderBy("pdf_page")
    dated = pages.hint("merge").join(years.select("document_id", "pdf_page", "year"), ["document_id", "pdf_page"], "left")
    begins = ~(F.col("year").eqNullSafe(F.lag("year").over(by_page)) & F.coalesce(F.col("pdf_page") == F.lag("pdf_page").over(by_page) + 1, F.lit(False)))
    gap = F.coalesce(F.lead("pdf_page").over(by_page) != F.col("pdf_page") + 1, F.lit(False))
    marked = dated.select("*", begins.cast("int").alias("begins"), gap.alias("gap"))
    return marked.withColumn("run", F.sum("begins").over(by_page)).where("year IS NOT NULL").drop("begins")


def _point(value: Column, precision: Column, certainty: str) -> Column:
    return F.struct(value.alias("value"), precision.alias("precision"), F.lit(certainty).alias("certainty"))


def resolved(labels: DataFrame) -> DataFrame:
    """document_id, run, n and date of ``labels`` (document_id, run, n, label, year), carried along a run.

    The same day has the date before it, the next day the day after it if that is one day,
    this month and this year what they say; without a date to go on from they
    have the run's year.  Only labels and dates are gathered, a run at a time.
    """
    word = T.compact("label")
    kind = F.when(word.isin(*SAME_DAY), "day").when(word.isin(*NEXT_DAY), "next").when(word.isin(*SAME_MONTH), "month").when(word.isin(*SAME_YEAR), "year").otherwise("own")
    read = labels.withColumn("kind", kind).withColumn("own", dates.parsed(F.when(F.col("kind") == "own", F.col("label")), F.col("year")))
    year = F.lpad(F.col("year").cast("string"), 4, "0")
    no_end = F.lit(None).cast(dates.DATE["end"].dataType)
    typed = lambda start, end, flags: F.struct(start.alias("start"), end.alias("end"), flags.alias("flags")).cast(dates.DATE)
    whole = lambda *flags: typed(_point(year, F.lit("year"), "inferred"), no_end, F.array(*map(F.lit, flags)).cast("array<string>"))
    known = F.when(F.col("own.start.value").isNull(), whole("unknown_date")).otherwise(F.col("own"))
    steps = read.select("document_id", "run", "n", "kind", F.when(F.col("kind") == "own", known).when(F.col("kind") == "year", whole()).otherwise(whole("inherited_date", "year_only_fallback")).alias("own"))
    gathered = steps.groupBy("document_id", "run").agg(F.array_sort(F.collect_list(F.struct("n", "kind", "own"))).alias("steps"))

    inherited = F.array(F.lit("inherited_date"))

    def carried(before: Column, step: Column) -> Column:
        start, end = before["start"], before["end"]
        again = lambda p: F.when(p.isNotNull(), _point(p["value"], p["precision"], "inferred"))
        month = F.left(start["value"], F.lit(7))
        following = F.date_format(F.date_add(F.try_to_date(start["value"], "yyyy-MM-dd"), 1), "yyyy-MM-dd")
        one_day = (start["precision"] == "day") & end.isNull()
        lost = typed(step["own"]["start"], no_end, F.array(*map(F.lit, ("inherited_date", "year_only_fallback", "relative_date_unresolved"))))
        return (
            F.when(step["kind"].isin("own", "year"), step["own"])
            .when((step["kind"] == "next") & (before.isNull() | ~one_day), lost)
            .when(before.isNull(), step["own"])
            .when(step["kind"] == "day", typed(again(start), again(end), inherited))
            .when(step["kind"] == "next", typed(_point(following, F.lit("day"), "inferred"), no_end, inherited))
            .otherwise(typed(_point(month, F.when(F.length(month) == 7, "month").otherwise("year"), "inferred"), no_end, inherited))
        )

    none = F.lit(None).cast(dates.DATE)
    nothing = F.array().cast(f"array<{dates.DATE.simpleString()}>")
    fold = F.aggregate("steps", nothing, lambda done, step: F.concat(done, F.array(carried(F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(none), step))))
    folded = gathered.select("document_id", "run", F.explode(F.arrays_zip(F.col("steps.n").alias("n"), fold.alias("date"))).alias("s"))
    return folded.select("document_id", "run", "s.n", "s.date")


def split_date_entries(pages: DataFrame, years: DataFrame) -> DataFrame:
    """Entries of ``pages`` (document_id, pdf_page, text, method): document_id, entry, label, date, text, pages, methods, flags.

    ``years`` has document_id, pdf_page and year of the pages that belong to a year, one
    each; others end what came before and have no entries.  An entry begins with its
    label, which stays in its text, and takes what precedes the first label of the next
    pages of its run.  flags are footnotes_excluded, if a page it is on had any, and page_gap, if
    it ends where a page is missing.  A null text is empty.
    """
    marked = F.split(F.regexp_replace("text", LABEL, "\x01$1\x02"), "\x01", -1)
    # texts are cut into pieces once; what says where they go, labels with it, is a small part of them
    split = cut(bodies(pages.select("document_id", "pdf_page", "method", "text")).select("document_id", "pdf_page", "method", marked.alias("pieces"), "noted"))
    told = F.transform(F.slice("pieces", F.lit(2), F.size("pieces")), lambda p: F.substring_index(p, "\x02", 1))
    along = Window.partitionBy("document_id", "run").orderBy("pdf_page")
    counts = runs(split.select("document_id", "pdf_page", told.alias("told")), years).withColumn("labels", F.size("told"))
    placed = cut(counts.select("document_id", "pdf_page", "run", "year", "told", "labels", (F.sum("labels").over(along) - F.col("labels")).alias("before"), (F.lead("pdf_page").over(along).isNull() & F.col("gap")).alias("cut")))
    each = split.hint("merge").join(placed.drop("year", "told"), ["document_id", "pdf_page"]).select("document_id", "run", "pdf_page", "method", "noted", "cut", "before", "labels", F.posexplode("pieces").alias("at", "piece"))
    named = each.withColumn("n", F.col("before") + F.col("at")).where("n > 0")
    label = F.when(F.col("at") > 0, F.substring_index("piece", "\x02", 1))
    rest = F.regexp_replace(F.when(F.col("at") > 0, F.substring_index("piece", "\x02", -1)).otherwise(F.col("piece")), _STRIP, "")
    part = named.select("document_id", "run", "n", "pdf_page", "method", "noted", label.alias("label"), rest.alias("rest"), (F.col("cut") & (F.col("at") == F.col("labels"))).alias("cut"), (F.col("at") > 0).alias("begins"))
    said = (F.col("rest") != "") | F.col("begins")
    grouped = part.groupBy("document_id", "run", "n").agg(
        F.max("label").alias("label"),
        F.array_sort(F.collect_list(F.struct("pdf_page", "rest"))).alias("parts"),
        F.array_sort(F.collect_set(F.when(said, F.col("pdf_page")))).alias("pages"),
        F.array_sort(F.collect_set(F.when(said, F.col("method")))).alias("methods"),
        F.array_compact(F.array(F.when(F.max("noted"), "footnotes_excluded"), F.when(F.max("cut"), "page_gap"))).alias("flags"),
    )
    whole = F.array_join(F.filter(F.concat(F.array("label"), F.transform("parts", lambda p: p["rest"])), lambda x: x != ""), "\n")
    entries = grouped.select("document_id", "run", "n", "label", whole.alias("text"), "pages", "methods", "flags")
    labels = placed.select("document_id", "run", "year", "before", F.posexplode("told").alias("at", "label")).select("document_id", "run", (F.col("before") + F.col("at") + 1).alias("n"), "label", "year")
    number = resolved(labels).select("document_id", "run", "n", "date", F.row_number().over(Window.partitionBy("document_id").orderBy("run", "n")).alias("entry"))
    return entries.hint("merge").join(number, ["document_id", "run", "n"]).select("document_id", "entry", "label", "date", "text", "pages", "methods", "flags")
