"""Cleaning, structure, chunks and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import names

#: Patterns of page numbers, headings, paragraph ends and dotted leaders; limits of chunks.
PAGE_NUMBER = r"^[\s—–-]*[0-9]{1,4}[\s—–-]*$"
HEADINGS = (
    r"^第[一二三四五六七八九十百零〇0-9]+[章节编部卷篇].{0,40}$",
    r"^(?:19|20)[0-9]{2}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?.{0,30}$",
    r"^(目录|前言|序言|引言|后记|附录|出版说明|编者说明)$",
)
PARAGRAPH_END = r"[。！？；：…）”』】]$"
DOT_LEADER = r"\.{5,}|…{5,}"
TARGET, MOST, TAIL, LEAST = 650, 900, 80, 20
DATE = r"((?:18|19|20)[0-9]{2})\s*年(?:\s*([0-9]{1,2})\s*月(?:\s*([0-9]{1,2})\s*日)?)?"
NUMERAL_YEAR = r"([〇○零一二三四五六七八九]{4})年"
NUMERALS, DIGITS = "〇○零一二三四五六七八九", "000123456789"
_LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def lines(c: Column | str) -> Column:
    """Stripped lines that are not blank."""
    text = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(text, _LINE_ENDS), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def marginal_lines(pages: DataFrame) -> DataFrame:
    """Lines that repeat at the margins of a document's ``pages`` (document_id, pdf_page, text): document_id, line, pages.

    The first and last two lines of a page count once each; short and numeric ones do not.
    """
    ends = lines("text")
    edge = F.array_distinct(F.concat(F.slice(ends, 1, 2), F.slice(ends, F.greatest(F.size(ends) - 1, F.lit(1)), 2)))
    each = pages.select("document_id", F.explode(edge).alias("line")).where(F.length("line").between(2, 50) & ~F.col("line").rlike(PAGE_NUMBER))
    counts = each.groupBy("document_id", "line").agg(F.count("*").alias("pages"))
    sizes = pages.groupBy("document_id").agg(F.greatest(F.lit(5), F.bround(F.count("*") * 0.04)).alias("least"))
    return counts.join(sizes, "document_id").where("pages >= least").select("document_id", "line", "pages")


def is_heading(line: Column) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in HEADINGS))


def is_contents_page(text: str) -> Column:
    """A table of contents: its word near the top, and three dotted leaders."""
    rows = lines(text)
    return F.contains(F.array_join(F.slice(rows, 1, 12), ""), F.lit("目录")) & (F.size(F.filter(rows, lambda x: x.rlike(DOT_LEADER))) >= 3)


def cleaned(text: Column, repeated: Column) -> Column:
    """Paragraphs of a page: repeated lines and page numbers go, wrapped lines are joined without a space."""
    tidy = F.transform(F.split(text, _LINE_ENDS), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\x{3000}]+", " "), r"(?U)^\s+|\s+$", ""))
    kept = F.filter(tidy, lambda x: ~F.coalesce(F.array_contains(repeated, x), F.lit(False)) & ~x.rlike(PAGE_NUMBER))
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("done"))
    flush = lambda done, paragraph: F.when(paragraph == "", done).otherwise(F.concat(done, paragraph, F.lit("\n")))

    def step(state: Column, line: Column) -> Column:
        joined = F.concat(state["open"], line)
        blank, heading, ends = line == "", is_heading(line), line.rlike(PARAGRAPH_END)
        return F.struct(
            F.when(blank | heading | ends, "").otherwise(joined).alias("open"),
            F.when(blank, flush(state["done"], state["open"])).when(heading, flush(flush(state["done"], state["open"]), line)).when(ends, flush(state["done"], joined)).otherwise(state["done"]).alias("done"),
        )

    return F.aggregate(kept, start, step, lambda s: F.regexp_replace(flush(s["done"], s["open"]), "\n$", ""))


def chunk_texts(text: Column, boundary: str = "(?<=[。！？；])", target: int = TARGET, most: int = MOST, tail: int = TAIL, least: int = LEAST) -> Column:
    """The chunks of a page: sentences packed up to ``most`` characters and closed from ``target`` on.

    A longer sentence is cut every ``most`` characters.  A last chunk under ``tail``
    joins the one before if it fits; chunks under ``least`` then go.
    """
    units = F.filter(F.flatten(F.transform(F.split(text, "\n"), lambda x: F.split(x, boundary))), lambda u: u != "")
    cuts = F.flatten(F.transform(units, lambda u: F.transform(F.sequence(F.lit(0), F.floor((F.length(u) - 1) / most).cast("int")), lambda i: F.substring(u, i * most + 1, F.lit(most)))))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, unit: Column) -> Column:
        fits = F.length(state["open"]) + F.length(unit) <= most
        grown = F.when(fits, F.concat(state["open"], unit)).otherwise(unit)
        done = F.when(fits | (state["open"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        full = F.length(grown) >= target
        return F.struct(F.when(full, "").otherwise(grown).alias("open"), F.when(full, F.concat(done, F.array(grown))).otherwise(done).alias("done"))

    def finish(state: Column) -> Column:
        last = F.element_at(state["done"], -1)
        joins = (F.length(state["open"]) < tail) & (F.size(state["done"]) > 0) & (F.length(last) + F.length(state["open"]) <= most)
        merged = F.concat(F.slice(state["done"], F.lit(1), F.size(state["done"]) - 1), F.array(F.concat(last, state["open"])))
        return F.when(state["open"] == "", state["done"]).when(F.size(state["done"]) == 0, F.array(state["open"])).when(joins, merged).otherwise(F.concat(state["done"], F.array(state["open"])))

    return F.filter(F.aggregate(cuts, start, step, finish), lambda c: F.length(F.trim(c)) >= least)


def chunks(pages: DataFrame, boundary: str = "(?<=[。！？；])") -> DataFrame:
    """Chunks of ``pages`` (document_id, pdf_page, text) with ids, positions and neighbours; none crosses a page."""
    each = pages.select("document_id", "pdf_page", F.posexplode(chunk_texts(F.col("text"), boundary)).alias("page_chunk_index", "text"))
    in_order = Window.partitionBy("document_id").orderBy("pdf_page", "page_chunk_index")
    made = each.withColumn("chunk_index", F.row_number().over(in_order) - 1).withColumn("content_hash", F.sha2("text", 256)).withColumn("chunk_id", T.stable_id("document_id", "pdf_page", "page_chunk_index", "content_hash", separator=":"))
    near = Window.partitionBy("document_id").orderBy("chunk_index")
    return made.withColumn("previous_chunk_id", F.lag("chunk_id").over(near)).withColumn("next_chunk_id", F.lead("chunk_id").over(near))


def dates(text: str) -> Column:
    """Distinct date mentions as partial ISO dates, numeral years among them, sorted."""
    col = F.col(text)
    found = F.zip_with(F.regexp_extract_all(col, F.lit(DATE), 1), F.zip_with(F.regexp_extract_all(col, F.lit(DATE), 2), F.regexp_extract_all(col, F.lit(DATE), 3), lambda m, d: F.struct(m.alias("m"), d.alias("d"))), lambda y, p: F.concat(y, F.when(p["m"] != "", F.concat(F.lit("-"), F.lpad(p["m"], 2, "0"))).otherwise(""), F.when(p["d"] != "", F.concat(F.lit("-"), F.lpad(p["d"], 2, "0"))).otherwise("")))
    numeral = F.transform(F.regexp_extract_all(col, F.lit(NUMERAL_YEAR), 1), lambda y: F.translate(y, NUMERALS, DIGITS))
    return F.array_sort(F.array_distinct(F.concat(found, F.filter(numeral, lambda y: y.rlike("^(18|19|20)")))))


def scope(years: Column, low: int, high: int) -> Column:
    """in_scope, out_of_scope, mixed, or unknown without a year."""
    inside = lambda y: y.between(low, high)
    return F.when(F.coalesce(F.size(years), F.lit(0)) <= 0, "unknown").when(F.forall(years, inside), "in_scope").when(F.exists(years, inside), "mixed").otherwise("out_of_scope")


def mentions(texts: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """``key`` and the sorted canonical names of which some form (form, name) occurs in the text; rows without one go.

    Forms are looked up by how they begin (see ``names.found``); no text meets all of them.
    """
    met = names.found(texts, [key], "text", forms.select("form", "name").distinct(), "form")
    return met.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names"))


def outline_ends(entries: DataFrame, last_page: DataFrame) -> DataFrame:
    """Outline ``entries`` (document_id, seq, level, page) with end_page: before the next entry of the same or a higher level, else the last page.

    The next entry is found per level with one window each, so that no entry meets all later ones.
    """
    levels = range(1, 7)
    after = Window.partitionBy("document_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    marked = entries.select("*", *(F.min(F.when(F.col("level") == k, F.struct("seq", "page"))).over(after).alias(f"__{k}") for k in levels))
    following = F.array_min(F.array_compact(F.array(*(F.when(F.col("level") >= k, F.col(f"__{k}")) for k in levels))))
    return marked.join(last_page, "document_id").withColumn("end_page", F.greatest(F.col("page"), F.coalesce(following["page"] - 1, F.col("last_page")))).drop(*(f"__{k}" for k in levels), "last_page")


def section_paths(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """document_id, pdf_page and path: the titles of the covering entry of each level with the latest start.

    ``entries`` (document_id, level, title, page, end_page, seq) meet the pages by document and page range.
    """
    covered = pages.join(entries, "document_id").where(F.col("pdf_page").between(F.col("page"), F.col("end_page")))
    best = covered.groupBy("document_id", "pdf_page", "level").agg(F.max_by("title", F.struct("page", "seq")).alias("title"))
    return best.groupBy("document_id", "pdf_page").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "title"))), lambda x: x.title).alias("path"))


def full_text(parts: DataFrame, group: str, order: str) -> DataFrame:
    """The parts of each group in order, a blank line between them."""
    return parts.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x.text), "\n\n").alias("text"))


#: Fixed value: headings of years, with the age or a bracket behind them.
YEAR_HEADING = r"((?:18|19)\d{2})\s*年\s*[（(][^）)]{1,12}岁[）)]"


def year_structure(pages: DataFrame, last_page: DataFrame) -> DataFrame:
    """document_id, title, start and end of the years that headings of ``pages`` (document_id, pdf_page, text) begin.

    A page begins one year at most: that of its first heading whose year no earlier page
    began.  Lines with leaders do not count.  A year ends before the next one's page, the
    last with the document (last_page: document_id, pages).
    """
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n", -1), lambda x: F.trim(x)), lambda x: (F.regexp_count(x, F.lit(r"\.")) < 3) & ~F.contains(x, F.lit("……")))
    headed = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, YEAR_HEADING, 1)), lambda y: y != "")
    found = pages.select("document_id", "pdf_page", headed.alias("years")).where(F.size("years") > 0)
    ordered = found.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pdf_page", "years"))).alias("pages_"))

    def step(begun: Column, page: Column) -> Column:
        fresh = F.filter(page["years"], lambda y: ~F.exists(begun, lambda b: b["year"] == y))
        return F.when(F.size(fresh) > 0, F.concat(begun, F.array(F.struct(F.get(fresh, F.lit(0)).alias("year"), page["pdf_page"].cast("int").alias("start"))))).otherwise(begun)

    none = F.array().cast("array<struct<year:string,start:int>>")
    starts = ordered.select("document_id", F.inline(F.aggregate("pages_", none, step)))
    following = F.lead("start").over(Window.partitionBy("document_id").orderBy("start"))
    ended = starts.withColumn("next", following).join(last_page, "document_id")
    return ended.select("document_id", F.concat("year", F.lit("年")).alias("title"), "start", F.greatest("start", F.coalesce(F.col("next") - 1, "pages")).alias("end"))
