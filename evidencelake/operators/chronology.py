"""Events of chronologies: entries across pages, people, types, places, confidence and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import dates
from evidencelake.functions import text as T
from evidencelake.operators import names

#: Words of event types in the order they are tried.
TYPES = (
    ("correspondence", ("致电", "致信", "电告", "复信", "来函", "签发")),
    ("meeting", ("会议", "大会", "全会", "座谈会", "开会", "出席", "主持")),
    ("speech", ("讲话", "演说", "发言", "报告", "发表", "撰写", "起草")),
    ("visit", ("访问", "考察", "视察", "前往", "抵达", "到达", "返回", "赴")),
    ("military", ("战役", "战斗", "进攻", "歼灭", "作战", "伏击", "攻克", "撤退", "率部")),
    ("appointment", ("任命", "当选", "任职", "担任", "兼任", "被选为")),
)
#: What flags and precisions take off the confidence, its least value, and limits of records.
DEDUCTIONS = {"multiple_dates": 0.12, "inherited_date": 0.15, "unknown_date": 0.25, "year_only_fallback": 0.12, "invalid_date_component": 0.20, "invalid_date_order": 0.20, "approximate_date": 0.06, "cross_page": 0.04}
PRECISIONS = {"month": 0.03, "year": 0.08}
OCR, FLOOR, NAME, QUOTE, SHORTEST = 0.08, 0.4, 46, 1200, 12
REVIEW = ("multiple_dates", "inherited_date", "unknown_date", "invalid_date_component", "invalid_date_order")
SUBJECT = "年谱主体"
#: Verbs before a place and words after it, endings of places, and places known by name.
PLACE = r"(?:抵达|到达|前往|返回|来到|进驻|移驻|撤至|占领|攻克|进入|进至|开往|移防|离开|撤出|集中|在|于|赴|从|经|向|到)([一-鿿·]{2,16}?)(?=召开|举行|出席|参加|会见|接见|主持|访问|考察|视察|工作|学习|休养|前进|起飞|，|。|；)"
NOT_PLACES = ("会议", "会上", "工作", "中央")
PLACE_ENDS = ("附近地区", "机场", "车站", "饭店", "大学", "境内", "地区", "附近", "以北", "以南", "以东", "以西")
PLACE_SUFFIXES = ("省", "市", "县", "区", "镇", "村", "山", "关", "岭", "沟", "屯", "堡", "车站", "饭店", "大学")
PLACES = ("北京", "北平", "上海", "广州", "武汉", "南京", "天津", "重庆", "延安", "西安", "南昌", "瑞金", "井冈山", "太原", "沈阳", "长春", "哈尔滨", "公主屯", "平型关", "山海关", "巴黎", "里昂", "伦敦", "爱丁堡", "莫斯科", "苏联", "法国", "德国", "印度", "朝鲜", "越南", "蒙古")

#: Lines of page numbers and of years, labels of dates that begin a line, and how an entry on the subject begins.
PAGE_NUMBER = r"^[\s—–-]*[0-9]{1,4}[\s—–-]*$"
YEAR_LINES = {"zhou": r"^\[周恩来年谱\]\s*(?:18|19)\d{2}\s*年\s*[（(][^）)]*岁[^）)]*[）)]\s*$", "lin": r"^(?:\d\s*){4}年\s*[^\n]{0,20}岁\s*$"}
_NUMBER, _SPACE = r"\d(?:\s*\d)?", r"[ \t\x{3000}]"
DATE_LINE = (
    rf"(?m)^{_SPACE}*((?:{_NUMBER}\s*月\s*{_NUMBER}\s*日?(?:\s*[—－–~～至一、,，]\s*(?:{_NUMBER}\s*月\s*)?{_NUMBER}\s*日?)*"
    rf"|{_NUMBER}\s*月\s*(?:上旬|中旬|下旬|中下旬|初|月初|末|底)|{_NUMBER}\s*月|同日|翌日|当日|本月|是月)(?:[（(][^）)\n]{{1,50}}[）)])?){_SPACE}+"
)
TIMES = r"^(?:(?:上午|下午|晚上|晚间|晚|早晨|凌晨|清晨|晨|夜|中午|午后|深夜)[一二三四五六七八九十〇零两\d点时分半]*[，,、]?)+"
ACTS = (
    "和", "与", "同", "在", "为", "致", "复", "阅", "审阅", "起草", "出席", "主持", "会见", "接见", "到", "离开", "返回", "抵", "得知", "修改", "签", "听", "写", "作", "读",
    "指示", "批", "约", "收到", "转", "电", "赴", "谈", "继续", "参加", "召集", "就", "关于", "要求", "应", "向", "陪", "率", "发表", "离", "回", "决定", "提出",
)


def prepared(pages: DataFrame, repeated: DataFrame, layout: str) -> DataFrame:
    """``pages`` without empty lines, lines ``repeated`` (document_id, line) in a document, page numbers and headings of years.

    Spaces become single.  ``layout`` chooses the headings (``zhou`` or ``lin``).
    """
    known = repeated.groupBy("document_id").agg(F.collect_set("line").alias("__repeated"))
    lines = F.transform(F.split("text", "\r\n|\r|\n", -1), lambda x: F.trim(F.regexp_replace(x, f"{_SPACE}+", " ")))
    good = lambda x: (x != "") & ~x.rlike(PAGE_NUMBER) & ~x.rlike(YEAR_LINES[layout]) & ~F.coalesce(F.array_contains("__repeated", x), F.lit(False))
    return pages.join(known, "document_id", "left").withColumn("text", F.array_join(F.filter(lines, good), "\n")).drop("__repeated")


def line_entries(pages: DataFrame, years: DataFrame) -> DataFrame:
    """Entries of ``pages`` whose lines begin with dates: document_id, entry, label, date, text, pages, methods.

    ``years`` has document_id, pdf_page and year (see ``years_of_pages``); pages
    without a year are left out.  What precedes the first date of a page goes on with
    the entry before, but not into another year.  A label that no date can be read
    from stands for its year.
    """
    marked = F.split(F.regexp_replace("text", DATE_LINE, "\x01$1\x02"), "\x01", -1)
    dated = pages.join(years.select("document_id", "pdf_page", "year"), ["document_id", "pdf_page"])
    by_page = Window.partitionBy("document_id").orderBy("pdf_page")
    turns = dated.withColumn("turn", F.coalesce((F.col("year") != F.lag("year").over(by_page)).cast("int"), F.lit(0))).withColumn("run", F.sum("turn").over(by_page))
    pieces = turns.select("document_id", "run", "year", "pdf_page", "method", F.posexplode(marked).alias("at", "piece"))
    named = F.contains("piece", F.lit("\x02"))
    split = pieces.withColumn("label", F.when(named, F.substring_index("piece", "\x02", 1))).withColumn("body", F.when(named, F.substring_index("piece", "\x02", -1)).otherwise(F.col("piece")))
    order = Window.partitionBy("document_id", "run").orderBy("pdf_page", "at")
    placed = split.withColumn("n", F.sum(F.col("label").isNotNull().cast("int")).over(order)).where("n > 0")
    grouped = placed.groupBy("document_id", "run", "n").agg(
        F.min("label").alias("label"),
        F.min("year").alias("year"),
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pdf_page", "at", "body"))), lambda p: F.regexp_replace(p["body"], r"^\s+|\s+$", "")), lambda b: b != ""), "\n").alias("text"),
        F.array_sort(F.collect_set(F.when(F.col("body").rlike(r"\S"), F.col("pdf_page")))).alias("pages"),
        F.array_sort(F.collect_set("method")).alias("methods"),
    )
    read = grouped.where(F.col("text") != "").withColumn("date", dates.parsed("label", F.col("year")))
    whole_year = F.struct(F.struct(F.lpad(F.col("year").cast("string"), 4, "0").alias("value"), F.lit("year").alias("precision"), F.lit("inferred").alias("certainty")).alias("start"), F.lit(None).cast(dates.DATE["end"].dataType).alias("end"), F.array(F.lit("unknown_date")).alias("flags"))
    date = F.when(F.col("date.start.value").isNull(), whole_year).otherwise(F.col("date"))
    entry = F.row_number().over(Window.partitionBy("document_id").orderBy("run", "n"))
    return read.select("document_id", entry.alias("entry"), "label", date.alias("date"), "text", "pages", "methods")


def about_subject(text: Column, label: Column, known: list[str]) -> Column:
    """Whether an entry tells of the subject: it names them, or begins, after its date and time, with an act."""
    body = T.compact(text)
    told = F.when(F.startswith(body, T.compact(label)), F.substring(body, F.length(T.compact(label)) + 1, F.length(body))).otherwise(body)
    named = F.lit(False)
    for name in known:
        named = named | F.contains(text, F.lit(name))
    return named | F.regexp_replace(told, TIMES, "").rlike("^(?:" + "|".join(ACTS) + ")")


def entries(pages: DataFrame) -> DataFrame:
    """Entries of ``pages`` (document_id, pdf_page, text, method): document_id, entry, label, date, text, pages, methods.

    ``【date】`` begins an entry, and so does ``△``, under the same date.  What
    precedes the first mark of a page goes on with the entry before; what precedes
    the first of a document is left out.  A date without a year takes the last year
    of the labels before it.
    """
    pieces = pages.select("document_id", "pdf_page", "method", F.posexplode(F.split("text", "(?=【)|(?=△)")).alias("at", "piece"))
    label = F.regexp_extract("piece", "^【([^】]{1,40})】", 1)
    marked = pieces.withColumn("label", F.when(label != "", label))
    order = Window.partitionBy("document_id").orderBy("pdf_page", "at")
    begins = (F.col("label").isNotNull() | F.startswith("piece", F.lit("△"))).cast("int")
    year = F.regexp_extract("label", r"([0-9]{4})\s*年", 1)
    placed = marked.withColumn("entry", F.sum(begins).over(order)).withColumn("last_label", F.last("label", True).over(order)).withColumn("year", F.last(F.when(year != "", year.cast("int")), True).over(order))
    body = F.regexp_replace(F.regexp_replace("piece", "^【[^】]{1,40}】", ""), "^△", "")
    grouped = placed.where("last_label IS NOT NULL").groupBy("document_id", "entry").agg(
        F.min("last_label").alias("label"),
        F.min("year").alias("year"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pdf_page", "at", body.alias("body")))), lambda p: p["body"]), "").alias("text"),
        F.array_sort(F.collect_set(F.when(F.length(F.trim(body)) > 0, F.col("pdf_page")))).alias("pages"),
        F.array_sort(F.collect_set("method")).alias("methods"),
    )
    return grouped.where(F.length(F.trim("text")) > 0).withColumn("date", dates.parsed("label", F.col("year"))).drop("year")


def years_of_pages(structure: DataFrame, low: int, high: int) -> DataFrame:
    """document_id, pdf_page and year of pages under a heading of a year; of several the last entry's."""
    year = F.regexp_extract("title", r"((?:18|19|20)[0-9]{2})\s*年", 1)
    dated = structure.where(year != "").withColumn("year", year.cast("int")).where(F.col("year").between(low, high))
    each = dated.select("document_id", F.explode(F.sequence("page", "end_page")).alias("pdf_page"), "year", "seq")
    return each.groupBy("document_id", "pdf_page").agg(F.max_by("year", "seq").alias("year"))


def participants(rows: DataFrame, forms: DataFrame, subjects: DataFrame) -> DataFrame:
    """document_id, entry and participants, the subject first and the others as they come.

    forms (person_id, form) that several people share do not count; of a person's
    forms the earliest in the text does, then the longest.  subjects has
    document_id, person_id and name.
    """
    single = forms.groupBy("form").agg(F.count_distinct("person_id").alias("n"), F.min("person_id").alias("person_id")).where("n = 1").select("form", "person_id", T.compact("form").alias("key"))
    texts = rows.select("document_id", "entry", T.compact("text").alias("body"))
    met = names.found(texts, ["document_id", "entry"], "body", single, "key")
    found = met.groupBy("document_id", "entry", "person_id").agg(F.min_by(F.struct("form", "at"), F.struct("at", -F.length("form"))).alias("m")).select("document_id", "entry", "person_id", "m.form", "m.at")
    subject = rows.select("document_id", "entry").join(subjects, "document_id").join(found, ["document_id", "entry", "person_id"], "left")
    first = subject.select("document_id", "entry", "person_id", F.lit(SUBJECT).alias("role"), F.coalesce("form", "name").alias("mention_text"), F.when(F.col("form").isNotNull(), "explicit").otherwise("chronology_subject").alias("mention_source"), F.lit(-1).alias("at"))
    others = found.join(subjects.select("document_id", "person_id"), ["document_id", "person_id"], "left_anti").select("document_id", "entry", "person_id", F.lit(None).cast("string").alias("role"), F.col("form").alias("mention_text"), F.lit("explicit").alias("mention_source"), "at")
    gathered = first.unionByName(others).groupBy("document_id", "entry").agg(F.array_sort(F.collect_list(F.struct("at", "person_id", "role", "mention_text", "mention_source"))).alias("all"))
    return gathered.select("document_id", "entry", F.transform("all", lambda p: F.struct(p["person_id"].alias("person_id"), p["role"].alias("role"), p["mention_text"].alias("mention_text"), p["mention_source"].alias("mention_source"))).alias("participants"))


def event_type(text: Column) -> Column:
    out = F.lit("activity")
    for name, words in reversed(TYPES):
        out = F.when(text.rlike("|".join(words)), name).otherwise(out)
    return out


def event_name(subject: Column, text: Column) -> Column:
    """The subject and the first clause, shortened."""
    clause = F.get(F.split(T.compact(text), "[。！？；]"), F.lit(0))
    return F.concat(subject, F.lit("："), F.when(F.length(clause) > NAME, F.concat(F.substring(clause, 1, NAME), F.lit("…"))).otherwise(clause))


def confidence(base: Column, flags: Column, precision: Column, methods: Column) -> Column:
    """The base less what distinct flags, the precision and OCR take off, to two places."""
    weights = F.create_map(*(F.lit(x) for pair in DEDUCTIONS.items() for x in pair))
    off = F.aggregate(F.array_distinct(flags), F.lit(0.0), lambda total, f: total + F.coalesce(weights[f], F.lit(0.0)))
    for name, weight in PRECISIONS.items():
        off = off + F.when(precision == name, weight).otherwise(0.0)
    off = off + F.when(F.array_contains(methods, "ocr"), OCR).otherwise(0.0)
    return F.round(F.greatest(F.lit(FLOOR), F.round(base - off, 9)), 2)


def _place_name(words: Column) -> Column:
    """The place that the words after a verb begin with; null if they name none."""
    up_to = [F.when(F.contains(words, F.lit(e)), F.concat(F.substring_index(words, e, 1), F.lit(e))) for e in PLACE_ENDS]
    known = F.regexp_extract(words, f"^(?:{'|'.join(sorted(PLACES, key=lambda p: (-len(p), p)))})", 0)
    whole = F.when(words.rlike(f"(?:{'|'.join(PLACE_SUFFIXES)})$"), words)
    return F.when(~words.rlike(f"^(?:{'|'.join(NOT_PLACES)})"), F.coalesce(*up_to, F.when(known != "", known), whole))


def places(text: Column) -> Column:
    """Up to three places that a text names after a verb of movement or rest, joined; null if there are none.

    Of names that hold one another only the longest counts, where the first of them stands.
    """
    said = F.transform(F.regexp_extract_all(T.compact(text), F.lit(PLACE), F.lit(1)), lambda words: F.regexp_replace(words, "的+$", ""))
    names = F.array_compact(F.transform(said, _place_name))
    longest = F.filter(F.array_distinct(names), lambda n: ~F.exists(names, lambda m: (m != n) & F.contains(m, n)))
    first = lambda n: F.array_min(F.array_compact(F.transform(names, lambda m, i: F.when(F.contains(n, m), i))))
    placed = F.array_sort(F.transform(longest, lambda n: F.struct(first(n).alias("at"), n.alias("name"))))
    return F.nullif(F.array_join(F.transform(F.slice(placed, 1, 3), lambda p: p["name"]), "；"), F.lit(""))


def candidates(rows: DataFrame, people: DataFrame, subjects: DataFrame, base: float = 0.89) -> DataFrame:
    """Event records of ``entries`` with their participants; entries of few characters or no page are left out."""
    joined = rows.join(people, ["document_id", "entry"]).join(subjects.select("document_id", F.col("name").alias("subject")), "document_id")
    usable = joined.where((F.length(T.compact("text")) >= SHORTEST) & (F.size("pages") > 0))
    more = F.array_compact(F.array(F.when(F.size("pages") > 1, F.lit("cross_page")), F.when(F.col("participants")[0]["mention_source"] == "chronology_subject", F.lit("subject_from_chronology"))))
    flagged = usable.withColumn("flags", F.concat(F.col("date.flags"), more))
    identity = ("document_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","), F.col("date.start.value"), T.compact("text"))
    return flagged.select(
        F.concat(F.lit("event_"), T.stable_id(*identity, length=28)).alias("event_id"),
        F.concat(F.lit("evidence_"), T.stable_id(*identity, length=28)).alias("evidence_id"),
        "document_id",
        event_name(F.col("subject"), F.col("text")).alias("name"),
        event_type(F.col("text")).alias("event_type"),
        F.col("date.start").alias("start"),
        F.col("date.end").alias("end"),
        places(F.col("text")).alias("location_text"),
        "participants",
        F.substring("text", 1, QUOTE).alias("quote"),
        F.array_min("pages").alias("pdf_page_start"),
        F.array_max("pages").alias("pdf_page_end"),
        confidence(F.lit(base), F.col("flags"), F.col("date.start.precision"), F.col("methods")).alias("extraction_confidence"),
        F.when(F.arrays_overlap("flags", F.array(*map(F.lit, REVIEW))), "needs_review").otherwise("unreviewed").alias("review_status"),
        "flags",
    )


def run_summary(events: DataFrame) -> DataFrame:
    """Per document: events, those that need review, those with a place, and the mean confidence."""
    return events.groupBy("document_id").agg(F.count("*").alias("events"), F.count_if(F.col("review_status") == "needs_review").alias("needs_review"), F.count("location_text").alias("with_location"), F.round(F.avg("extraction_confidence"), 4).alias("confidence"))


def spaced_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` evenly spaced rows of each group in order, or all if there are no more."""
    window = Window.partitionBy(group)
    placed = rows.withColumn("__i", F.row_number().over(window.orderBy(order)) - 1).withColumn("__n", F.count("*").over(window))
    step = (F.col("__n") - 1) / F.lit(float(max(1, n - 1)))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step).cast("int"))
    return placed.where((F.col("__n") <= n) | F.array_contains(spots, F.col("__i").cast("int"))).drop("__i", "__n")
