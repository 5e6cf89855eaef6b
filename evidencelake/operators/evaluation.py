"""Metrics of rankings, answers and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, first (rank of the first relevant hit, null if none) and reciprocal of each query in ``relevant`` (query_id, id)."""
    found = relevant.select("query_id", "id").join(hits.select("query_id", "id", "rank"), ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("first"))
    return found.withColumn("reciprocal", F.coalesce(1.0 / F.col("first"), F.lit(0.0)))


def at_k(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, hit, recall and precision at ``k`` of each query in ``relevant`` (query_id, id)."""
    wanted = relevant.select("query_id", "id").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    found = hits.where(F.col("rank") <= k).join(wanted, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"))
    both = sizes.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.select("query_id", (F.col("found") > 0).cast("int").alias("hit"), (F.col("found") / F.col("relevant")).alias("recall"), (F.col("found") / F.lit(float(k))).alias("precision"))


def ndcg(hits: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """query_id and ndcg at ``k`` with gains 2**grade - 1; a repeated hit gains nothing, and a query without a positive grade is null."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1.0
    once = hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    got = once.where(F.col("rank") <= k).join(grades, ["query_id", "id"]).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = grades.where("grade > 0").withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("place") + 1.0)).alias("best"))
    return grades.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left").select("query_id", F.when(F.col("best") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("best")).alias("ndcg"))


def greedy_ndcg(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg and reason at ``k`` of hits that may cover several pages, each gold page gaining once.

    hits has query_id, rank, document_id, start and end (null: one page); gold has query_id, document_id,
    page, grade and complete (whether the query's gold is all there is).  In the order of ranks a hit takes
    all gold pages that it covers and none took before, and gains for the best of them; so a page
    belongs to the first hit that covers it, which is a minimum and no fold.  ndcg is null where
    the gold is incomplete, a hit took several pages (ambiguous), or there is nothing to gain.
    """
    gain = lambda grade: F.pow(F.lit(2.0), grade) - 1.0
    pages = gold.groupBy("query_id", "document_id", "page").agg(F.max("grade").alias("grade"))
    covered = hits.where(F.col("rank") <= k).select("query_id", "rank", "document_id", F.explode(F.sequence("start", F.coalesce("end", "start"))).alias("page"))
    taken = covered.join(pages, ["query_id", "document_id", "page"]).groupBy("query_id", "document_id", "page").agg(F.min("rank").alias("rank"), F.max("grade").alias("grade"))
    gains = taken.groupBy("query_id", "rank").agg(F.max("grade").alias("grade"), (F.count("*") > 1).alias("several"))
    got = gains.groupBy("query_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.max("several").alias("ambiguous"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = pages.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade")) / F.log2(F.col("place") + 1.0)).alias("best"))
    asked = gold.groupBy("query_id").agg(F.min("complete").alias("complete"))
    both = asked.join(ideal, "query_id", "left").join(got, "query_id", "left")
    nothing = ~F.coalesce(F.col("complete"), F.lit(False)) | F.coalesce(F.col("best") <= 0, F.lit(True))
    reason = F.when(nothing, "incomplete_or_no_gain").when(F.col("ambiguous"), "ambiguous_pages").otherwise("evaluated")
    return both.select("query_id", F.when(reason == "evaluated", F.coalesce("dcg", F.lit(0.0)) / F.col("best")).alias("ndcg"), reason.alias("reason"))


def redundancy(hits: DataFrame, fingerprint: str) -> DataFrame:
    """query_id, hits, distinct and redundancy: the share of hits whose fingerprint another hit has already."""
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_distinct(fingerprint).alias("different")).withColumn("redundancy", (F.col("hits") - F.col("different")) / F.col("hits"))


def confusion(outcomes: DataFrame, sets: list[list[str]]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of (expected, predicted) over each of the grouping ``sets``; a zero denominator is null."""
    columns = sorted({c for s in sets for c in s})
    count = lambda e, p: F.count_if((F.col("expected") == e) & (F.col("predicted") == p))
    grouped = outcomes.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    return grouped.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn"))).withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """mean, p50, p95 (linear interpolation) and the largest value of each group."""
    return rows.groupBy(group).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("most"))


def compare(baseline: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """Both runs' metrics by key with their difference, null where one run lacks the metric, and the reason."""
    both = baseline.select(key, F.col(value).alias("baseline")).join(candidate.select(key, F.col(value).alias("candidate")), key, "full_outer")
    reason = F.when(F.col("baseline").isNull(), "missing_in_baseline").when(F.col("candidate").isNull(), "missing_in_candidate").otherwise("comparable")
    return both.withColumn("delta", F.col("candidate") - F.col("baseline")).withColumn("reason", reason)


def stratified(rows: DataFrame, strata: list[str], identity: str, seed: str, n: int) -> DataFrame:
    """``n`` rows of each stratum by the hash of seed and identity, with place."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(identity).cast("string")), 256)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).where(F.col("place") <= n)


def quote_matches(quote: Column, page: Column) -> Column:
    """Whether a normalised page holds a normalised quote, or 60 % of its anchors of an eighth or so."""
    size = F.least(F.greatest(F.floor(F.length(quote) / 5), F.lit(12)), F.lit(24)).cast("int")
    anchors = F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.length(quote) - 1) / size).cast("int")), lambda i: F.substring(quote, i * size + 1, size)), lambda a: F.length(a) == size)
    share = F.size(F.filter(anchors, lambda a: F.contains(page, a))) / F.greatest(F.size(anchors), F.lit(1))
    return F.when(F.length(quote) == 0, F.lit(False)).otherwise(F.contains(page, quote) | (share >= 0.6))


def disposition(answer: Column, status: Column, refusals: str) -> Column:
    """refused, partial or answered: a refusal by status or wording, partial evidence, or an answer."""
    refused = (status == "no_evidence") | answer.rlike(refusals) | (F.length(F.trim(answer)) == 0)
    return F.when(refused, "refused").when(status == "partial", "partial").otherwise("answered")


def fact_coverage(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """case_id, fact_id and covered of each of ``facts`` (case_id, fact_id, patterns, judged).

    A fact is covered if the answer, letters and digits only, holds one of its
    patterns; without patterns the judge's verdict counts, and without that it is
    unknown (null).
    """
    from evidencelake.functions import text as T

    both = facts.join(answers.select("case_id", T.comparable("answer").alias("__answer")), "case_id", "left")
    held = F.exists("patterns", lambda p: F.contains(F.col("__answer"), F.lower(F.regexp_replace(p, r"[^\p{L}\p{N}]", ""))))
    known = F.coalesce(F.size("patterns"), F.lit(0)) > 0
    return both.select("case_id", "fact_id", F.when(known, F.coalesce(held, F.lit(False))).otherwise(F.col("judged")).alias("covered"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """One row: the mean over cases of the share of known facts covered, the share over all known facts, and how many are known."""
    cases = covered.where("covered IS NOT NULL").groupBy("case_id").agg(F.avg(F.col("covered").cast("double")).alias("share"), F.count("*").alias("known"), F.count_if("covered").alias("found"))
    return cases.agg(F.avg("share").alias("macro"), F.try_divide(F.sum("found").cast("double"), F.sum("known")).alias("micro"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"))


def category(tags: Column, order: list[str], refusal: Column) -> Column:
    """The first of ``order`` among the tags; refusals are one of their own."""
    first = F.get(F.filter(F.array(*map(F.lit, order)), lambda t: F.array_contains(tags, t)), F.lit(0))
    return F.when(refusal, "refusal").otherwise(first)


def consistent_hash(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group and whether all its rows that have a ``value`` share it."""
    return rows.groupBy(group).agg((F.count_distinct(value) <= 1).alias("consistent"))


def route(mode: Column) -> Column:
    """The route that a retrieval mode belongs to."""
    mixed = F.contains(mode, F.lit("hybrid")) | F.contains(mode, F.lit("keyword")) | F.contains(mode, F.lit("vector"))
    named = F.startswith(mode, F.lit("structured_")) | mode.isin("full_text_section", "query_clarification")
    return F.when(named | ~mixed, mode).otherwise("hybrid_retrieval")


def routing(cases: DataFrame) -> DataFrame:
    """``cases`` (case_id, mode, preferred) with route and route_match, null without preferred routes."""
    taken = cases.withColumn("route", route(F.col("mode")))
    return taken.withColumn("route_match", F.when(F.size("preferred") > 0, F.array_contains("preferred", F.col("route"))))


def citation_metrics(citations: DataFrame, gold: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id and metrics of the citations of each case in either table.

    citations has case_id, number, document_id, start, end (null: one page) and quote;
    gold has case_id, document_id and page; pages has document_id, page and text.
    validity is the share of citations all of whose pages exist; consistency that of
    those whose quote stands on a page of theirs, or across them, null unless each can be
    checked (it is found, or all its pages exist); precision the share that meets gold,
    recall the share of gold pages met.  Null where nothing can be counted.
    """
    from evidencelake.functions import text as T

    relevant = gold.select("case_id", "document_id", "page").distinct()
    ranged = citations.select("case_id", "number", "document_id", "quote", F.explode(F.sequence("start", F.coalesce("end", "start"))).alias("page"))
    texts = pages.groupBy("document_id", "page").agg(F.min("text").alias("text"))
    read = ranged.join(texts, ["document_id", "page"], "left").join(relevant.withColumn("gold", F.lit(True)), ["case_id", "document_id", "page"], "left")
    plain = T.comparable("quote")
    on_page = F.coalesce(quote_matches(plain, T.comparable("text")), F.lit(False))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page", "text")))), lambda p: p["text"]), "\n")
    each = read.groupBy("case_id", "number").agg(F.max(on_page).alias("found"), whole.alias("whole"), F.first("quote").alias("quote"), F.min(F.col("text").isNotNull()).alias("exists"), F.coalesce(F.max("gold"), F.lit(False)).alias("relevant"))
    judged = each.withColumn("found", F.col("found") | F.coalesce(quote_matches(plain, T.comparable("whole")), F.lit(False))).withColumn("known", F.col("found") | F.col("exists"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    cited = judged.groupBy("case_id").agg(F.count("*").alias("citations"), share("exists").alias("validity"), F.when(F.min("known"), share("found")).alias("consistency"), share("relevant").alias("precision"))
    met = relevant.join(ranged.select("case_id", "document_id", "page").distinct().withColumn("met", F.lit(1.0)), ["case_id", "document_id", "page"], "left").groupBy("case_id").agg(F.avg(F.coalesce("met", F.lit(0.0))).alias("recall"))
    return cited.join(met, "case_id", "full_outer").withColumn("citations", F.coalesce("citations", F.lit(0)))


def judgment_error(verdict: Column, claims: Column, answer: Column) -> Column:
    """What is wrong with a judge's output: passing_with_claims, failing_without_claims, claim_not_in_answer or null."""
    from evidencelake.functions import text as T

    whole = T.comparable(answer)
    some = F.coalesce(F.size(claims), F.lit(0)) > 0
    foreign = F.exists(claims, lambda c: ~F.contains(whole, T.comparable(c)))
    return F.when((verdict == "pass") & some, "passing_with_claims").when((verdict == "fail") & ~some, "failing_without_claims").when(foreign, "claim_not_in_answer")


#: The categories that a composite set has to cover.
CORE_CATEGORIES = ("timeline", "intersection", "viewpoint", "event", "organization", "conflict", "refusal")
OBSERVATION = "contemporary_observation"


def answer_questions(questions: DataFrame) -> DataFrame:
    """Answer questions (question_id, tags, answerable, evidence: how many anchors) as rows of a composite set."""
    refusal = ~F.col("answerable")
    kind = F.coalesce(category(F.col("tags"), list(CORE_CATEGORIES), refusal), F.when(F.array_contains("tags", OBSERVATION), "viewpoint"))
    return questions.select(F.lit("answer").alias("source"), "question_id", kind.alias("category"), (refusal | (F.col("evidence") > 0)).alias("has_evidence"), F.when(kind.isNull(), "no_core_category").alias("broken"))


def intersection_questions(cases: DataFrame) -> DataFrame:
    """Cases of two people (id, source_event_id, document_id, pdf_page) as rows of a composite set."""
    there = F.coalesce((F.col("source_event_id") != "") & (F.col("document_id") != "") & (F.col("pdf_page") > 0), F.lit(False))
    return cases.select(F.lit("intersection").alias("source"), F.concat(F.lit("intersection::"), "id").alias("question_id"), F.lit("intersection").alias("category"), there.alias("has_evidence"), F.lit(None).cast("string").alias("broken"))


def structured_questions(questions: DataFrame) -> DataFrame:
    """Structured questions (question_id, kind, category, year, at, source_event_id, relationship_id, document_id, pdf_page) as rows of a composite set."""
    none = lambda c: F.col(c).isNull()
    wrong = (
        F.when(~F.col("kind").isin("timeline", "organization"), "unknown_kind")
        .when((F.col("kind") == "timeline") & ((F.col("category") != "timeline") | none("year") | ~none("at")), "timeline_needs_category_and_year")
        .when((F.col("kind") == "timeline") & ~none("relationship_id"), "timeline_has_relationship")
        .when((F.col("kind") == "organization") & ((F.col("category") != "organization") | none("at") | ~none("year")), "organization_needs_category_and_at")
        .when((F.col("kind") == "organization") & none("relationship_id"), "organization_needs_relationship")
        .when(F.coalesce(F.col("pdf_page") < 1, F.lit(False)), "page_below_one")
    )
    there = F.coalesce((F.col("source_event_id") != "") & (F.col("document_id") != "") & (F.col("pdf_page") > 0), F.lit(False))
    return questions.select(F.lit("structured").alias("source"), "question_id", "category", there.alias("has_evidence"), wrong.alias("broken"))


def audit_sets(questions: DataFrame, minimums: dict[str, int], least: int) -> DataFrame:
    """rule, key, found and needed of everything that keeps a composite set of ``questions`` from passing; no rows if it passes.

    The set is the union of the three kinds above.  Rules are questions (fewer than ``least``), category (fewer than
    its minimum), evidence (a source some of whose questions have neither evidence nor a refusal), duplicate (an id of several
    questions), and contract (what is broken, by source and how).
    """
    if set(minimums) != set(CORE_CATEGORIES) or min(minimums.values()) < 1:
        raise ValueError("every core category needs a positive minimum")
    spark = questions.sparkSession
    row = lambda df, rule, key, found, needed: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), found.cast("long").alias("found"), needed.cast("long").alias("needed"))
    total = questions.agg(F.count("*").alias("n")).where(F.col("n") < least)
    wanted = spark.createDataFrame(sorted(minimums.items()), "category string, needed long")
    held = questions.groupBy("category").agg(F.count("*").alias("n"))
    short = wanted.join(held, "category", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < needed")
    bare = questions.groupBy("source").agg(F.count_if(F.coalesce("has_evidence", F.lit(False))).alias("with"), F.count("*").alias("n")).where(F.col("with") < F.col("n"))
    twice = questions.groupBy("question_id").agg(F.count("*").alias("n")).where("n > 1")
    broken = questions.where("broken IS NOT NULL").groupBy("source", "broken").agg(F.count("*").alias("n"))
    parts = [
        row(total, "questions", F.lit(None), F.col("n"), F.lit(least)),
        row(short, "category", F.col("category"), F.col("n"), F.col("needed")),
        row(bare, "evidence", F.col("source"), F.col("with"), F.col("n")),
        row(twice, "duplicate", F.col("question_id"), F.col("n"), F.lit(1)),
        row(broken, "contract", F.concat_ws(":", "source", "broken"), F.col("n"), F.lit(0)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
