"""Reciprocal-rank fusion, page de-duplication and coverage of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal ranks, the source bonus, and the rules of temporal coverage.
RRF_K, SOURCE_BONUS = 60, 0.004
LEAST_SPAN, BUCKETS, LEAST_K = 5, 3, 3


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + rank), F.lit(0.0))


def fuse(keyword: DataFrame, vector: DataFrame, k: int, bonus: DataFrame | None = None) -> DataFrame:
    """Both branches (query_id, id, rank) as one ranking: query_id, id, keyword_rank, vector_rank, rrf_score, rank.

    ``bonus`` (query_id, id, bonus) is added to the sum of reciprocal ranks.  Ties go to the smaller id.
    """
    one = keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    two = vector.select("query_id", "id", F.col("rank").alias("vector_rank"))
    both = one.join(two, ["query_id", "id"], "full_outer")
    extra = F.lit(0.0)
    if bonus is not None:
        both = both.join(bonus, ["query_id", "id"], "left")
        extra = F.coalesce(F.col("bonus"), F.lit(0.0))
    scored = both.withColumn("rrf_score", F.round(reciprocal(F.col("keyword_rank")) + reciprocal(F.col("vector_rank")) + extra, 8))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def source_bonus(intent: Column, source_type: Column, names_person: Column, has_people: Column) -> Column:
    """The bonus of a hit whose source suits the question."""
    timeline = (intent == "timeline") & (names_person | (~has_people & (source_type == "chronology")))
    fits = timeline | ((intent == "viewpoint") & (source_type == "selected_works")) | ((intent == "observation") & (source_type == "contemporary_observation"))
    return F.when(fits, SOURCE_BONUS).otherwise(0.0)


def first_per_page(ranked: DataFrame, preferred: Column | None = None) -> DataFrame:
    """One hit of each query and page, the preferred or else the first ranked, ranked anew."""
    order = [F.col("rank")] if preferred is None else [preferred.desc(), F.col("rank")]
    first = F.row_number().over(Window.partitionBy("query_id", "document_id", "page").orderBy(*order))
    kept = ranked.withColumn("__first", first).where("__first = 1").drop("__first")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def fuse_variants(variants: DataFrame, k: int) -> DataFrame:
    """Rankings of a question's variants (query_id, variant, id, rank) as one: query_id, id, variants, rrf_score, rank."""
    scored = variants.groupBy("query_id", "id").agg(F.count("*").alias("variants"), F.round(F.sum(reciprocal(F.col("rank"))), 8).alias("rrf_score"), F.min("rank").alias("best_rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "best_rank", "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def gaps(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Variants (query_id, variant) without a hit that the keyword branch backs."""
    return asked.select("query_id", "variant").distinct().join(hits.where("keyword_rank IS NOT NULL").select("query_id", "variant").distinct(), ["query_id", "variant"], "left_anti")


def merge_rounds(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The first round's hits in their order, then those only the second has; the first ``k`` of each query."""
    both = first.select("query_id", "id", "rank").withColumn("round", F.lit(1)).unionByName(second.select("query_id", "id", "rank").withColumn("round", F.lit(2)))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("round", "rank")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at.round", "at.rank", "id"))
    return once.select("query_id", "id", F.col("at.round").alias("round"), rank.alias("rank")).where(F.col("rank") <= k)


def reserve(ranked: DataFrame, reserved: Column, k: int) -> DataFrame:
    """``k`` hits of each query: the reserved first, then others by rank; returned in the order of rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(reserved.desc(), "rank"))
    return ranked.withColumn("__place", place).where(F.col("__place") <= k).drop("__place").withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def cover_years(ranked: DataFrame, year: str, low: int, high: int, k: int) -> DataFrame:
    """``k`` hits of each query with the best of every year from ``low`` to ``high`` among them.

    If more years than ``k`` have hits, the best ranked of them stay.
    """
    place = F.row_number().over(Window.partitionBy("query_id", year).orderBy("rank"))
    inside = F.coalesce(F.col(year).between(low, high), F.lit(False))
    marked = ranked.withColumn("__best", F.when(inside, place))
    return reserve(marked, F.coalesce(F.col("__best") == 1, F.lit(False)), k).drop("__best")


def cover_spans(ranked: DataFrame, year: str, low: int, high: int, k: int) -> DataFrame:
    """``k`` hits of each query with at least ``k // 3`` from each third of the years, where they exist; adds bucket."""
    span = high - low + 1
    bucket = F.when(F.col(year).between(low, high), F.least(F.lit(BUCKETS - 1), F.floor((F.col(year) - low) * BUCKETS / span)).cast("int"))
    marked = ranked.withColumn("bucket", bucket)
    place = F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("rank"))
    marked = marked.withColumn("__place", F.when(F.col("bucket").isNotNull(), place))
    return reserve(marked, F.coalesce(F.col("__place") <= max(1, k // BUCKETS), F.lit(False)), k).drop("__place")


def cover(ranked: DataFrame, year: str, years: tuple[int, int] | None, k: int, mode: str = "auto", sub_period: bool = False) -> DataFrame:
    """The selection that ``mode`` asks for: relevance, per_item, auto, per_year or balanced."""
    plain = mode in ("relevance", "per_item") or not years or k < LEAST_K
    if mode == "auto" and not plain:
        plain = years[1] - years[0] + 1 < LEAST_SPAN or sub_period
    if plain:
        return reserve(ranked, F.lit(False), k)
    span = years[1] - years[0] + 1
    by_year = mode == "per_year" or (mode == "auto" and span <= k)
    return (cover_years if by_year else cover_spans)(ranked, year, *years, k)


def primary_year(section_years: Column, text: Column, years: Column, low: int, high: int) -> Column:
    """The year a hit is about, within a range: the first of its section, else the earliest ``Y年`` in the text, else the least."""
    inside = lambda a: F.filter(a, lambda y: y.between(low, high))
    section = F.get(inside(section_years), F.lit(0))
    placed = F.array_sort(F.filter(F.transform(inside(years), lambda y: F.struct(F.position(F.concat(y.cast("string"), F.lit("年")), text).alias("at"), y.alias("y"))), lambda p: p["at"] > 0))
    return F.coalesce(section, F.get(placed, F.lit(0))["y"], F.array_min(inside(years)))


def retrieval_limit(coverage: str, k: int, variants: int) -> int:
    """Hits to retrieve for a coverage, 36 at most."""
    return min(36, k if coverage == "relevance" else max(k, 24) if coverage == "balanced" else max(k, 3 * variants))
