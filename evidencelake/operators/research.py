"""People, timelines, co-participation, tenure and reviewed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T


def resolve_names(mentioned: DataFrame, names: DataFrame, ambiguities: DataFrame | None = None) -> DataFrame:
    """status, person_id and candidates of each mention: resolved, ambiguous or not_found.

    ``names`` (person_id, form) holds canonical names and active aliases; forms are
    compared without white space and case.  A mention that ``ambiguities`` (form)
    lists is ambiguous whatever it matches.
    """
    forms = names.select("person_id", T.name_key("form").alias("key")).distinct()
    found = mentioned.select("mention", T.name_key("mention").alias("key")).distinct().join(forms, "key", "left")
    if ambiguities is not None:
        found = found.join(ambiguities.select(T.name_key("form").alias("key"), F.lit(True).alias("open")).distinct(), "key", "left")
    else:
        found = found.withColumn("open", F.lit(None).cast("boolean"))
    counted = found.groupBy("mention").agg(F.count_distinct("person_id").alias("candidates"), F.min("person_id").alias("least"), F.max(F.coalesce("open", F.lit(False))).alias("open"))
    status = F.when(F.col("open"), "ambiguous").when(F.col("candidates") == 0, "not_found").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return counted.select("mention", status.alias("status"), F.when(status == "resolved", F.col("least")).alias("person_id"), "candidates")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Keys of ``rows`` that no parent has, with their number."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("rows"))


def overlaps_years(start: Column, end: Column, low: int, high: int) -> Column:
    """Whether partial dates as text overlap a range of years."""
    year = lambda c: F.substring(c, 1, 4).cast("int")
    return (year(F.coalesce(end, start)) >= low) & (year(start) <= high)


def timeline(canonical: DataFrame, members: DataFrame, source: DataFrame, passes: Column) -> DataFrame:
    """Canonical events, and source events that no canonical one stands for, of those that pass a filter.

    A canonical event that the filter drops releases its members.  ``members`` has
    canonical_event_id and event_id; both others have event_id, start_value,
    end_value and what ``passes`` asks for.
    """
    kept = canonical.where(passes)
    hidden = members.join(kept.select(F.col("event_id").alias("canonical_event_id")), "canonical_event_id", "left_semi").select("event_id").distinct()
    own = source.where(passes).join(hidden, "event_id", "left_anti")
    return kept.withColumn("kind", F.lit("canonical")).unionByName(own.withColumn("kind", F.lit("source")))


def chronological(*more: str) -> list[Column]:
    """Order of a timeline: events without a start last."""
    return [F.col("start_value").isNull(), F.col("start_value"), F.coalesce("end_value", F.lit("")), *map(F.col, more)]


def page_of(events: DataFrame, group: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of each group with place, total and has_more."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    total = F.count("*").over(Window.partitionBy(group))
    return events.withColumn("place", place).withColumn("total", total).where((F.col("place") > offset) & (F.col("place") <= offset + limit)).withColumn("has_more", F.col("total") > offset + limit)


def sample_buckets(events: DataFrame, group: str, bucket: Column, best: Column, limit: int) -> DataFrame:
    """Up to ``limit`` events of each group: the best of evenly spaced buckets, in time order."""
    top = events.withColumn("bucket", bucket).groupBy(group, "bucket").agg(F.max_by(F.struct("*"), best).alias("e"), F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("bucket")) - 1
    n = F.count("*").over(Window.partitionBy(group))
    placed = top.withColumn("i", place).withColumn("n", n)
    spots = F.when(F.col("n") <= limit, F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).when(F.lit(limit) == 1, F.array((F.col("n") / 2).cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda j: F.bround(j * (F.col("n") - 1) / F.lit(float(max(1, limit - 1)))).cast("int")))
    return placed.where(F.array_contains(spots, F.col("i").cast("int"))).select(group, "bucket", F.col("e.event_id").alias("event_id"), "size")


def together(events: DataFrame, person: str, shared: list[str]) -> DataFrame:
    """Pairs of people (first < second) and the number of ``shared`` keys on which both appear; the people of a key meet in pairs."""
    rows = events.select(*shared, F.col(person).alias("p")).distinct()
    pairs = rows.withColumnRenamed("p", "first").join(rows.withColumnRenamed("p", "second"), shared).where("first < second")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("shared"))


def period(value: Column) -> tuple[Column, Column]:
    """First and last day of YYYY, YYYY-MM or YYYY-MM-DD; null for anything else."""
    low = F.when(value.rlike(r"^\d{4}$"), F.try_to_date(F.concat(value, F.lit("-01-01")), "yyyy-MM-dd")).when(value.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(value, F.lit("-01")), "yyyy-MM-dd")).when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    high = F.when(value.rlike(r"^\d{4}$"), F.try_to_date(F.concat(value, F.lit("-12-31")), "yyyy-MM-dd")).when(value.rlike(r"^\d{4}-\d{2}$"), F.last_day(low)).otherwise(low)
    return low, high


def held_at(rows: DataFrame, start: str, end: str, at: str) -> DataFrame:
    """Tenures (start and end as partial dates) that overlap the period ``at``; without an end, the start's own period; an unknown start never."""
    low, high = period(F.col(start))
    last = F.when(F.col(end).isNotNull(), period(F.col(end))[1]).otherwise(high)
    at_low, at_high = period(F.lit(at))
    return rows.where((low <= at_high) & (last >= at_low))


def upsert(current: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows after an upsert by ``key``, with the action: created, updated, skipped, or deactivated where ``new`` lacks the key."""
    digest = lambda: F.sha2(F.to_json(F.struct(*columns)), 256)
    old = current.select(key, F.struct(*columns).alias("old"), digest().alias("old_hash"))
    fresh = new.select(key, F.struct(*columns).alias("new"), digest().alias("new_hash"))
    both = old.join(fresh, key, "full_outer")
    action = F.when(F.col("old_hash").isNull(), "created").when(F.col("new_hash").isNull(), "deactivated").when(F.col("old_hash") == F.col("new_hash"), "skipped").otherwise("updated")
    return both.select(key, F.coalesce("new", "old").alias("row"), action.alias("action"), F.col("new_hash").isNotNull().alias("is_active")).select(key, "row.*", "action", "is_active")


def upsert_generated(current: DataFrame, new: DataFrame, key: str, columns: list[str], children: dict[str, tuple[DataFrame, DataFrame]], version: str = "extractor_version") -> DataFrame:
    """key and action of an upsert of generated records that leaves reviewed ones alone: created, updated, skipped or protected.

    A record is the same if its ``columns`` are, and for each of ``children`` (the stored and the new child
    rows, by name) the set of its child rows is, in whatever order they come and however often.
    Only records that rules made, that the same extractor made, and that nobody has reviewed are updated;
    others that differ are protected.  Records that ``new`` lacks stay.  ``current`` has extraction_method,
    ``version`` and review_status besides; child rows are told by all their columns.
    """

    def hashed(rows: DataFrame, kept: list[DataFrame]) -> DataFrame:
        own = rows.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("own"))
        for i, child in enumerate(kept):
            names = sorted(c for c in child.columns if c != key)
            row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
            sets = child.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(row)), ","), 256).alias(f"set{i}"))
            own = own.join(sets, key, "left")
        return own.select(key, F.sha2(F.concat_ws("|", "own", *(F.coalesce(f"set{i}", F.lit("")) for i in range(len(kept)))), 256).alias("content"))

    old = hashed(current, [c[0] for c in children.values()]).withColumnRenamed("content", "old").join(current.select(key, "extraction_method", F.col(version).alias("__version"), "review_status"), key)
    fresh = hashed(new, [c[1] for c in children.values()]).join(new.select(key, F.col(version).alias("__new_version")), key)
    free = (F.col("extraction_method") == "rule") & F.col("__version").eqNullSafe(F.col("__new_version")) & F.col("review_status").isin("unreviewed", "needs_review")
    action = F.when(F.col("old").isNull(), "created").when(F.col("old") == F.col("content"), "skipped").when(F.coalesce(free, F.lit(False)), "updated").otherwise("protected")
    return fresh.join(old, key, "left").select(key, action.alias("action"))


def current_version(versions: DataFrame, key: str, order: str) -> DataFrame:
    """``versions`` with is_current: the latest of each key."""
    return versions.withColumn("is_current", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) == 1)


def scan_status(catalog: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """filename and status of a directory scan: new, unchanged, changed, renamed, missing or unregistered.

    ``catalog`` (document_id, filename) names what is wanted, ``known`` (document_id,
    sha256) the current versions, ``found`` (filename, sha256) the files.  Names are
    compared without case.  A missing document whose hash exactly one unassigned file
    has counts as renamed.
    """
    files = found.select(F.lower("filename").alias("key"), "filename", "sha256")
    wanted = catalog.select("document_id", F.lower("filename").alias("key")).join(known.select("document_id", F.col("sha256").alias("old")), "document_id", "left")
    both = wanted.join(files, "key", "full_outer")
    free = both.where("document_id IS NULL").groupBy("sha256").agg(F.count("*").alias("n"), F.min("key").alias("moved")).where("n = 1").select(F.col("sha256").alias("old"), "moved")
    named = both.join(free, "old", "left")
    status = F.when(F.col("document_id").isNull(), "unregistered").when(F.col("sha256").isNull() & F.col("moved").isNotNull(), "renamed").when(F.col("sha256").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("sha256"), "unchanged").otherwise("changed")
    rows = named.select("document_id", F.coalesce("filename", "moved", "key").alias("filename"), status.alias("status"), "moved")
    taken = rows.where("status = 'renamed'").select(F.col("moved").alias("key"))
    return rows.withColumn("key", F.lower("filename")).join(taken.withColumn("taken", F.lit(True)), "key", "left").where("NOT (status = 'unregistered' AND coalesce(taken, false))").select("document_id", "filename", "status")
