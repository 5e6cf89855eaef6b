"""Partial dates of chronologies: parsing of expressions and of relative years."""

from __future__ import annotations

import calendar
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, types
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Separators, qualifiers and seasons of date expressions.
NOTE = re.compile(r"[（(][^）)]*[）)]")
RANGE = re.compile(r"[—–－~～-]+|至|到|(?<=日)一(?=\d)")
LIST = re.compile(r"[、,，]")
ABOUT = re.compile(r"(?:前后|左右|上旬|中旬|下旬|(?<!\d)[月年][初底末]|约|间|初|底|末)")
SEASON = re.compile(r"^(\d{4})年[春夏秋冬]季?$")
PARTS = re.compile(r"^(?:(\d{4})年)?(?:(\d{1,2})月)?(?:(\d{1,2})日?)?$")
RELATIVE = re.compile(r"(\d{4})年?(及)?(之前|以前|之后|以后|前|后)")
_POINT = types.StructType([types.StructField(name, types.StringType()) for name in ("value", "precision", "certainty")])
DATE = types.StructType([types.StructField("start", _POINT), types.StructField("end", _POINT), types.StructField("flags", types.ArrayType(types.StringType()))])
_NOTHING = {"value": None, "precision": "unknown", "certainty": "unknown"}


class _Fragment:
    """One date: what its text says, and what it takes from before."""

    def __init__(self, text: str, year: int | None, month: int | None):
        self.flags: list[str] = []
        self.value = self.precision = None
        self.certainty = "exact"
        if season := SEASON.match(text):
            self.year, self.month = int(season[1]), None
            self.value, self.precision, self.certainty = season[1], "year", "approximate"
            return
        about = ABOUT.search(text)
        plain = ABOUT.sub("", text)
        found = PARTS.match(plain)
        self.year, self.month = year, month
        if not plain or not found:
            return
        own_year, own_month, day = (int(g) if g else None for g in found.groups())
        if own_year is None:
            self.certainty = "inferred"
        self.year = own_year or year
        self.month = own_month or (month if day else None)
        if self.year is None:
            return
        if about:
            self.certainty = "approximate"
            self.flags.append("approximate_date")
        if self.month is None:
            self.value, self.precision = f"{self.year:04d}", "year"
        elif not 1 <= self.month <= 12:
            self.value, self.precision, self.month = f"{self.year:04d}", "year", None
            self.flags.append("invalid_date_component")
        elif day is None:
            self.value, self.precision = f"{self.year:04d}-{self.month:02d}", "month"
        elif 1 <= day <= calendar.monthrange(self.year, self.month)[1]:
            self.value, self.precision = f"{self.year:04d}-{self.month:02d}-{day:02d}", "day"
        else:
            self.value, self.precision = f"{self.year:04d}-{self.month:02d}", "month"
            self.flags.append("invalid_date_component")

    def point(self) -> dict:
        return {"value": self.value, "precision": self.precision, "certainty": self.certainty} if self.value else dict(_NOTHING)


def parse(expression: str | None, year_hint: int | None = None) -> dict:
    """start, end (or None) and flags of a date expression; later parts take year and month from earlier ones."""
    text = re.sub(r"\s+", "", NOTE.sub("", expression or ""))
    flags: list[str] = []
    listed = [p for p in LIST.split(text) if p]
    parts = listed if len(listed) > 1 else [p for p in RANGE.split(text) if p]
    year, month, points = year_hint, None, []
    for part in parts:
        point = _Fragment(part, year, month)
        flags += point.flags
        year, month = point.year or year, point.month or month
        points.append(point)
    good = [p for p in points if p.value]
    if not good:
        return {"start": dict(_NOTHING), "end": None, "flags": ["unknown_date"]}
    start, end = good[0].point(), None
    if len(good) > 1:
        end = good[-1].point()
        if len(listed) > 1:
            flags.append("multiple_dates")
            start["certainty"] = end["certainty"] = "approximate"
        else:
            flags.append("date_range")
        if end["value"] < start["value"]:
            end = None
            flags = [f for f in flags if f != "date_range"] + ["invalid_date_order"]
    return {"start": start, "end": end, "flags": list(dict.fromkeys(flags))}


_ARROW = to_arrow_type(DATE)


@functools.lru_cache(1 << 16)
def _known(expression: str | None, year_hint: int | None) -> dict:
    """``parse``, remembered: chronologies say the same dates again and again."""
    return parse(expression, year_hint)


@F.arrow_udf(DATE)
def _parsed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for expressions, hints in batches:
        at: dict[tuple, int] = {}
        spots = [at.setdefault(x, len(at)) for x in zip(expressions.to_pylist(), hints.to_pylist(), strict=True)]
        yield pa.array([_known(*x) for x in at], _ARROW).take(pa.array(spots, pa.int32()))


def parsed(expression: Column | str, year_hint: Column | None = None) -> Column:
    """Struct of start, end and flags of a column of date expressions."""
    hint = F.lit(None).cast("int") if year_hint is None else year_hint.cast("int")
    return _parsed(F.col(expression) if isinstance(expression, str) else expression, hint)


def relative_years(question: Column, low: int, high: int) -> Column:
    """[first, last] year of the one ``before`` or ``after`` expression in a question, within bounds; null if it names another year."""
    pattern = RELATIVE.pattern
    years = F.regexp_count(question, F.lit(r"(?<!\d)\d{4}(?!\d)"))
    one = (F.regexp_count(question, F.lit(pattern)) == 1) & (years == 1)
    year, also, word = (F.regexp_extract(question, pattern, i) for i in (1, 2, 3))
    step = F.when(also != "", 0).otherwise(1)
    before = F.array(F.lit(low), F.least(F.lit(high), year.cast("int") - step))
    after = F.array(F.greatest(F.lit(low), year.cast("int") + step), F.lit(high))
    return F.when(one, F.when(word.isin("之前", "以前", "前"), before).otherwise(after))
