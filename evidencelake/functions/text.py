"""Text functions on columns: normal forms, tokens, n-grams and page classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ideographs, Latin words and numbers, four-digit years of 1800 to 2099.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
CJK_RUN = rf"{CJK}+"
LATIN = r"[A-Za-z]+(?:[-_][A-Za-z0-9]+)*|[0-9]+(?:\.[0-9]+)?"
YEAR = r"(?<![0-9])((?:18|19|20)[0-9]{2})(?![0-9])"
#: What stands between terms of the ranked index.
TERM_BREAK = r"[^\p{L}\p{N}]+"
#: Limits of page classes.
SHORT_TEXT, REPLACEMENT_RATIO = 50, 0.01
LOW_OCR_CHARACTERS, LOW_OCR_CJK = 20, 5


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def for_storage(c: Column | str) -> Column:
    """CRLF and CR as LF, without NUL; nothing else changes."""
    return F.translate(F.regexp_replace(_column(c), "\r\n?", "\n"), "\x00", "")


def compact(c: Column | str) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(_column(c), r"(?U)\s+", "")


def name_key(c: Column | str) -> Column:
    """The form in which names are compared: no white space, lower case."""
    return F.lower(compact(c))


def comparable(c: Column | str) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(_column(c), r"[^\p{L}\p{N}]", ""))


def page_status(text: Column | str, images: Column | str) -> Column:
    """empty, ocr_required or extracted."""
    t, n = compact(text), _column(images)
    bad = F.regexp_count(t, F.lit("�"))
    return F.when((F.length(t) == 0) & (n > 0), "ocr_required").when(F.length(t) == 0, "empty").when(bad > F.length(t) * REPLACEMENT_RATIO, "ocr_required").otherwise("extracted")


def page_flags(text: Column | str, images: Column | str) -> Column:
    """Quality flags in a fixed order."""
    t, n = compact(text), _column(images)
    some = F.length(t) > 0
    bad = F.regexp_count(t, F.lit("�"))
    flags = (
        ("image_only_page", ~some & (n > 0)),
        ("empty_page", ~some & ~(n > 0)),
        ("very_short_text", some & (F.length(t) < SHORT_TEXT)),
        ("high_replacement_ratio", some & (bad > F.length(t) * REPLACEMENT_RATIO)),
        ("no_cjk_text", some & (F.regexp_count(t, F.lit(CJK)) == 0)),
    )
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in flags)))


def ocr_route(status: Column | str, characters: Column | str, cjk: Column | str, error: Column | str) -> Column:
    """Where an OCR page goes: failed, visual_or_blank, low_text, completed or pending."""
    s = _column(status)
    low = (_column(characters) < LOW_OCR_CHARACTERS) | (_column(cjk) < LOW_OCR_CJK)
    return F.when(_column(error).isNotNull() | (s == "failed"), "failed").when(s == "empty", "visual_or_blank").when((s == "extracted") & low, "low_text").when(s == "extracted", "completed").otherwise("pending")


def years(c: Column | str) -> Column:
    """All four-digit years, in order, with repeats."""
    return F.transform(F.regexp_extract_all(_column(c), F.lit(YEAR), 1), lambda y: y.cast("int"))


def cjk_bigrams(run: Column) -> Column:
    """Pairs of neighbouring characters; a run of up to two stays whole."""
    return F.when(F.length(run) <= 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))


def latin_tokens(c: Column | str) -> Column:
    """Lower-cased Latin words and numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(_column(c), F.lit(LATIN), 0), lambda w: F.lower(w))


def index_tokens(c: Column | str) -> Column:
    """Tokens of a text for the index: CJK bigrams, lower-cased Latin words and numbers, and each year twice (YYYY and YYYY年)."""
    t = _column(c)
    bigrams = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(CJK_RUN), 0), cjk_bigrams))
    dated = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(YEAR), 1), lambda y: F.array(y, F.concat(y, F.lit("年")))))
    return F.concat(bigrams, latin_tokens(t), dated)


def ranked_terms(c: Column | str) -> Column:
    """Terms as the ranked index splits them: runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(_column(c)), TERM_BREAK), lambda w: w != "")


def query_tokens(c: Column | str, stop: tuple[str, ...] = (), edges: str = "") -> Column:
    """Index tokens of a query without repeats, stop terms, single characters, and CJK tokens that begin or end with one of ``edges``."""
    tokens = F.array_distinct(index_tokens(c))
    edge = rf"^[{edges}]|[{edges}]$" if edges else None

    def keep(w: Column) -> Column:
        good = (F.length(w) >= 2) & ~w.isin(*stop) if stop else F.length(w) >= 2
        return good & ~(w.rlike(f"^{CJK}") & w.rlike(edge)) if edge else good

    return F.filter(tokens, keep)


def bigrams(c: Column | str) -> Column:
    """Distinct pairs of neighbouring letters or digits, lower-cased; a text of one stays whole."""
    t = comparable(c)
    pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) == 1, F.array(t)).otherwise(F.array_distinct(pairs))


def containment(a: Column | str, b: Column | str) -> Column:
    """Common elements over the smaller set; 0 with an empty one."""
    x, y = _column(a), _column(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Common elements over all; 0 with an empty set."""
    x, y = _column(a), _column(b)
    return F.when(F.least(F.size(x), F.size(y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two float arrays of one length; null if one has no length."""
    x, y = _column(a), _column(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda total, v: total + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def stable_id(*parts: Column | str, separator: str = "|", length: int = 32) -> Column:
    """The first hexadecimal digits of the SHA-256 of the joined parts; a null part is empty."""
    text = F.concat_ws(separator, *(F.coalesce(_column(p).cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(text, 256), 1, length)
