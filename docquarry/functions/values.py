"""Column functions over dates, numbers, hashes, vectors and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str) -> Column:
    """A date written month-year, month/year, month/day/year, year-month-day, year/month/day or year; null otherwise."""
    t = F.trim(_c(c))
    forms = ((r"^\d{1,2}-\d{4}$", "M-yyyy"), (r"^\d{1,2}/\d{4}$", "M/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{4}$", "yyyy"))
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))).cast("date") for p, f in forms])


def duration_days(c: Column | str) -> Column:
    """The first integer of a duration in days: weeks x 7, months x 30, years x 365; null without a number."""
    t = F.lower(_c(c))
    n = F.nullif(F.regexp_extract(t, r"\d+", 0), F.lit("")).cast("int")
    return n * F.when(F.contains(t, F.lit("week")), 7).when(F.contains(t, F.lit("month")), 30).when(F.contains(t, F.lit("year")), 365).otherwise(1)


def document_hash(bucket: Column | str, key: Column | str, version: Column | str, content: Column | str) -> Column:
    """SHA-256 of bucket:key:[version:]content; a null version is left out."""
    return F.sha2(F.concat_ws(":", _c(bucket), _c(key), _c(version), F.coalesce(_c(content), F.lit(""))), 256)


def approx_tokens(c: Column | str) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(c)) / 4)).cast("int")


def vector_literal(c: Column | str, decimals: int = 8) -> Column:
    """[1.00000000,2.50000000]"""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(c), lambda x: F.format_string(f"%.{decimals}f", x.cast("double"))), ","), F.lit("]"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine similarity in double; null for zero vectors and differing lengths."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(_c(a)) == F.size(_c(b))), F.lit(1.0) - dot(a, b) / n)


def zero_vector(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)


def json_object(c: Column | str) -> Column:
    """A JSON object as a map of raw values; null and anything that isn't an object give an empty map."""
    return F.coalesce(F.from_json(F.when(F.ltrim(_c(c)).startswith("{"), _c(c)), "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_merge(old: Column | str, new: Column | str) -> Column:
    """Shallow merge of two JSON objects as maps, the right one winning."""
    a, b = json_object(old), json_object(new)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def clamp(c: Column, low, high) -> Column:
    """The value within low and high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(c, F.lit(high))))


def weighted_mean(scores: list[tuple[Column | str, float]]) -> Column:
    """Mean of the scores that aren't null, weights renormalised; all null gives null."""
    total = sum((F.when(_c(s).isNotNull(), w).otherwise(0.0) for s, w in scores), F.lit(0.0))
    value = sum((F.coalesce(_c(s).cast("double") * w, F.lit(0.0)) for s, w in scores), F.lit(0.0))
    return F.when(total > 0, value / total)


def iso_utc(c: Column | str) -> Column:
    """A time (taken as UTC) as ISO 8601 text with Z."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
