"""Numeric measures: sets, scores, time, place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months by their names and short names.
MONTHS = ("january|jan", "february|feb", "march|mar", "april|apr", "may", "june|jun", "july|jul", "august|aug", "september|sep", "october|oct", "november|nov", "december|dec")
#: Seconds and the score of two times no farther apart.
NEARNESS = ((3600, 1.0), (86400, 0.8), (604800, 0.6), (2592000, 0.4), (31536000, 0.2))
#: Words that make no place.
PLACE_STOPS = ("the", "of", "in", "at", "on", "by", "for", "with", "and", "or")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct values; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def scale_factor(rows: Column) -> Column:
    return F.when(rows <= 1, 1.0).otherwise(1 - F.least(F.lit(0.3), F.log10(rows) / 20))


def row_accuracy(actual: Column, estimated: Column) -> Column:
    return F.least(actual / estimated, estimated / actual)


def numeric_score(got: Column, wanted: Column) -> Column:
    """1 / (1 + relative error), 0 from an error of a half."""
    rel = F.abs(got - wanted) / F.greatest(F.abs(wanted), F.lit(1e-9))
    return F.when(rel < 0.5, 1 / (1 + rel)).otherwise(0.0)


def bounded(c: Column) -> Column:
    """c / max(|c|, 1), rounded to four places."""
    return F.round(c.cast("double") / F.greatest(F.abs(c.cast("double")), F.lit(1.0)), 4)


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def time_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common share of two time ranges; 0 if they don't overlap."""
    us = _micros
    lo, hi = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(lo < hi, (us(hi) - us(lo)) / (us(F.greatest(e1, e2)) - us(F.least(s1, s2)))).otherwise(0.0)


def nearness(a: Column, b: Column) -> Column:
    gap = F.abs(_micros(a) - _micros(b)) / 1e6
    out = None
    for seconds, score in NEARNESS:
        out = F.when(gap <= seconds, score) if out is None else out.when(gap <= seconds, score)
    return out.otherwise(0.0)


def time_expression(c: Column) -> Column:
    """A year or month that an expression names, else the expression itself in lower case."""
    t = F.lower(F.trim(c))
    year = F.regexp_extract(t, r"\b(\d{4})\b", 1)
    out = F.when(year != "", F.concat(F.lit("year_"), year))
    for i, names in enumerate(MONTHS, 1):
        out = out.when(t.rlike(rf"\b(?:{names})\b"), F.lit(f"month_{i:02d}"))
    return out.otherwise(t)


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def place_nearness(lat1: Column, lon1: Column, lat2: Column, lon2: Column, reach_km: float = 50.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - kilometres(lat1, lon1, lat2, lon2) / reach_km)


def place_similarity(a: Column, b: Column) -> Column:
    """Shared share of two arrays of place names; without a shared name 0.5 for each pair of which one holds the other and 0.3 for each that shares a word."""
    def plain(x: Column) -> Column:
        return F.array_distinct(F.transform(x, lambda p: F.regexp_replace(F.lower(F.trim(p)), "[,.]", "")))

    def words(p: Column) -> Column:
        return F.filter(F.split(p, " "), lambda w: (F.length(w) > 2) & ~w.isin(*PLACE_STOPS))

    x, y = (plain(F.coalesce(c, F.array().cast("array<string>"))) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    pair = lambda p, q: F.when(q.contains(p) | p.contains(q), 0.5).when(F.arrays_overlap(words(p), words(q)), 0.3).otherwise(0.0)
    total = F.aggregate(F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: pair(p, q)))), F.lit(0.0), lambda s, v: s + v)
    common = F.size(F.array_intersect(x, y))
    return F.when(most <= 0, 0.0).when(common > 0, common / most).otherwise(F.least(F.lit(1.0), total / most))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, as doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
