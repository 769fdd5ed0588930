"""Relational operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.measures import bounded

COMPARE = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v,
    "between": lambda c, v: (c > v[0]) & (c < v[1]), "contains": lambda c, v: F.lower(c).contains(str(v).lower()), "in": lambda c, v: c.isin(*v),
    "starts": lambda c, v: c.startswith(v), "matches": lambda c, v: c.rlike(v), "null": lambda c, v: c.isNull() if v else c.isNotNull(),
}
AGGREGATES = ("count", "avg", "sum", "min", "max", "count_distinct")


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of numbers; booleans are none."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The given columns that exist; all without a list."""
    kept = [c for c in columns or df.columns if c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in kept))


def predicate(column: str | Column, op: str, value: object) -> Column:
    """One comparison; ``between`` leaves out both ends; nulls never hold."""
    return COMPARE[op](F.col(f"`{column}`") if isinstance(column, str) else column, value)


def keep(df: DataFrame, conditions: Iterable[tuple[str, str, object]]) -> DataFrame:
    """Rows for which all conditions hold."""
    for c in conditions:
        df = df.filter(predicate(*c))
    return df


def compact(df: DataFrame, width: int = 200) -> DataFrame:
    """Without binary columns and columns named for images; strings cut to ``width``; URLs in ratings are null."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.BinaryType) or any(x in f.name.lower() for x in ("image", "poster")):
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.startswith("data:") if "rating" not in f.name.lower() else ~c.rlike("^(data:|https?://)"), F.substring(c, 1, width))
        out.append(c.alias(f.name))
    return df.select(*out)


def aggregate(df: DataFrame, measures: Sequence[tuple[str, str | None]] = (("count", None),), by: Sequence[str] = (), empty_zero: bool = True) -> DataFrame:
    """Measures (function, column), over groups if ``by`` is given; of no row sums, minima, maxima and means are 0."""
    cols = []
    for fn, c in measures:
        if fn not in AGGREGATES:
            raise ValueError(f"unknown aggregate {fn}")
        name = fn if c is None else f"{fn}_{c}"
        x = F.count("*") if c is None else {"count": F.count, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[fn](F.col(f"`{c}`"))
        cols.append((F.coalesce(x, F.lit(0)) if empty_zero and not by and c is not None else x).alias(name))
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def order(df: DataFrame, keys: Sequence[tuple[str, bool]], ties: Sequence[str] = ()) -> DataFrame:
    """Sorted by (column, descending), nulls last; ``ties`` make the order total."""
    return df.orderBy(*(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys), *ties)


def limit(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def distinct(df: DataFrame) -> DataFrame:
    """Different rows; maps are compared by their sorted entries."""
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    flat = df.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps}) if maps else df
    out = flat.distinct()
    return out.withColumns({c: F.map_from_entries(c) for c in maps}) if maps else out


def union(*frames: DataFrame) -> DataFrame:
    """All rows of two to four inputs; missing columns are null."""
    if not 2 <= len(frames) <= 4:
        raise ValueError("union takes two to four inputs")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]] | None = None, hint: str | None = None, how: str = "inner") -> DataFrame:
    """Join on pairs of columns, nulls equal to nulls; on all common columns without pairs, and on none of these a cross join.

    Of two columns with one name the right one stays.
    """
    if keys is None:
        keys = [(c, c) for c in left.columns if c in right.columns]
    l, r = left.alias("l_"), right.alias("r_")
    if hint:
        r = r.hint(hint)
    if not keys:
        out = l.crossJoin(r)
    else:
        on = None
        for a, b in keys:
            eq = F.col(f"l_.`{a}`").eqNullSafe(F.col(f"r_.`{b}`"))
            on = eq if on is None else on & eq
        out = l.join(r, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.select(*(F.col(f"l_.`{c}`") for c in left.columns if c not in right.columns), *(F.col(f"r_.`{c}`") for c in right.columns))


def frequent_values(df: DataFrame, columns: Sequence[str] | None = None, most: int = 6, least_distinct: int = 2, most_distinct: int = 40) -> DataFrame:
    """(column, value, n, rank): the most frequent values of columns with few of them; ties go to the smaller value.

    All columns are counted in one pass over their distinct values; columns with more than ``most_distinct`` are recognised
    by an approximate count first, so that keys are never grouped.
    """
    columns = list(columns or df.columns)
    few = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first().asDict()
    columns = [c for c in columns if few[c] <= 2 * most_distinct]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, rank int")
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*").filter("value is not null")
    counts = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("column")
    ranked = counts.withColumn("d_", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("d_").between(least_distinct, most_distinct) & (F.col("rank") <= most)).select("column", "value", "n", "rank")


def top_per_group(df: DataFrame, by: Sequence[str], keys: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k rows of each in every task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).filter(F.col("rank") <= k)


def most_frequent(df: DataFrame, by: Sequence[str], column: str, name: str = "mode") -> DataFrame:
    """Each group's most frequent value, the smallest of equals; counts leave a task, not rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n_"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n_")).alias("less"), F.col(column).alias("v")))["v"].alias(name))


def value_counts(df: DataFrame, by: Sequence[str], column: str, name: str = "counts") -> DataFrame:
    """Each group's values with their numbers as one map; of a column with few values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n_"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), F.col("n_").alias("v"))))).alias(name))


def mean_rating(df: DataFrame, by: Sequence[str], rating: Column, name: str = "score") -> DataFrame:
    """The mean of a rating from 1 to 5 for each entity; others don't count."""
    r = rating.cast("double")
    return df.groupBy(*by).agg(F.avg(F.when(r.between(1, 5), r)).alias(name))


def normalize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``x_normalized`` beside each numeric column: x / max(|x|, 1), four places."""
    return df.withColumns({f"{c}_normalized": bounded(F.col(c)) for c in columns or numeric_columns(df)})


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What a visualization shows: one row for each numeric column with rows, min, max, avg."""
    columns = list(columns or numeric_columns(df))
    if not columns:
        return df.agg(F.count("*").alias("rows")).select(F.lit(None).cast("string").alias("column"), "rows", *(F.lit(None).cast("double").alias(x) for x in ("min", "max", "avg")))
    one = df.agg(F.count("*").alias("n_"), *(f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n_").alias("rows"), *(F.col(f"{k}_{i}").alias(k) for k in ("min", "max", "avg"))) for i, c in enumerate(columns)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def manifest(df: DataFrame, format: str) -> DataFrame:
    """What an export holds: format, rows and columns."""
    return df.agg(F.count("*").alias("rows")).select(F.lit(format).alias("format"), "rows", F.lit(",".join(df.columns)).alias("columns"))


def pareto_2d(df: DataFrame, less: str, more: str, ranges: int = 32) -> DataFrame:
    """Rows that no row beats with a smaller or equal ``less`` and a larger or equal ``more``, one of them strictly.

    The front is found on one row for each ``less`` (its largest ``more``): ranges between approximate quantiles
    run apart, each with the largest ``more`` of the ranges before it, so that no task sorts all rows.
    """
    best = df.filter(F.col(less).isNotNull() & F.col(more).isNotNull()).groupBy(less).agg(F.max(more).alias("m_"))
    cuts = sorted(set(best.approxQuantile(less, [i / ranges for i in range(1, ranges)], 0.01)))  # ranges - 1 numbers
    part = F.lit(0)
    for i, cut in enumerate(cuts, 1):
        part = F.when(F.col(less) > cut, i).otherwise(part)
    ranged = best.withColumn("part_", part)
    own = Window.partitionBy("part_").orderBy(less).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part_").agg(F.max("m_").alias("top_"))
    earlier = parts.withColumn("lower_", F.max("top_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))).select("part_", "lower_")
    before = F.greatest("before_", "lower_")
    front = ranged.withColumn("before_", F.max("m_").over(own)).join(F.broadcast(earlier), "part_").filter(before.isNull() | (F.col("m_") > before)).select(less, F.col("m_").alias(more))
    return df.join(front, [less, more], "left_semi")


def constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
