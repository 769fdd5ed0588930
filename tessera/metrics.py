"""Measures of results and plans as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided 95 % points of Student's t by degrees of freedom.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 15: 2.131, 20: 2.086, 30: 2.042}


def t95(df: int) -> float:
    """The value of the nearest tabled degrees of freedom below; 1.96 beyond the table."""
    return 1.96 if df > 30 else T95[max(d for d in T95 if d <= max(1, df))]


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    n = lambda c: F.sum(c.cast("int"))
    return df.agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))


def precision_recall(df: DataFrame, predicted: Column, actual: Column, empty: float = 0.0) -> DataFrame:
    """precision, recall, f1, accuracy; ``empty`` where a denominator is 0."""
    c = confusion(df, predicted, actual)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(empty)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def set_scores(got: DataFrame, wanted: DataFrame, key: str, empty: float = 0.0) -> DataFrame:
    """The same for two sets of keys."""
    a, b = got.select(key).distinct().withColumn("g_", F.lit(True)), wanted.select(key).distinct().withColumn("w_", F.lit(True))
    both = a.join(b, key, "full")
    return precision_recall(both, F.coalesce("g_", F.lit(False)), F.coalesce("w_", F.lit(False)), empty).drop("accuracy")


def reliability(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """bin, n, mean confidence, accuracy; bins are open below but for the first."""
    b = F.greatest(F.ceil(confidence * bins) - 1, F.lit(0)).cast("int")
    return df.select(b.alias("bin"), confidence.alias("c_"), correct.cast("double").alias("k_")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("c_").alias("confidence"), F.avg("k_").alias("accuracy"))


def calibration(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score in one row."""
    b = F.greatest(F.ceil(confidence * bins) - 1, F.lit(0)).cast("int")
    per = df.select(b.alias("bin"), confidence.alias("c_"), correct.cast("double").alias("k_")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("c_").alias("c"), F.sum("k_").alias("k"), F.sum((F.col("c_") - F.col("k_")) * (F.col("c_") - F.col("k_"))).alias("sq"))
    return per.agg((F.sum(F.abs(F.col("c") - F.col("k"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """The population form over rows that have both; 0 where either doesn't vary."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    m = both.agg(F.covar_pop(a, b).alias("c"), (F.stddev_pop(a) * F.stddev_pop(b)).alias("s"))
    return m.select(F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(0.0).alias("pearson"))


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, population std, min, max and the half width of the 95 % interval."""
    v = F.col(value)
    table = F.create_map(*(F.lit(x) for d in range(1, 31) for x in (d, t95(d))))
    g = (df.groupBy(*by) if by else df.groupBy()).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    t = F.coalesce(F.try_element_at(table, (F.col("n") - 1).cast("int")), F.lit(1.96))
    return g.withColumn("ci95", F.when(F.col("n") > 1, t * F.col("std") / F.sqrt(F.col("n"))).otherwise(0.0))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference and t of pairs."""
    d = F.col(a) - F.col(b)
    g = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("s_"))
    return g.select("n", "mean_difference", F.when(F.col("s_") > 0, F.col("mean_difference") / (F.col("s_") / F.sqrt("n"))).otherwise(0.0).alias("t"))


def complexity_bin(n: Column) -> Column:
    """Questions by the number of operators that they need."""
    return F.when(n <= 2, "simple").when(n == 3, "medium").when(n == 4, "complex").otherwise("very complex")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def diversity(plans: list[set[str]]) -> float:
    """Mean of 1 - Jaccard over all pairs of plans' operators."""
    pairs = [(a, b) for i, a in enumerate(plans) for b in plans[i + 1 :]]
    return sum(1 - len(a & b) / len(a | b) for a, b in pairs if a | b) / len(pairs) if pairs else 0.0


def answered(answer: str, data: list[dict], expected: str, tolerance: float = 1e-6) -> bool:
    """Whether an expected text, number or row count is in an answer or its data."""
    import re

    shown = f"{answer} {data}"
    try:
        want = float(str(expected).replace(",", ""))
    except ValueError:
        return str(expected).lower() in shown.lower()
    got = [float(x.replace(",", "")) for x in re.findall(r"-?\d[\d,]*(?:\.\d+)?", shown)]
    return any(abs(g - want) <= tolerance * max(1.0, abs(want)) for g in got) or len(data) == want


def plan_metrics(plans: list[set[str]], qualities: list[float], objectives: list[tuple[float, float, float]]) -> dict[str, float]:
    """Diversity, relative spread of quality, the volume that the front's means dominate, and its extent in each objective."""
    import statistics

    mean = statistics.fmean(qualities) if qualities else 0.0
    out = {"diversity": diversity(plans), "quality_cv": statistics.pstdev(qualities) / mean if mean else 0.0}
    if objectives:
        lat, res, conf = zip(*objectives)
        out |= {"mean_confidence": statistics.fmean(conf), "mean_risk": 1 - statistics.fmean(conf), "hypervolume": statistics.fmean(c / ((1 + a) * (1 + r)) for a, r, c in objectives)}
        out |= {"spread_latency": max(lat) - min(lat), "spread_resources": max(res) - min(res), "spread_confidence": max(conf) - min(conf)}
    return out


def grounding_score(columns: DataFrame, literals: DataFrame, schema: DataFrame, stored: DataFrame) -> DataFrame:
    """Shares of a plan's columns (column) that exist, and of its literals (value) that are stored, exactly or as a part of a value."""
    c = columns.select(F.lower("column").alias("column")).distinct()
    known = c.join(schema.select(F.lower("column").alias("column")).distinct(), "column", "left_semi")
    v = literals.select(F.lower("value").alias("value")).distinct()
    s = stored.select(F.lower("value").alias("stored")).distinct()
    exact = v.join(s, F.col("value") == F.col("stored"), "left_semi")
    part = v.join(F.broadcast(v).join(s, F.col("stored").contains(F.col("value"))).select("value").distinct(), "value", "left_semi")  # a plan has a handful of literals
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(c, "c").crossJoin(n(known, "k")).crossJoin(n(v, "v")).crossJoin(n(exact, "e")).crossJoin(n(part, "p"))  # five single rows
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return one.select(share("k", "c").alias("column_validity"), share("e", "v").alias("value_exact"), share("p", "v").alias("value_partial"))


def resolution(got: DataFrame, gold: DataFrame, wrong: DataFrame, key: str) -> float | None:
    """1 if a result is nearer to the gold than to the wrong reading, 0.5 if as near, else 0; None where both readings are the same."""
    if not gold.select(key).distinct().exceptAll(wrong.select(key).distinct()).count() and not wrong.select(key).distinct().exceptAll(gold.select(key).distinct()).count():
        return None
    a, b = (set_scores(got, x, key).first()["f1"] for x in (gold, wrong))
    return 1.0 if a > b else 0.5 if a == b else 0.0


def judge_score(answer: str) -> float | None:
    """A rating from 0 to 10 in a judge's answer, such as <rating>7</rating>, as a share."""
    import re

    m = re.search(r"<rating>\s*(\d+(?:\.\d+)?)\s*</rating>", answer) or re.search(r"\b(\d+(?:\.\d+)?)\s*(?:/\s*10)?\b", answer)
    return min(1.0, float(m[1]) / 10) if m else None


def method_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, mean latency, tokens and throughput of runs (validated, seconds, tokens) for every level of ``by`` in one pass."""
    g = runs.rollup(*by).agg(F.count("*").alias("n"), F.avg(F.col("validated").cast("double")).alias("accuracy"), F.avg("seconds").alias("mean_seconds"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("s_"))
    return g.withColumn("per_minute", F.when(F.col("s_") > 0, F.col("n") / F.col("s_") * 60).otherwise(0.0)).drop("s_")


def failure_class(parsed: Column, planned: Column, ran: Column, validated: Column) -> Column:
    """Where a question failed: the first stage that did."""
    return F.when(~parsed, "parse").when(~planned, "plan").when(~ran, "execution").when(~validated, "answer").otherwise("none")
