"""Execution history as tables that are only appended to."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .plans.uncertainty import Execution

OPERATORS = "operator_type string, parameters_hash string, estimated_cardinality long, actual_cardinality long, estimated_cost double, actual_cost double, success boolean, query_id string, seq long"
EDGES = "parent_type string, child_type string, score double, query_id string, seq long"


class History:
    """Operator and edge records in a folder, read as of the last append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, operators: Iterable[tuple], edges: Iterable[tuple] = ()) -> None:
        """Append rows in the order of OPERATORS and EDGES."""
        for name, rows, schema in (("operators", list(operators), OPERATORS), ("edges", list(edges), EDGES)):
            if rows:
                self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def operators(self, without: str | None = None) -> DataFrame:
        df = self.spark.read.schema(OPERATORS).parquet(f"{self.path}/operators")
        return df if without is None else df.filter(F.col("query_id") != without)

    def edges(self, without: str | None = None) -> DataFrame:
        df = self.spark.read.schema(EDGES).parquet(f"{self.path}/edges")
        return df if without is None else df.filter(F.col("query_id") != without)


def recent_accuracy(operators: DataFrame, most: int = 20) -> DataFrame:
    """(operator_type, n, accuracy): over the last records of each operator."""
    a, e = F.col("actual_cardinality"), F.col("estimated_cardinality")
    acc = F.when(~F.col("success"), 0.0).when((a > 0) & (e > 0), F.least(a / e, e / a)).otherwise(0.5)
    last = operators.withColumn("n_", F.row_number().over(Window.partitionBy("operator_type").orderBy(F.desc("seq")))).filter(F.col("n_") <= most)
    return last.groupBy("operator_type").agg(F.count("*").alias("n"), F.avg(acc).alias("accuracy"))


def calibrated_confidence(operators: DataFrame, priors: DataFrame, prior_weight: float = 2.0, most: int = 20) -> DataFrame:
    """(operator_type, confidence): priors (operator_type, prior) moved by the recent accuracy."""
    k = F.least(F.coalesce("n", F.lit(0)), F.lit(10))
    moved = (F.col("prior") * prior_weight + F.coalesce("accuracy", F.lit(0.0)) * k) / (prior_weight + k)
    return priors.join(recent_accuracy(operators, most), "operator_type", "left").select("operator_type", F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)).alias("confidence"))


def executions(operators: DataFrame, most: int = 20) -> dict[str, list[Execution]]:
    """The last records of each operator type, for the planner; there are as many types as operators and implementations."""
    last = operators.withColumn("n_", F.row_number().over(Window.partitionBy("operator_type").orderBy(F.desc("seq")))).filter(F.col("n_") <= most).orderBy("operator_type", "seq").collect()
    out: dict[str, list[Execution]] = {}
    for r in last:
        out.setdefault(r["operator_type"], []).append(Execution(r["operator_type"], r["estimated_cardinality"], r["actual_cardinality"], r["success"], r["query_id"]))
    return out
