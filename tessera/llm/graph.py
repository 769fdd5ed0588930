"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, written


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, class): the smallest node of its component, for each node that has a link.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest
    node around; rounds stop when the edges stay as they are. Only sums of hashes reach the
    driver. Rounds are written to the shared folder and removed when the next one is there. Minima are pre-aggregated and
    written apart, so that the join with a node that many links meet is a plain one of one row against many, which is broadcast
    where the minima are few and split by AQE where they are not.
    """
    spark = links.sparkSession
    with Scratch(spark, "components") as s:
        edges = s.written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
        before = None
        while True:
            state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
            if state == before or not state["n"]:
                break
            before = state
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = s.written(both.join(s.written(_mins(both), "mins"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
            small = large.join(s.written(_mins(large), "mins"), "u")
            edges = s.written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        return written(edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct()), "components")
