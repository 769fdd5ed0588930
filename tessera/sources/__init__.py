"""Reading and writing tables; a catalog of named tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; unset, an own one where all run on one machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_tessera_dir", None)
        if base is None:
            base = spark._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base}/tessera-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = work_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt out to all cores, for work that costs more than the rows' way: a file's row group is read by one task, however many texts it holds."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None, head: int | None = None) -> DataFrame:
    """A Parquet table, pruned to ``columns``; ``head`` keeps any so many rows."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns is not None else df
    return df.limit(head) if head is not None else df


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with header; quoted fields may hold line ends. All columns are strings without ``schema``."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def rows(spark: SparkSession, data: list[dict], schema: str) -> DataFrame:
    """A table in memory."""
    names = [c.split()[0].strip("`") for c in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], schema)


def images(spark: SparkSession, pattern: str, label: str | None = None) -> DataFrame:
    """Files as path, content and label, the first group of the pattern ``label`` in the path."""
    df = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return df.withColumn("label", F.regexp_extract("path", label, 1)) if label else df


def gold(spark: SparkSession, path: str, drop: Iterable[str] = ("image", "poster", "picture")) -> DataFrame:
    """An expected result as CSV, without columns that hold images."""
    df = csv(spark, path)
    return df.select(*(c for c in df.columns if not any(d in c.lower() for d in drop)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows that depend on key and seed only."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(h, key).limit(n)


def replicated(df: DataFrame, times: int, names: Iterable[str] = ()) -> DataFrame:
    """``times`` copies of each row; columns in ``names`` get the copy's number as suffix from the second on."""
    k = F.col("copy_")
    out = df.withColumn("copy_", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    suffixed = {c: F.when(k > 0, F.concat(F.col(c), F.lit("_"), k.cast("string"))).otherwise(F.col(c)) for c in names}
    return out.withColumns(suffixed).drop("copy_") if suffixed else out.drop("copy_")


class Catalog:
    """Tables by name, read when first used."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self.spark = spark
        self._tables = dict(tables)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> Catalog:
        return cls(spark, {n: (lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet")) for n in names})

    def names(self) -> list[str]:
        return list(self._tables)

    def __getitem__(self, name: str) -> DataFrame:
        df = self._tables[name]
        if not isinstance(df, DataFrame):
            df = self._tables[name] = df()
        return df

    def __contains__(self, name: str) -> bool:
        return name in self._tables


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = ()) -> None:
    """Write as parquet, csv, json or orc; nested columns go to CSV as JSON."""
    if format == "csv":
        flat: list[Column] = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df = df.select(*flat)
    out = df.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    (out.option("header", True).option("escape", '"') if format == "csv" else out).format(format).save(path)
