"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one vectorised step works on at a time; bounds a Python worker's memory.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset, an own one where all run on one machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_tessera_dir", None)
        if base is None:
            base = spark._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return base


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in this application's part of the shared folder; ``clear_work`` removes that part."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_work(spark: SparkSession) -> None:
    """Remove all that this application's operators wrote to the shared folder, results that are not yet read too."""
    remove(spark, f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}")


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = path or work_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are removed when the block ends; what it returns must be written outside."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.n = spark, work_path(spark, what), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)

    def written(self, df: DataFrame, what: str) -> DataFrame:
        self.n += 1
        return written(df, what, f"{self.path}/{self.n}-{what}")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python small, also where texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def as_strings(arr: pa.Array) -> pa.Array:
    """Nulls as empty strings, 64-bit offsets."""
    return pc.fill_null(arr.cast(pa.large_string()), "")


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def bare(word: str) -> str:
    """A word's letters and digits in lower case."""
    return word.lower() if word.isalnum() else "".join(filter(str.isalnum, word.lower()))


def word_hash(word: str) -> int:
    """64-bit hash of a bare word, never 0; 0 for what has no letter or digit."""
    word = bare(word)
    return (xxhash.xxh64_intdigest(word) or 1) if word else 0


def flat_words(arr: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """White-space separated words of all texts as one dictionary array, and the number of words in each text."""
    lists = pc.utf8_split_whitespace(as_strings(arr))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().dictionary_encode(), counts


def word_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and where each text's begin (one more entry than texts)."""
    words, counts = flat_words(arr)
    table = np.fromiter(map(word_hash, words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words.dictionary))
    hashes = table[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    keep = hashes != 0
    ends = np.concatenate([[0], np.cumsum(counts)])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], kept[ends]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; a shorter text is one run, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    m = max(n - k + 1, 1)
    out = np.zeros(m, np.uint64)
    for i in range(min(k, n)):
        out = mix(out + hashes[i : i + m])
    return out


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, after which the worker gives its free memory back; workers live on for the next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the work makes many small objects but no cycles
        try:
            for out in work(batches):
                yield out
                pa.default_memory_pool().release_unused()
        finally:
            gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run
