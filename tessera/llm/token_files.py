"""Token-ID output: fixed-width bit packing with block offsets.

A shard is one byte string (little-endian):

====================  =====================================================
``b"TPK1"``           magic
u32 bits              bits of each id
u32 block_ids         ids in each block but the last
u64 n_ids, n_docs     counts
u64[n_docs + 1]       first id of each document, and the end
i64[n_docs]           doc_id (0 where null)
u8[n_docs]            1 where doc_id is null
u64[n_blocks + 1]     where each block begins in the data, and the end
data                  blocks; an id's lowest bit first, padded to whole bytes
====================  =====================================================

Shards lie in a Parquet folder, one row each (``part``, ``shard``, ``start`` in its part,
``n_ids``, ``data``), so that any store Spark writes to will do and a commit is atomic.
Parts and shards in order hold the documents in ascending ``doc_id`` order.

Defined results: null text is an empty document (its end id only); a null doc_id sorts
first and comes back null; equal doc_ids follow each other in an order fixed by their texts;
an empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, steps, table, tidy, work_path
from .tokens import encoder, with_end

MAGIC = b"TPK1"
BLOCK_IDS = 1 << 16
#: A shard is closed at so many ids.
SHARD_IDS = 1 << 20


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def make_shard(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, is_null: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """ends: where each document begins, from 0, and the end."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id doesn't fit {bits} bits")
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)])
    head = MAGIC + struct.pack("<IIQQ", bits, block_ids, len(ids), len(doc_ids))
    return b"".join([head, ends.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), is_null.astype("u1").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Shard:
    """Random access to a shard's ids and documents."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.bits, self.block_ids, self.n_ids, self.n_docs = struct.unpack_from("<IIQQ", data, 4)
        at = 28
        self.ends = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.is_null = np.frombuffer(data, "u1", self.n_docs, at).astype(bool)
        at += self.n_docs
        n_blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.data = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(bytes(self.data[self.offsets[k] : self.offsets[k + 1]]), n, self.bits)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from ``a`` to before ``b``; only the blocks that hold them are read."""
        first, last = a // self.block_ids, -(-b // self.block_ids)
        if a >= b:
            return np.zeros(0, np.uint32)
        got = np.concatenate([self.block(k) for k in range(first, last)])
        return got[a - first * self.block_ids : b - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.ends[i], self.ends[i + 1])


SHARDS = "part int, shard int, start long, n_ids long, n_docs int, data binary"


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenize all texts, write them as shards in ascending id order to the folder ``path``, and return the shards as read back."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        bits = bits_for(max(enc.vocab_size, end_id + 1))
        held: list = []
        start = shard = n = 0

        def close() -> pa.RecordBatch:
            nonlocal start, shard, n
            ids = np.concatenate([x[0] for x in held])
            sizes = np.concatenate([np.diff(x[1]) for x in held])
            data = make_shard(ids, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), bits, block_ids)
            row = pa.RecordBatch.from_pylist([dict(part=part, shard=shard, start=start, n_ids=len(ids), n_docs=len(sizes), data=data)], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("data", pa.binary())]))
            start, shard, n = start + len(ids), shard + 1, 0
            held.clear()
            return row

        for batch in batches:
            for step in steps(batch, "text", 4 << 20):
                ids, ends = with_end(*enc.encode(step.column("text")), end_id)
                key = step.column("doc_id")
                held.append((ids, ends, key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False)))
                n += len(ids)
                if n >= shard_ids:
                    yield close()
        if held:
            yield close()

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # the hash splits a doc_id that many rows share
    tie = F.xxhash64("text")
    ordered = src.withColumn("tie_", tie).repartitionByRange("doc_id", "tie_").sortWithinPartitions("doc_id", "tie_", "text").drop("tie_")
    ordered.mapInArrow(tidy(encode), SHARDS).write.option("compression", "zstd").parquet(path)
    return read_token_shards(spark, path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def shard_documents(shards: DataFrame, ids: bool = True) -> DataFrame:
    """Documents of shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and with ``ids`` the ids themselves (array of int)."""
    spark = shards.sparkSession
    # one number for each part, of which there are as many as tasks wrote
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in totals], np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s = Shard(batch.column("data")[r].as_py())
                flat = s.ids(0, s.n_ids).astype("<u4")
                raw = memoryview(flat.view(np.uint8))
                cut = s.ends.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut, cut[1:])]
                base = before[batch.column("part")[r].as_py()] + batch.column("start")[r].as_py()
                cols = [pa.array(s.doc_ids, pa.int64(), mask=s.is_null), pa.array(s.ends[:-1] + base), pa.array(np.diff(s.ends)), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(s.ends, pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    bounded_batches(spark)
    return shards.select("part", "start", "data").mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "token-shards")
    shards = write_token_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return shard_documents(shards, ids=False)
