"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

Every document's ids are cut into pieces of at most ``seq_len``. The driver sees only the
histogram of piece lengths (``seq_len`` numbers at most): it places lengths longest first, each
into the shortest pack that has room, and keeps packs with the same content as one pattern
with a count. Patterns are then joined back to pieces by a piece's rank among those of its length.

Defined results: null text is an empty document, that is, its end id only; repeated rows
are packed as documents of their own; an empty table gives no piece. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bounded_batches, steps, table, tidy, written
from .tokens import encoder, with_end

PIECES = "part int, rank_ long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, *, seq_len: int = 4096, end_id: int = 2, keep_ids: bool = True, step_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, written to the shared folder: PIECES, and with ``keep_ids`` the ids (array of int).

    ``rank_`` counts the pieces of one length in one part, from 0.
    """
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        seen = np.zeros(seq_len + 1, np.int64)
        for batch in batches:
            for step in steps(batch, "text", step_bytes):
                ids, ends = with_end(*enc.encode(step.column("text")), end_id)
                total = np.diff(ends)
                n = -(-total // seq_len)
                row = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * seq_len
                length = np.minimum(total[row] - start, seq_len)
                order = np.argsort(length, kind="stable")
                run = length[order]
                first = np.searchsorted(run, run)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - first + seen[run]
                seen += np.bincount(length, minlength=seq_len + 1)
                at = ends[row] + start
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                cols = {"part": pa.array(np.full(len(row), part, np.int32)), "rank_": pa.array(rank), "doc_id": step.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(length.astype(np.int32)), "doc_tokens": pa.array(total[row]), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return written(src.mapInArrow(tidy(encode), PIECES + ", ids array<int>" * keep_ids), "pieces")


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, copies), ...]) that place ``histogram``'s lengths, longest first, each in the shortest pack with room."""
    packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by room
    rooms: list[int] = []  # a heap of -room

    def add(room: int, count: int, pattern: list[tuple[int, int]]) -> None:
        if room not in packs:
            packs[room] = []
            heapq.heappush(rooms, -room)
        packs[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:
                each = seq_len // length
                if left >= each:
                    add(seq_len - each * length, left // each, [(length, each)])
                if left % each:
                    add(seq_len - left % each * length, 1, [(length, left % each)])
                break
            group = packs[room]
            count, pattern = group.pop()
            if not group:
                del packs[room]
                heapq.heappop(rooms)
            below = -rooms[0] if rooms else 0
            # copies until the next shortest packs are no longer than these
            copies = min(max(1, -(-(room - below) // length)), room // length)
            if left < count * copies:
                copies = max(1, min(copies, left // count))
            used = min(count, left // copies)
            if used < count:
                add(room, count - used, pattern)
            last = pattern[-1]
            grown = [*pattern[:-1], (length, last[1] + copies)] if last[0] == length else [*pattern, (length, copies)]
            add(room - copies * length, used, grown)
            left -= used * copies
    return [x for room in sorted(packs) for x in packs[room]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Where ranks of each length go, sorted by length and rank: from rank ``lo`` on, rank lo + i lies in sequence base + i // copies at offset + i % copies * length."""
    rows, base, seen = [], 0, {}
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            lo = seen.get(length, 0)
            rows.append((length, lo, copies, base, offset))
            seen[length] = lo + copies * count
            offset += length * copies
        base += count
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "copies", "base", "offset"), a.T))


def pack_pieces(pieces: DataFrame, *, seq_len: int = 4096) -> DataFrame:
    """Pieces with the sequence and the offset in it that each goes to, and the sequence's padded length."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # one row for each part and length
    before = counts.withColumn("before_", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before_", F.lit(0)).alias("before_"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # seq_len rows at most
    patterns = shortest_pack_first(histogram, seq_len)
    where = slots(patterns)
    used = np.array([sum(a * b for a, b in p) for _, p in patterns], np.int64)
    first = np.concatenate([[0], np.cumsum([c for c, _ in patterns])]).astype(np.int64)
    most = max([0, *histogram.values()]) + 1
    key = where["length"] * most + where["lo"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank_", "before_")}
            length = get["length"].astype(np.int64)
            rank = get["rank_"] + get["before_"]
            k = np.searchsorted(key, length * most + rank, side="right") - 1
            i = rank - where["lo"][k]
            sequence = where["base"][k] + i // where["copies"][k]
            offset = where["offset"][k] + i % where["copies"][k] * length
            total = used[np.searchsorted(first, sequence, side="right") - 1]
            padded = np.where(total & (total - 1), seq_len, total)
            kept = {n: batch.column(n) for n in batch.schema.names if n not in ("before_", "rank_", "part")}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "padded_length": pa.array(padded)})

    joined = pieces.join(before, ["part", "length"])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("before_", "rank_", "part")]
    return joined.mapInArrow(tidy(place), ", ".join([*kept, "sequence_id long", "offset long", "padded_length long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, seq_len: int = 4096, end_id: int = 2, keep_ids: bool = True, step_bytes: int = 4 << 20) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, padded_length, and with ``keep_ids`` its ids."""
    return pack_pieces(cut_pieces(docs, tokenizer_path, seq_len=seq_len, end_id=end_id, keep_ids=keep_ids, step_bytes=step_bytes), seq_len=seq_len)


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """Sequences of ids, padded: sequence_id, doc_ids, ids. A sequence has ``seq_len`` pieces at most, so a group is small."""
    rows = packed.groupBy("sequence_id", "padded_length").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    return rows.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.concat(ids, F.array_repeat(F.lit(pad_id), (F.col("padded_length") - F.size(ids)).cast("int"))).alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.withColumn("length", F.col("length").cast("long"))
