"""Removing repeated passages with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id. Every window of that length selects an anchor, the first of the smallest
hashes of the ``GRAM``-byte grams in it; equal windows select equal grams at equal places.

1. Texts are packed into chunks of about ``CHUNK_BYTES`` in the shared folder.
2. Each chunk sends the distinct hashes of its anchors, dealt by hash; those that come from more
   than one chunk, or lie in more than one document of a chunk, are marked.
3. Around each marked anchor a chunk takes the stretch of text whose windows select it, and sends
   each distinct stretch once, with the smallest doc_id that holds it, dealt by the anchor's hash.
   A gram that occurs in more than ``HOT_CHUNKS`` chunks is hot: its stretches are cut by how many bytes a window has before
   the gram, so that windows of one part agree in ``LENGTH - 4`` bytes or so, by which they are dealt instead.
4. Stretches with the same gram form a group; a group of one stretch needs no order. Blocks of all other groups are ordered
   by a suffix array (``suffix.suffix_array``), in which the shared gram is one symbol; suffixes that agree over a whole window are one
   string, and the smallest doc_id of each such run decides. A group of more than ``MOST_SYMBOLS`` is cut in the same
   way into parts whose windows agree in all bytes but one at the first or the last place.
5. The answers go back to the chunks, where windows of larger doc_ids are covered.

Messages go from every chunk to every bucket, so that their number grows with the square of the chunks'. A bucket therefore
stands for several chunks' worth of text where there are many chunks; one of stretches is ordered by parts, and messages travel
many to a batch.

A passage that a third of all documents share is one stretch per chunk, not one per document. Hashes only select what
is looked at; strings are compared as bytes.

Defined results: one row per input row. Null text is an empty one. Rows with the same
doc_id don't remove each other. A row without doc_id takes no part and loses nothing. Texts
shorter than ``LENGTH`` bytes lose nothing. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, table, tidy, written
from .suffix import suffix_array

LENGTH = 50
GRAM = 25
CHUNK_BYTES = 8 << 20
#: Hashes that are sorted at once.
RANGE_HASHES = 1 << 20
#: Symbols that one suffix array orders, about; a group of more than the second is cut.
BLOCK_SYMBOLS, MOST_SYMBOLS = 4_000, 1 << 18
#: A gram in more chunks than this is dealt by longer strings.
HOT_CHUNKS = 64
#: Hashes and stretches are dealt to one bucket for each CHUNK_BYTES of text up to the first number, beyond it to one for each PARTS
#: chunks, so that a chunk's messages stay few and large. A bucket of stretches has a part for each CHUNK_BYTES, which is ordered by
#: itself. No more buckets than the second number.
FEW_BUCKETS, MOST_BUCKETS = 128, 1 << 14
PARTS = 8
#: Messages are sent in batches of about so many bytes.
BATCH_BYTES = 1 << 20
#: Partitions of any shuffle; each reads its chunks and buckets one after the other.
MOST_PARTITIONS = 20_000
#: Bytes whose windows are found at once, so that arrays stay in the cache; a longer document is taken whole.
STEP = 1 << 17
#: Bits of a window's key that hold the place; the others hold the gram's hash.
PLACE_BITS = 24

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NO_ID = np.iinfo(np.int64).max


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` bytes, by doubling."""
    part = (text.astype(np.uint64) + np.uint64(1)) * _M1
    whole, have, size = None, 0, 1
    while True:
        if k & size:
            if whole is None:
                whole = part
            else:
                m = len(part) - have
                whole = whole[:m] * _M2 + part[have:]
                whole ^= whole >> np.uint64(29)
            have += size
        if 2 * size > k:
            break
        part = part[:-size] * _M2 + part[size:]
        part ^= part >> np.uint64(31)
        size *= 2
    whole = whole * _M1
    whole ^= whole >> np.uint64(32)
    return whole * _M2


def _first_smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Where each run of ``w`` hashes has its smallest, the first of equal ones."""
    if len(h) >> PLACE_BITS:  # a very long document: parts that overlap
        cut = (1 << PLACE_BITS) - w
        return np.concatenate([_first_smallest(h[i : i + cut + w - 1], w) + i for i in range(0, len(h) - w + 1, cut)])
    low = np.uint64((1 << PLACE_BITS) - 1)
    v, s = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while s < w:
        t = min(s, w - s)
        v = np.minimum(v[t:], v[:-t])
        s += t
    return (v & low).astype(np.int64)


def runs(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of windows that select one anchor: (first window, last window, anchor, hash), in text order.

    ``ends``: where each document begins in ``text``, and the end; windows lie within a document.
    """
    none = np.zeros(0, np.int64)
    out = []
    a = 0
    while a + 1 < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + STEP, side="right")) - 1)
        lo, hi = int(ends[a]), int(ends[b])
        if hi - lo >= length:
            h = gram_hashes(text[lo:hi], gram)
            q = _first_smallest(h, length - gram + 1)
            n = len(q)
            inside = np.zeros(n + 1, bool)
            first = ends[a:b] - lo
            size = np.diff(ends[a : b + 1])
            ok = size >= length
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, first[ok], 1)
            np.add.at(edge, (first + size - length + 1)[ok], -1)
            inside[:n] = np.cumsum(edge)[:n] > 0
            new = inside[:n].copy()
            new[1:] &= (q[1:] != q[:-1]) | ~inside[: n - 1]
            new[first[ok]] = True
            begin = np.flatnonzero(new)
            stop = inside[:n] & ~inside[1 : n + 1]
            stop[:-1] |= inside[: n - 1] & new[1:]
            last = np.flatnonzero(stop)
            anchor = q[begin]
            out.append((begin + lo, last + lo, anchor.astype(np.int64) + lo, h[anchor]))
        a = b
    return tuple(map(np.concatenate, zip(*out))) if out else (none, none, none, none.astype(np.uint64))


class Chunk:
    """Texts in a row, their doc_ids (NO_ID where null) and their stretches by anchor."""

    def __init__(self, data: bytes, sizes: bytes, ids: bytes):
        import zstandard

        self.sizes = np.frombuffer(sizes, np.int64)
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(self.ends[-1])) if self.ends[-1] else b""
        self.text = np.frombuffer(self.bytes, np.uint8)
        self.first, self.last, self.anchor, self.hash = runs(self.text, self.ends)
        self.doc = np.searchsorted(self.ends, self.first, side="right") - 1
        known = self.ids[self.doc] != NO_ID
        if not known.all():
            self.first, self.last, self.anchor, self.hash, self.doc = (x[known] for x in (self.first, self.last, self.anchor, self.hash, self.doc))
        self.distinct, self.which = np.unique(self.hash, return_inverse=True)
        owner = self.ids[self.doc]
        low, high = np.full(len(self.distinct), NO_ID), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, owner)
        np.maximum.at(high, self.which, owner)
        self.marked = low < high

    def dealt(self, hashes: np.ndarray, buckets: int, parts: int = 1) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, places, where each part begins in them and the end) of hashes, the places of a part in their order."""
        b = (hashes & np.uint64(0xFFFFFF)).astype(np.int64) % (buckets * parts)
        order = np.argsort(b, kind="stable")
        cuts = np.searchsorted(b[order], np.arange(buckets * parts + 1))
        ends = cuts[::parts].tolist()
        return [(k, order[lo:hi], cuts[k * parts : (k + 1) * parts + 1] - lo) for k, (lo, hi) in enumerate(zip(ends, ends[1:])) if lo < hi]

    def mark(self, buckets: int, masks: dict[int, bytes]) -> None:
        self.hot = np.zeros(len(self.distinct), bool)
        for bucket, at, _ in self.dealt(self.distinct, buckets):
            if bucket in masks:
                d = masks[bucket]
                n = int.from_bytes(d[:4], "little")
                self.hot[at[np.frombuffer(d, "<u4", n, 4)]] = True
                self.marked[at] |= np.unpackbits(np.frombuffer(d, np.uint8, -1, 4 + 4 * n), count=len(at), bitorder="little").astype(bool)

    def stretches(self) -> Stretches:
        """Of marked anchors, hot ones cut into parts."""
        runs_ = np.flatnonzero(self.marked[self.which])
        hot = self.hot[self.which[runs_]]
        cool, runs_ = runs_[~hot], runs_[hot]
        data = self.bytes
        first, last, at, doc = ([x[cool]] for x in (self.first, self.last, self.anchor, self.doc))
        size = [np.full(len(cool), GRAM)]
        for before in (range(0, LENGTH - GRAM + 1, 5) if len(runs_) else ()):
            most = before + 4 if before + 9 <= LENGTH - GRAM else LENGTH - GRAM
            f, z = np.maximum(self.first[runs_], self.anchor[runs_] - most), np.minimum(self.last[runs_], self.anchor[runs_] - before)
            some = f <= z
            g, n = (self.anchor[runs_] - before)[some], LENGTH - (most - before)
            for x, v in ((first, f[some]), (last, z[some]), (at, g), (doc, self.doc[runs_][some]), (size, np.full(len(g), n))):
                x.append(v)
            if most == LENGTH - GRAM:
                break
        first, last, at, doc, size = map(np.concatenate, (first, last, at, doc, size))
        place = at - first
        each = [data[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
        # a part of a hot gram's stretch is told apart by where its gram is and how long
        tail = {(p, n): bytes((p, n)) for p in range(LENGTH) for n in range(GRAM, LENGTH + 1)} if hot.any() else {}
        each[len(cool) :] = [x + tail[k] for x, k in zip(each[len(cool) :], zip(place[len(cool) :].tolist(), size[len(cool) :].tolist()))]
        texts, parts = sorted(set(each[: len(cool)])), sorted(set(each[len(cool) :]))
        number = dict(zip(texts, range(len(texts)))), dict(zip(parts, range(len(texts), len(texts) + len(parts))))
        which = np.concatenate([np.fromiter(map(n.__getitem__, x), np.int64, len(x)) for n, x in zip(number, (each[: len(cool)], each[len(cool) :]))])
        hash_ = np.empty(len(texts) + len(parts), np.uint64)
        hash_[which[: len(cool)]] = self.hash[cool]
        hash_[len(texts) :] = [xxhash.xxh64_intdigest(x[x[-2] : x[-2] + x[-1]]) for x in parts]
        sample = np.empty(len(hash_), np.int64)
        sample[which] = np.arange(len(each))
        return Stretches(first, doc, texts + [x[:-2] for x in parts], which, place[sample], size[sample], hash_)


@dataclass
class Stretches:
    """Runs of windows (the first window, the document), and their distinct stretches (text, where the gram is, its size and hash)."""

    first: np.ndarray
    doc: np.ndarray
    distinct: list[bytes]
    which: np.ndarray  # each run's stretch
    at: np.ndarray
    size: np.ndarray
    hash: np.ndarray


def settled(groups: list[tuple[int, list[tuple[bytes, int, int]]]]) -> list[list[np.ndarray]]:
    """``settle`` for groups with the size of their gram, large ones by parts."""
    if len(groups) == 1 and sum(len(s) - groups[0][0] + 2 for s, _, _ in groups[0][1]) > MOST_SYMBOLS and groups[0][0] < LENGTH - 1:
        gram, group = groups[0]
        parts: dict[tuple[int, bytes], dict[tuple[bytes, int], int]] = {}
        where = []  # of each stretch: (windows from, to, part, part's stretch)
        for text, at, low in group:
            pieces = []
            for before in range(0, LENGTH - gram + 1, 2):
                most = min(before + 1, LENGTH - gram)
                f, z = max(0, at - most), min(len(text) - LENGTH, at - before)
                if f <= z:
                    n = LENGTH - (most - before)
                    key, piece = (before, text[at - before : at - before + n]), (text[f : z + LENGTH], at - before - f)
                    part = parts.setdefault(key, {})
                    part[piece] = min(part.get(piece, low), low)
                    pieces.append((f, z + 1, key, piece))
            where.append(pieces)
        found = {}
        for key, part in parts.items():
            entries = [(text, at, low) for (text, at), low in part.items()]
            found[key] = dict(zip(part, settled([(len(key[1]), entries)])[0]))
        out = []
        for (text, _, _), pieces in zip(group, where):
            least = np.empty(len(text) - LENGTH + 1, np.int64)
            for f, z, key, piece in pieces:
                least[f:z] = found[key][piece]
            out.append(least)
        return [out]
    return settle(groups)


def settle(groups: list[tuple[int, list[tuple[bytes, int, int]]]]) -> list[list[np.ndarray]]:
    """For groups of distinct stretches (text, place of the shared gram, smallest doc_id), each with the size of its gram: for each window of each stretch the smallest doc_id that has it.

    The gram, with what follows it in all of a group's stretches, is one symbol; windows begin at it or before it.
    """
    symbols: list[int] = []
    start, doc, sizes, ats, folded = [], [], [], [], []
    between = 256 + len(groups)
    for k, (gram, group) in enumerate(groups):
        more = gram + len(commonprefix([text[at + gram :] for text, at, _ in group]))
        for text, at, low in group:
            start.append(len(symbols))
            sizes.append(len(text) - LENGTH + 1)
            doc.append(low)
            ats.append(at)
            folded.append(more)
            symbols += text[:at]
            symbols.append(256 + k)
            symbols += text[at + more :]
            symbols.append(between)
    symbols.append(-1)
    n = np.array(sizes)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.array(start), n) + place
    before = np.repeat(np.array(ats), n) - place
    # symbols of a window: its bytes before the gram, the gram, and its bytes behind what all have
    need = before + 1 + np.maximum(0, LENGTH - before - np.repeat(np.array(folded), n))
    width = LENGTH - min(gram for gram, _ in groups) + 1
    text = np.array(symbols, np.int64)
    valid = np.full(len(symbols), -1, np.int64)
    valid[starts] = np.arange(len(starts))
    order = valid[np.array(suffix_array(text))]
    order = order[order >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.full(width, -1)]).astype(np.int32), width)[starts[order]]
    rows[np.arange(width) >= need[order, None]] = -2
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    owner = np.repeat(np.array(doc, np.int64), n)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
    out = np.empty(len(starts), np.int64)
    out[order] = least[np.cumsum(new) - 1]
    each = np.split(out, np.cumsum(n)[:-1])
    answer, i = [], 0
    for _, group in groups:
        answer.append(each[i : i + len(group)])
        i += len(group)
    return answer


CHUNKS = "flush long, n_bytes long, sizes binary, ids binary, data binary"
MESSAGE = [("flush", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())]
MESSAGE_DDL = "flush long, bucket int, data binary"


@cache
def _zstd() -> tuple:
    """This worker's compressor and decompressor."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _zip(*parts: bytes) -> bytes:
    return _zstd()[0].compress(b"".join(parts))


def _unzip(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def _sent(work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, bytes]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``work``'s messages (flush, bucket, data) in batches of about BATCH_BYTES."""

    def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), MESSAGE)], schema=pa.schema(MESSAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for row in work(batches):
            rows.append(row)
            n += len(row[2])
            if n >= BATCH_BYTES:
                yield batch(rows)
                rows, n = [], 0
        if rows:
            yield batch(rows)

    return tidy(run)


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        flush = TaskContext.get().partitionId() << 32
        zip_ = zstandard.ZstdCompressor(level=3)
        held: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal flush, n
            data, sizes, ids = b"".join(x[0] for x in held), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            row = pa.RecordBatch.from_arrays([pa.array([flush]), pa.array([len(data)]), pa.array([sizes.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([zip_.compress(data)], pa.binary())], ["flush", "n_bytes", "sizes", "ids", "data"])
            flush, n = flush + 1, 0
            held.clear()
            return row

        for batch in batches:
            text = batch.column("text")
            size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            group = (np.cumsum(size) - size + n) // CHUNK_BYTES
            for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1):
                if not len(part):
                    continue
                if n >= CHUNK_BYTES or held and n + int(size[part].sum()) > 2 * CHUNK_BYTES:
                    yield close()
                piece = text.slice(int(part[0]), len(part)).to_pylist()
                held.append((b"".join(piece), size[part], ids[part]))
                n += len(held[-1][0])
        if held:
            yield close()

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    return written(src.mapInArrow(tidy(pack), CHUNKS), "chunks")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, [(flush, data), ...]) from messages sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for f, b, d in zip(*(batch.column(c).to_pylist() for c in ("flush", "bucket", "data"))):
            if b != bucket:
                if held:
                    yield bucket, held
                bucket, held = b, []
            held.append((f, d))
    if held:
        yield bucket, held


def _met(chunks: DataFrame, *messages: DataFrame) -> DataFrame:
    """Each chunk followed by the messages for it (kind 1, 2, ...)."""
    out = chunks.select("flush", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "sizes", "ids", "data")
    for k, m in enumerate(messages, 1):
        out = out.unionByName(m.select("flush", F.lit(k).alias("kind"), "bucket", F.lit(None).cast("binary").alias("sizes"), F.lit(None).cast("binary").alias("ids"), "data"))
    return out


def _gathered(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[tuple[int, Chunk, list[dict[int, bytes]]]]:
    """(flush, chunk, messages by bucket for each kind) from rows sorted by flush and kind."""
    flush, head, got = None, None, None
    for batch in batches:
        data = batch.column("data")
        for r, (f, kind, bucket) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("flush", "kind", "bucket")))):
            if kind == 0:
                if flush is not None:
                    yield flush, Chunk(*head), got
                flush, head, got = f, tuple(batch.column(c)[r].as_py() for c in ("data", "sizes", "ids")), [{} for _ in range(kinds)]
            else:
                got[kind - 1][bucket] = data[r].as_py()
    if flush is not None:
        yield flush, Chunk(*head), got


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed spans (start, end in bytes) for each row, and with ``keep_text`` the remaining bytes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chunks = _chunks(docs, id_col, text_col)
    total = chunks.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).first()
    parts = max(1, min(total["n"], MOST_PARTITIONS))
    many = max(8, int((total["b"] or 0) // CHUNK_BYTES) + 1)
    buckets = min(many, max(FEW_BUCKETS, many // PARTS), MOST_BUCKETS)
    bucket_parts = -(-many // buckets)

    def send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            for r in range(batch.num_rows):
                c = Chunk(*(batch.column(n)[r].as_py() for n in ("data", "sizes", "ids")))
                flush = batch.column("flush")[r].as_py()
                for bucket, at, _ in c.dealt(c.distinct, buckets):
                    h = (c.distinct[at] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                    yield flush, bucket, h.tobytes()

    def find_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for b, messages in _by_bucket(batches):
            raw = np.frombuffer(b"".join(d for _, d in messages), np.uint8).reshape(-1, 5)
            shared, hot = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
            # a large bucket by ranges of the highest byte
            step = max(1, 256 * RANGE_HASHES // max(1, len(raw)))
            for lo in range(0, 256, step):
                at = np.flatnonzero((raw[:, 4] >= lo) & (raw[:, 4] < lo + step)) if step < 256 else np.arange(len(raw))
                h = np.zeros((len(at), 8), np.uint8)
                h[:, :5] = raw[at]
                h = h.view("<u8").ravel()
                order = np.argsort(h)
                same = h[order][1:] == h[order][:-1]
                twice = np.zeros(len(h), bool)
                twice[1:] = same
                twice[:-1] |= same
                shared[at[order]] = twice
                runs_ = np.flatnonzero(np.concatenate([[True], ~same, [True]])) if len(h) else np.zeros(1, np.int64)
                many = np.diff(runs_)
                hot[at[order]] = np.repeat(many > HOT_CHUNKS, many)
            at = 0
            for f, d in messages:
                here = np.flatnonzero(hot[at : at + len(d) // 5]).astype("<u4")
                yield f, b, np.array([len(here)], "<u4").tobytes() + here.tobytes() + np.packbits(shared[at : at + len(d) // 5], bitorder="little").tobytes()
                at += len(d) // 5

    masks = written(chunks.select("flush", "sizes", "ids", "data").mapInArrow(_sent(send_hashes), MESSAGE_DDL).repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(_sent(find_shared), MESSAGE_DDL), "masks")

    def send_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for flush, c, (mask,) in _gathered(batches, 1):
            c.mark(buckets, mask)
            x = c.stretches()
            if not x.distinct:
                continue
            owner = c.ids[x.doc]
            low, high = np.full(len(x.distinct), NO_ID), np.full(len(x.distinct), np.iinfo(np.int64).min)
            np.minimum.at(low, x.which, owner)
            np.maximum.at(high, x.which, owner)
            size = np.fromiter(map(len, x.distinct), np.int64, len(x.distinct))
            several = low < high
            for bucket, picks, cuts in c.dealt(x.hash, buckets, bucket_parts):
                parts_ = []
                for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
                    pick = picks[a:z]
                    parts_.append(_zip(np.array([z - a], "<u4").tobytes(), size[pick].astype("<u2").tobytes(), x.at[pick].astype("u1").tobytes(), x.size[pick].astype("u1").tobytes(), several[pick].tobytes(), low[pick].astype("<i8").tobytes(), *map(x.distinct.__getitem__, pick.tolist())) if a < z else b"")
                yield flush, bucket, np.array([*map(len, parts_)], "<u4").tobytes() + b"".join(parts_)

    def order_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for b, messages in _by_bucket(batches):
            ends = [4 * bucket_parts + np.cumsum(np.frombuffer(d, "<u4", bucket_parts), dtype=np.int64) for _, d in messages]
            before = dict.fromkeys((f for f, _ in messages), 0)  # stretches in the parts before
            found: list[np.ndarray] = []
            for k in range(bucket_parts):
                part = [(f, d[(e[k - 1] if k else 4 * bucket_parts) : e[k]]) for (f, d), e in zip(messages, ends)]
                found += order_part([x for x in part if x[1]], before)
            if found:
                flush, *cols = map(np.concatenate, zip(*found))
                by = np.argsort(flush, kind="stable")
                for at in np.split(by, np.flatnonzero(np.diff(flush[by])) + 1):
                    yield int(flush[at[0]]), b, _zip(np.array([len(at)], "<u4").tobytes(), *(x[at].tobytes() for x in cols))

    def order_part(messages: list[tuple[int, bytes]], before: dict[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
        """(flush, stretch, first window, end, smallest doc_id), and the stretches of each message are added to ``before``."""
        groups: dict[bytes, dict[tuple[bytes, int], list]] = {}
        for f, d in messages:
            d = _unzip(d)
            n = int.from_bytes(d[:4], "little")
            base = before[f]
            before[f] += n
            size = np.frombuffer(d, "<u2", n, 4).tolist()
            at, gram, several = (d[4 + k * n : 4 + (k + 1) * n] for k in (2, 3, 4))
            low = np.frombuffer(d, "<i8", n, 4 + 5 * n).tolist()
            p = 4 + 13 * n
            for i in range(n):
                s = d[p : p + size[i]]
                p += size[i]
                g = groups.setdefault(s[at[i] : at[i] + gram[i]], {})
                e = g.get((s, at[i]))
                if e is None:
                    g[s, at[i]] = [low[i], several[i], [(f, base + i)]]
                else:
                    e[1] = e[1] or low[i] != e[0]
                    e[0] = min(e[0], low[i])
                    e[2].append((f, base + i))
        answers: list[tuple[int, int, int, int, int]] = []
        block: list[tuple[int, dict]] = []
        symbols = 0

        def order_block() -> None:
            for (_, g), found in zip(block, settled([(k, [(s, at, e[0]) for (s, at), e in g.items()]) for k, g in block])):
                for (low, several, refs), least in zip(g.values(), found):
                    cuts = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
                    for a, z in zip(cuts, cuts[1:]):
                        v = int(least[a])
                        if several or v < low:
                            for f, i in refs:
                                answers.append((f, i, a, z, v))

        for gram, g in groups.items():
            if len(g) == 1:
                # a group of one stretch is in order already
                ((s, _), (low, several, refs)), = g.items()
                if several:
                    for f, i in refs:
                        answers.append((f, i, 0, len(s) - LENGTH + 1, low))
                continue
            more = sum(len(s) for s, _ in g) - (len(gram) - 2) * len(g)
            if block and symbols + more > BLOCK_SYMBOLS:
                order_block()
                block, symbols = [], 0
            block.append((len(gram), g))
            symbols += more
        if block:
            order_block()
        if answers:
            yield tuple(np.array(x, t) for x, t in zip(zip(*answers), ("<i8", "<u4", "<u1", "<u1", "<i8")))

    marked = _met(chunks, masks).repartition(parts, "flush").sortWithinPartitions("flush", "kind")
    answers = marked.mapInArrow(_sent(send_stretches), MESSAGE_DDL).repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(_sent(order_groups), MESSAGE_DDL)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))] + [("kept", pa.binary())] * keep_text

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, (mask, answer) in _gathered(batches, 2):
            c.mark(buckets, mask)
            edge = np.zeros(len(c.text) + 1, np.int64)
            if answer:
                x = c.stretches()
                by = np.argsort(x.which, kind="stable")
                first = np.searchsorted(x.which[by], np.arange(len(x.distinct) + 1))
                for bucket, pick, _ in c.dealt(x.hash, buckets, bucket_parts):
                    d = answer.get(bucket)
                    if d is None:
                        continue
                    d = _unzip(d)
                    n = int.from_bytes(d[:4], "little")
                    i, a, z, low = (np.frombuffer(d, t, n, 4 + o * n).astype(np.int64) for t, o in (("<u4", 0), ("<u1", 4), ("<u1", 5), ("<i8", 6)))
                    s = pick[i]
                    many = first[s + 1] - first[s]
                    run = by[np.repeat(first[s] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    a, z, low = np.repeat(a, many), np.repeat(z, many), np.repeat(low, many)
                    gone = low < c.ids[x.doc[run]]
                    start = x.first[run][gone]
                    np.add.at(edge, start + a[gone], 1)
                    np.add.at(edge, start + z[gone] - 1 + LENGTH, -1)
            out = np.cumsum(edge[:-1]) > 0
            rows: list[list] = [[] for _ in fields]
            for k, (lo, hi) in enumerate(zip(c.ends[:-1].tolist(), c.ends[1:].tolist())):
                m = out[lo:hi]
                whole = c.bytes[lo:hi]
                if m.any():
                    e = np.flatnonzero(np.diff(np.concatenate([[0], m, [0]])))
                    spans, kept = e.reshape(-1, 2).tolist(), c.text[lo:hi][~m].tobytes()
                else:
                    spans, kept = [], whole
                got = (None if c.ids[k] == NO_ID else int(c.ids[k]), hi - lo, hi - lo - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept)
                for x, v in zip(rows, got):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(rows, fields)], schema=pa.schema(fields))

    covered = _met(chunks, masks, answers).repartition(parts, "flush").sortWithinPartitions("flush", "kind")
    return covered.mapInArrow(tidy(cover), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", kept binary" * keep_text)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")
