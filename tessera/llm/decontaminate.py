"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed choice of token positions; positions outside it are ignored, so a seed
still matches where a passage was changed there. Hashes of all masks at all positions of the
benchmark are joined with those of the documents; every pair of a document and an item with
a hit is verified on the hit's diagonal: the longest run of aligned tokens of which at least
``min_identity`` agree must have ``min_tokens`` tokens, or the item's whole length where that is less.
Items of fewer than ``SHORT`` tokens have masks of their own, with which no verified overlap is missed.

Of hits that follow each other on one diagonal only the first is expanded, so that repetitive texts
give as many pairs as they have diagonals. The benchmark side is read in slices of distinct texts whose
index has about ``INDEX_BYTES``, each broadcast once to the workers that scan the documents; however
large the benchmark, no slice grows, and no worker holds two.

Defined results: tokens are white-space separated, lower case, letters and digits only. Null
and empty texts on either side have no overlap, nor has a text shorter than the shortest seed
unless it is a whole item's length. Repeated rows each give rows of their own. Items with
equal texts are all reported. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, mix, steps, table, tidy, word_hashes, written

#: Each tolerates substitutions at its zeros; together any single one in a run of ten tokens.
MASKS = ("11101011", "1101100111", "1110010101001", "111111")
MIN_TOKENS = 13
MIN_IDENTITY = 0.8
#: Items of fewer tokens have their own masks, by length: a whole item with a fifth of its inner tokens changed keeps three in
#: a row, or two on each side of the middle one of five; below five none may be changed.
SHORT = 12
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",)} | dict.fromkeys(range(5, SHORT), ("111", "11011"))
#: Bytes of a slice's index, and how many of them a byte of text takes, about.
INDEX_BYTES, INDEX_SHARE = 96 << 20, 20
#: Pairs of a document's and an item's seed that are expanded at once.
MOST_PAIRS = 1 << 20

_WEIGHT = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def seed_hashes(words: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """For each mask the hashes at all positions where it fits."""
    span = max(map(len, masks))
    term = [words * _WEIGHT[o] for o in range(span)]
    out = []
    for k, m in enumerate(masks):
        n = max(0, len(words) - len(m) + 1)
        h = np.full(n, k + 1, np.uint64)
        for o, bit in enumerate(m):
            if bit == "1":
                h += term[o][o : o + n]
        out.append(mix(h) | np.uint64(1))  # never 0
    return out


def longest_run(same: np.ndarray, min_identity: float) -> tuple[int, int]:
    """The longest stretch of aligned tokens with at least that share equal (the first of equal length), without unequal ends."""
    hits = np.flatnonzero(same)
    if not len(hits):
        return 0, 0
    p = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - min_identity, -min_identity))])
    p = np.round(p * 1e6)  # exact ties
    best_from = np.maximum.accumulate(p[::-1])[::-1]
    ends = len(p) - 1 - np.searchsorted(best_from[::-1], p, side="left")
    ends = np.maximum(ends, np.arange(len(p)))
    a = int(np.argmax(ends - np.arange(len(p))))
    b = int(ends[a])
    inside = hits[(hits >= a) & (hits < b)]
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and each of its numbers, for ranges of ``n`` numbers from ``lo`` on."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(which))


class SeedIndex:
    """Seeds of a slice of the benchmark, sorted by their hash and that of the seed before them."""

    FILTER_BITS = 22

    def __init__(self, keys: list, texts: list, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY):
        self.min_tokens, self.min_identity = min_tokens, min_identity
        self.keys = keys
        self.words, self.ends = word_hashes(pa.array(texts, pa.string()))
        self.size = np.diff(self.ends)
        kinds = [SHORT_MASKS.get(n, masks) for n in range(SHORT + 1)]  # by an item's tokens
        kinds[0] = ()
        owner = np.repeat(np.arange(len(texts)), self.size)
        kind = np.minimum(self.size, SHORT)
        self.masks = tuple(dict.fromkeys(m for k in np.unique(kind).tolist() for m in kinds[k]))
        hashes, before, at = [], [], []
        for m, h in zip(self.masks, seed_hashes(self.words, self.masks) if self.masks else []):
            ok = owner[: len(h)] == owner[len(m) - 1 : len(m) - 1 + len(h)]  # the seed lies in one item
            ok &= np.array([m in k for k in kinds])[kind[owner[: len(h)]]]
            pos = np.flatnonzero(ok)
            first = pos == self.ends[owner[pos]]
            hashes.append(h[pos]), before.append(np.where(first, np.uint64(0), h[pos - 1])), at.append(pos)
        none = np.zeros(0, np.uint64)
        h, back, pos = np.concatenate([none, *hashes]), np.concatenate([none, *before]), np.concatenate([np.zeros(0, np.int64), *at])
        order = np.lexsort((back, h))
        h, back = h[order], back[order]
        self.pos = pos[order].astype(np.int32)
        self.item = owner[self.pos].astype(np.int32)
        # groups of seeds with one hash and one seed before
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (back[1:] != back[:-1])]))
        self.hash, self.before = h[new], back[new]
        self.start = np.append(new, len(h)).astype(np.int32)
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[(self.hash >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)] = True

    def _hits(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (document, item, diagonal); the diagonal is where the item would begin in the document."""
        found = [np.zeros((0, 3), np.int64)]
        for m, h in zip(self.masks, seed_hashes(words, self.masks) if self.masks else []):
            at = np.flatnonzero(self.filter[(h >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hash, h[at]), np.searchsorted(self.hash, h[at], side="right")
            doc = np.searchsorted(ends, at, side="right") - 1
            fits = (hi > lo) & (at + len(m) <= ends[doc + 1])
            at, lo, hi, doc = at[fits], lo[fits], hi[fits], doc[fits]
            back = np.where(at > ends[doc], h[at - 1], np.uint64(2))  # 2: no hash
            load = np.cumsum(self.start[hi] - self.start[lo])
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(load // MOST_PAIRS)) + 1):
                which, g = _ranges(lo[part], (hi - lo)[part])
                which = part[which]
                begins = self.before[g] != back[which]  # else the seeds before are a hit on the same diagonal
                which, g = which[begins], g[begins]
                row, k = _ranges(self.start[g].astype(np.int64), (self.start[g + 1] - self.start[g]).astype(np.int64))
                which, item = which[row], self.item[k].astype(np.int64)
                diagonal = at[which] - ends[doc[which]] - (self.pos[k] - self.ends[item])
                found.append(np.unique(np.stack([doc[which], item, diagonal], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, tokens, equal tokens, first token in the text, in the item): the longest verified overlap of each pair."""
        words, ends = word_hashes(texts)
        best: dict[tuple[int, int], tuple] = {}
        hits = self._hits(words, ends)
        # items that must agree as a whole are compared all at once
        doc, item, diagonal = hits.T
        whole = (self.size[item] <= self.min_tokens) & (self.size[item] < SHORT)
        d, i, at = doc[whole], item[whole], diagonal[whole]
        fits = (at >= 0) & (at + self.size[i] <= np.diff(ends)[d])
        d, i, at = d[fits], i[fits], at[fits]
        equal, ends_agree = np.zeros(len(d), np.int64), np.ones(len(d), bool)
        for o in range(int(self.size[i].max(initial=0))):
            has = o < self.size[i]
            same = np.zeros(len(d), bool)
            same[has] = words[(ends[d] + at + o)[has]] == self.words[(self.ends[i] + o)[has]]
            equal += same
            ends_agree &= same | ~((o == 0) | (o == self.size[i] - 1))
        ok = ends_agree & (equal >= self.min_identity * self.size[i] - 1e-9)
        found = [zip(d[ok].tolist(), i[ok].tolist(), self.size[i][ok].tolist(), equal[ok].tolist(), at[ok].tolist(), [0] * int(ok.sum()))]
        for doc, item, diagonal in hits[~whole].tolist():
            t, q = words[ends[doc] : ends[doc + 1]], self.words[self.ends[item] : self.ends[item + 1]]
            first = max(0, -diagonal)
            n = min(len(q), len(t) - diagonal) - first
            need = min(self.min_tokens, len(q))
            if n < need:
                continue
            same = t[diagonal + first : diagonal + first + n] == q[first : first + n]
            a, b = longest_run(same, self.min_identity)
            if b - a >= need:
                found.append([(doc, item, b - a, int(same[a:b].sum()), diagonal + first + a, first + a)])
        for doc, item, *got in (x for part in found for x in part):
            old = best.get((doc, item))
            if old is None or (-got[0], -got[1], got[2], got[3]) < (-old[0], -old[1], old[2], old[3]):
                best[doc, item] = got
        return [(*k, *v) for k, v in sorted(best.items())]


def _slices(texts: DataFrame, make: Callable[[list, list], SeedIndex]) -> Iterator[SeedIndex]:
    """Indexes of bounded slices of the benchmark's distinct texts (k, t)."""
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + int(total * INDEX_SHARE // INDEX_BYTES)
    for k in range(n):
        rows = texts.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("k").collect()  # about INDEX_BYTES / INDEX_SHARE
        yield make([r["k"] for r in rows], [r["t"] for r in rows])


def _scanned(src: DataFrame, texts: DataFrame, key: str, make: Callable[[list, list], SeedIndex]) -> DataFrame:
    """``key`` of ``src`` (key, text), the number of a benchmark text, and the overlap's numbers, over all slices."""
    spark = src.sparkSession
    names = ("k", *OVERLAP)
    out = None
    for index in _slices(texts, make):
        held = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for step in steps(batch, "text"):
                    got = index.overlaps(step.column("text"))
                    if got:
                        cols = [step.column(key).take(pa.array([g[0] for g in got])), pa.array([index.keys[g[1]] for g in got], pa.int64()), *(pa.array([g[k] for g in got], pa.int64()) for k in (2, 3, 4, 5))]
                        yield pa.RecordBatch.from_arrays(cols, [key, *names])

        part = src.mapInArrow(tidy(scan), f"{key} long, " + ", ".join(f"{n} long" for n in names))
        out = part if out is None else out.unionByName(part)
    return out


OVERLAP = ("n_tokens", "n_equal", "doc_start", "item_start")


def _texts(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(k, t): the benchmark's distinct texts, numbered."""
    t = benchmark.select(F.col(f"`{text_col}`").alias("t")).filter("t is not null").distinct()
    return written(t.select(F.monotonically_increasing_id().alias("k"), "t"), "benchmark-texts")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """doc_id, item_id, n_tokens, n_equal, doc_start, item_start for each document and item that overlap."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    texts = _texts(benchmark, item_text_col)
    found = _scanned(src, texts, "doc_id", lambda i, t: SeedIndex(i, t, masks, min_tokens, min_identity))
    items = benchmark.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("t")).join(texts, "t").select("item_id", "k")
    return found.join(items, "k").select("doc_id", "item_id", *OVERLAP)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = _texts(benchmark, item_text_col)
    indexes = _slices(texts, SeedIndex)
    first = next(indexes)
    held, second = spark.sparkContext.broadcast(first), next(indexes, None)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text_col):
                ok = np.ones(step.num_rows, bool)
                ok[[g[0] for g in held.value.overlaps(step.column(text_col))]] = False
                yield step.filter(pa.array(ok))

    if second is None:
        return docs.mapInArrow(tidy(keep), docs.schema)
    # several slices: rows are numbered, each slice finds its numbers, and they are taken out together
    rows = written(docs.select(F.monotonically_increasing_id().alias("n_"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_")), "numbered")
    src = rows.select("n_", F.col(f"row_.`{text_col}`").alias("text")).filter("text is not null")
    gone = written(_scanned(src, texts, "n_", SeedIndex).select("n_").distinct(), "contaminated")
    return rows.join(gone, "n_", "left_anti").select("row_.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
