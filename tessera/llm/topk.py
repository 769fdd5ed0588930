"""Exact top-k by inner product: a ball tree in each shard, searched by branch and bound.

1. Vectors are dealt to shards of bounded size by the hash of their id; each shard keeps
   its integer vectors with a ball tree over them (one row in the shared folder).
2. Each query is searched in its own shard, which gives a first k-th score.
3. Blocks of queries, each with its k-th score so far, visit the other shards. A node is
   entered only by queries whose upper bound q.c + |q| r there isn't below that score, and
   children in the order of that bound; the score rises as leaves are scored and is shared by all later nodes.
4. A query's best of all shards are ranked.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do rows without id. Vectors of different lengths have no score together. An empty
vector's scores are 0. A repeated id counts once, with its smallest vector. Scores beyond
64 bits saturate. Ties go to the smaller id. A query with no candidate gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bounded_batches, table, tidy, written

LEAF = 128
#: Vectors in a shard, about; a shard of 64 dimensions and 32-bit components has 17 MB.
SHARD_ROWS = 1 << 16
#: Queries that go through a shard together, and blocks of them that share a copy of it.
BLOCK_QUERIES = 2048
GROUP_BLOCKS = 64
LOWEST = np.iinfo(np.int64).min
HIGHEST = np.iinfo(np.int64).max


class BallTree:
    """Rows in leaf order; node i covers rows lo[i] to hi[i], its children are kids[i] (-1: leaf)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        f = x.astype(np.float64)
        lo, hi, kids, centre, radius = [], [], [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            node = len(lo)
            part = f[order[a:b]]
            c = part.mean(axis=0)
            away = np.sqrt(((part - c) ** 2).sum(axis=1))
            lo.append(a), hi.append(b), kids.append((-1, -1)), centre.append(c), radius.append(away.max())
            if parent is not None:
                p, side = parent
                kids[p] = (node, kids[p][1]) if side == 0 else (kids[p][0], node)
            if b - a <= leaf or away.max() == 0:
                continue
            # between the row farthest from the centre and the row farthest from that one
            one = part[away.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part @ (other - one), mid)]
            todo += [(a + mid, b, (node, 1)), (a, a + mid, (node, 0))]
        self.ids, self.x, self.f = ids[order], x[order], f[order]
        self.lo, self.hi, self.kids = lo, hi, kids
        self.centre, self.radius = np.array(centre), np.array(radius)


class Best:
    """The k best (score, id) so far of each query."""

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None):
        self.k = k
        self.score = np.full((n, k), LOWEST)
        self.id = np.full((n, k), HIGHEST)
        self.has = np.zeros((n, k), bool)
        self.floor = np.full(n, LOWEST) if kth is None else kth.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (query, score, id) in any order."""
        if not len(rows):
            return
        touched = np.unique(rows)
        at, slot = np.nonzero(self.has[touched])
        r = np.concatenate([rows, touched[at]])
        s = np.concatenate([scores, self.score[touched][at, slot]])
        i = np.concatenate([ids, self.id[touched][at, slot]])
        order = np.lexsort((i, ~s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        r, s, i, place = r[keep], s[keep], i[keep], place[keep]
        self.has[r, place], self.score[r, place], self.id[r, place] = True, s, i
        full = touched[self.has[touched, -1]]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products with Python's integers, saturated."""
    got = q.astype(object) @ x.astype(object).T
    return np.array([[max(LOWEST, min(HIGHEST, int(v))) for v in row] for row in got], np.int64).reshape(len(q), len(x))


def search(tree: BallTree, q: np.ndarray, q_ids: np.ndarray, best: Best) -> None:
    """Take the tree's rows into the queries' best; a query's own id is left out."""
    if not len(q) or not len(tree.ids):
        return
    d = max(1, q.shape[1])
    safe = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(tree.f).max(initial=0)) * d < 2**52
    qf = q.astype(np.float64)
    norm = np.sqrt((qf**2).sum(axis=1))

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        up = qf[active] @ tree.centre[node] + norm[active] * tree.radius[node]
        return up + 1e-9 * (np.abs(up) + norm[active] * (np.abs(tree.centre[node]).sum() + tree.radius[node])) + 1e-6

    def score(node: int, active: np.ndarray) -> None:
        a, b = tree.lo[node], tree.hi[node]
        s = (qf[active] @ tree.f[a:b].T).astype(np.int64) if safe else _exact(tree.x[a:b], q[active])
        r, c = np.nonzero((s >= best.floor[active][:, None]) & (tree.ids[a:b] != q_ids[active][:, None]))
        best.add(active[r], s[r, c], tree.ids[a:b][c])

    def visit(node: int, active: np.ndarray, up: np.ndarray) -> None:
        active = active[up >= best.floor[active]]
        if not len(active):
            return
        left, right = tree.kids[node]
        if left < 0:
            score(node, active)
            return
        ul, ur = bound(left, active), bound(right, active)
        first = ul >= ur
        visit(left, active[first], ul[first])
        visit(right, active, ur)
        visit(left, active[~first], ul[~first])

    # bounds have a margin far beyond what floats lose; only a leaf's scores need be exact
    everyone = np.arange(len(q))
    visit(0, everyone, bound(0, everyone))


def _small(x: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _rows(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array's numbers and lengths."""
    return values.flatten().to_numpy(zero_copy_only=False), values.value_lengths().to_numpy(zero_copy_only=False)


def _send(fields: list[tuple[str, pa.DataType]], **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in fields], schema=pa.schema(fields))


FOUND = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
PACKED = [("shard", pa.int32()), ("kind", pa.int32()), ("dim", pa.int32()), ("kth", pa.binary()), ("ids", pa.binary()), ("bytes_", pa.int32()), ("vecs", pa.binary())]
PACKED_DDL = "shard int, kind int, dim int, kth binary, ids binary, bytes_ int, vecs binary"


def _numbers(batch: pa.RecordBatch, r: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    dim = batch.column("dim")[r].as_py()
    ids = np.frombuffer(batch.column("ids")[r].as_py(), np.int64)
    vecs = np.frombuffer(batch.column("vecs")[r].as_py(), f"<i{batch.column('bytes_')[r].as_py()}").reshape(len(ids), dim)
    return dim, ids, vecs, np.frombuffer(batch.column("kth")[r].as_py() or b"", np.int64)


def _results(best: Best, q_ids: np.ndarray) -> pa.RecordBatch:
    r, c = np.nonzero(best.has)
    return _send(FOUND, query_id=q_ids[r], vec_id=best.id[r, c], score=best.score[r, c])


def exact_top_k(vectors: DataFrame, k: int, *, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the highest integer inner product for each row where ``is_query``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    e = F.col(f"`{vec_col}`")
    ok = F.col(f"`{id_col}`").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = vectors.filter(ok).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(e, lambda x: F.floor(x.cast("double") * 256)).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n = vectors.count()
    cores = spark.sparkContext.defaultParallelism
    n_shards = max(1, math.ceil(n / shard_rows), min(2 * cores, math.ceil(n / 2048)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards as rows of kind 0, queries of a shard as rows of kind 1."""
        held: dict[int, list] = {}
        at = None
        for batch in batches:
            flat, dims = _rows(batch.column("vec"))
            ends = np.cumsum(dims)
            ids, shard, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "shard", "asks"))
            for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1) if len(shard) else ():
                if at is not None and shard[part[0]] != at:  # sorted: one shard at a time
                    yield from close(at, held)
                    held = {}
                at = int(shard[part[0]])
                for dim in np.unique(dims[part]).tolist():
                    pick = part[dims[part] == dim]
                    held.setdefault(dim, []).append((ids[pick], _small(flat[(ends[pick] - dim)[:, None] + np.arange(dim)]), asks[pick]))
        if at is not None:
            yield from close(at, held)

    def close(shard: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        own = [(dim, *map(np.concatenate, zip(*held[dim]))) for dim in sorted(held)]
        seen: dict[int, tuple] = {}
        if len({*(i for x in own for i in x[1].tolist())}) < sum(len(x[1]) for x in own):
            for dim, ids, vecs, _ in own:  # repeated ids: the smallest vector stays
                for j, i in enumerate(ids.tolist()):
                    v = tuple(vecs[j].tolist())
                    seen[i] = min(seen.get(i, (v, dim)), (v, dim))
        for dim, ids, vecs, asks in own:
            if seen:
                keep, once = [], set()
                for j, i in enumerate(ids.tolist()):
                    if i not in once and seen[i] == (tuple(vecs[j].tolist()), dim):
                        keep.append(j)
                        once.add(i)
                ids, vecs, asks = ids[keep], vecs[keep], asks[keep]
            if not len(ids):
                continue
            one = _small(vecs)
            yield _send(PACKED, shard=[shard], kind=[0], dim=[dim], kth=[None], ids=[ids.tobytes()], bytes_=[one.itemsize], vecs=[one.tobytes()])
            q = np.flatnonzero(asks)
            for i in range(0, len(q), BLOCK_QUERIES):
                part = q[i : i + BLOCK_QUERIES]
                yield _send(PACKED, shard=[shard], kind=[1], dim=[dim], kth=[None], ids=[ids[part].tobytes()], bytes_=[one.itemsize], vecs=[one[part].tobytes()])

    dealt = src.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")).repartition(n_shards, "shard").sortWithinPartitions("shard")
    packs = written(dealt.mapInArrow(tidy(index), PACKED_DDL), "vector-shards")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column("shard")[r].as_py()
                dim, ids, vecs, _ = _numbers(batch, r)
                if batch.column("kind")[r].as_py() == 0:
                    trees = {x: t for x, t in trees.items() if x[0] == shard} | {(shard, dim): BallTree(ids, vecs)}
                    continue
                best = Best(len(ids), k)
                search(trees[shard, dim], vecs, ids, best)
                got = _results(best, ids)
                yield _send(HOME, shard=[shard], kind=[1], dim=[dim], kth=[best.floor.tobytes()], ids=[ids.tobytes()], bytes_=[vecs.itemsize], vecs=[vecs.tobytes()], **{c: [got.column(c)] for c in ("query_id", "vec_id", "score")})

    HOME = [*PACKED, *((c, pa.list_(t)) for c, t in FOUND)]
    sort = ("shard", "dim", "kind")
    home = written(packs.repartition(n_shards, "shard").sortWithinPartitions(*sort).mapInArrow(tidy(at_home), PACKED_DDL + ", query_id array<long>, vec_id array<long>, score array<long>"), "vector-home")

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                key = tuple(batch.column(c)[r].as_py() for c in ("shard", "group_", "dim"))
                dim, ids, vecs, kth = _numbers(batch, r)
                if batch.column("kind")[r].as_py() == 0:
                    at, tree = key, BallTree(ids, vecs)
                elif at == key:
                    best = Best(len(ids), k, kth)
                    search(tree, vecs, ids, best)
                    yield _results(best, ids)

    blocks = home.select(*(c for c, _ in PACKED))
    asked = blocks.agg(F.sum(F.length("ids") / 8).alias("n")).first()["n"] or 0
    n_groups = max(1, math.ceil(asked / (BLOCK_QUERIES * GROUP_BLOCKS)))
    visits = blocks.withColumn("group_", F.pmod(F.xxhash64("ids"), F.lit(n_groups)).cast("int")).withColumn("to_", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).filter(F.col("to_") != F.col("shard")).withColumn("shard", F.col("to_")).drop("to_")
    hosts = packs.filter("kind = 0").withColumn("group_", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    met = hosts.unionByName(visits).repartition(n_shards * n_groups, "shard", "group_").sortWithinPartitions("shard", "group_", "dim", "kind")
    far = met.mapInArrow(tidy(away), "query_id long, vec_id long, score long")
    near = home.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("z")).select("z.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), 5, is_query=F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, i, e[i] AS x FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM v)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY 1, 2
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT * FROM r WHERE "rank" <= 5
"""
