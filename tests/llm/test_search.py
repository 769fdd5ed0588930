import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.topk import BallTree, Best, exact_top_k, search


def brute(rows, k, asks):
    """(query, rank, id, score) with Python's integers."""
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v)
        ok[i] = min(ok.get(i, w), w)
    out = []
    for q in ok:
        if asks(q):
            s = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ok[q], v)))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


def found(df, k, asks):
    return sorted(tuple(r) for r in exact_top_k(df, k, is_query=asks, shard_rows=64).collect())


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(1, 6), st.integers(1, 5))
def test_tree_search_is_exact(seed, n, d, k):
    rng = np.random.default_rng(seed)
    x = rng.integers(-5, 6, (n, d))
    ids = rng.permutation(n)
    best = Best(n, k)
    search(BallTree(ids, x, leaf=8), x, ids, best)
    s = x @ x.T
    for q in range(n):
        want = sorted((-s[q, j], ids[j]) for j in range(n) if j != q)[:k]
        got = [(-best.score[q, c], best.id[q, c]) for c in range(k) if best.has[q, c]]
        assert got == want


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.standard_normal(8)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [0.0] * 8), (404, []), (450, []), (405, [1.0, 2.0]), (406, [1.0, 2.0]), (500, [1e300] * 8), (7, rows[7][1]), (8, rows[9][1]), (600, rows[50][1]), (601, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("rank", F.lit("x"))
    asks = lambda q: q % 50 == 0 or q in (405, 404)
    assert found(df, 5, (F.col("vec_id") % 50 == 0) | F.col("vec_id").isin(405, 404)) == brute(rows, 5, asks)


def test_empty_table_and_single_row(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert found(df, 5, F.lit(True)) == [] and found(df.limit(0), 5, F.lit(True)) == []
