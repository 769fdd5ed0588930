"""Operators on text and vectors, by words and numbers or by a provider."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import provider as P
from ..functions.measures import cosine
from ..functions.text import bound, ngram_hashes, ngrams, tokens
from ..sources import written

#: Column names that hold the text of a row, the best first.
TEXT_NAMES = ("reviewText", "text", "review", "content", "description", "body", "comment")


def text_column(df: DataFrame) -> str | None:
    """The column that holds a row's text: a known name, else the longest mean of the first twenty rows."""
    from .relational import text_columns

    names = text_columns(df)
    for n in TEXT_NAMES:
        for c in names:
            if c.lower() == n.lower():
                return c
    if not names:
        return None
    means = df.select(*names).limit(20).agg(*(F.avg(F.length(c)).alias(c) for c in names)).first()
    return max(names, key=lambda c: (means[c] or 0.0, -names.index(c)))


def all_words(text: Column, words: Sequence[str]) -> Column:
    """Whether a text has all of these words; no Python is needed for it."""
    have = tokens(text)
    out = F.lit(bool(words))
    for w in words:
        out = out & F.array_contains(have, w.lower())
    return out


def semantic_filter(df: DataFrame, column: str, condition: str, provider: P.Provider | None = None, votes: int = 1) -> DataFrame:
    """Rows of which the provider says, in more than half of its votes, that the condition holds."""
    provider = provider or P.OfflineProvider()
    native = P.as_column(provider, F.col(column), condition)
    if native is not None:  # all votes of a column are one vote
        return df.filter(native)
    if votes == 1:
        return df.filter(P.holds(provider, F.col(column), condition))
    marks = [P.holds(provider, F.col(column), condition).cast("int") for _ in range(votes)]
    return df.filter(sum((F.coalesce(m, F.lit(0)) for m in marks), F.lit(0)) > votes / 2)


def labelled(df: DataFrame, column: str, labels: Sequence[str], name: str = "category", provider: P.Provider | None = None, keep_unknown: bool = False) -> DataFrame:
    """A label for each row; rows without one go unless ``keep_unknown``."""
    out = df.withColumn(name, P.label(provider or P.OfflineProvider(), F.col(column), labels))
    return out if keep_unknown else out.filter(F.col(name).isNotNull())


def compound(text: Column) -> Column:
    """How positive a text is, from -1 to 1: s / sqrt(s * s + 15) of the words of praise less those of blame."""
    value = F.create_map(*(F.lit(x) for w in P.PRAISE for x in (w, 1)), *(F.lit(x) for w in P.BLAME for x in (w, -1)))
    loaded = F.filter(tokens(text), lambda w: w.isin(*P.PRAISE, *P.BLAME))  # one look-up of a hash for each word
    s = F.aggregate(loaded, F.lit(0), lambda a, w: a + F.coalesce(value[w], F.lit(0)))
    return bound(s, lambda v: v / F.sqrt(v * v + F.lit(15.0)))


def sentiment(text: Column) -> Column:
    """positive from a compound score of 0.05 on, negative down from -0.05, else neutral."""
    return bound(compound(text), lambda s: F.when(s >= 0.05, "positive").when(s <= -0.05, "negative").when(s.isNotNull(), "neutral"))


#: Rows of one call of a provider that aggregates, and partial results of one call that unites them.
ROWS_A_CALL, PARTS_A_CALL = 200, 50


def model_aggregate(df: DataFrame, question: str, provider: P.Provider, plain: DataFrame) -> DataFrame:
    """A table that a provider makes of all rows; ``plain`` where a call fails or gives no JSON array of objects.

    Each call sees ``ROWS_A_CALL`` rows and answers with an array of partial results; up to ``PARTS_A_CALL`` of these are united by a call,
    and so on in rounds until there is one. Rows leave their task as partial results only. Columns are strings, numbers or booleans as in the answer.
    """
    spark = df.sparkSession
    json_rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("row"))

    def ask(what: str, size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[str] = []

            def call() -> pa.RecordBatch:
                try:
                    got = P.read_json(provider.complete(f"{what}\nQuestion: {question}\nAnswer with a JSON array of objects only.\n[{','.join(held)}]"))
                    got = json.dumps(got) if isinstance(got, list) and all(isinstance(x, dict) for x in got) else None
                except Exception:  # noqa: BLE001  a call that fails makes the whole result the plain one
                    got = None
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([got], pa.string())], ["row"])

            for batch in batches:
                for row in batch.column("row").to_pylist():
                    held.append(row)
                    if len(held) == size:
                        yield call()
            if held:
                yield call()

        return run

    parts = written(json_rows.mapInArrow(ask("Aggregate these rows so that parts can be united.", ROWS_A_CALL), "row string"), "parts")
    while True:
        state = parts.agg(F.count("*").alias("n"), F.sum(F.col("row").isNull().cast("int")).alias("bad")).first()
        if not state["n"] or state["bad"]:
            return plain
        if state["n"] == 1:
            break
        parts = written(parts.repartition(max(1, state["n"] // PARTS_A_CALL)).mapInArrow(ask("Unite these partial results of one aggregation.", PARTS_A_CALL), "row string"), "parts")
    rows = json.loads(parts.first()["row"])
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        return plain

    def kind(name: str) -> str:
        seen = {type(r[name]) for r in rows if r.get(name) is not None}
        return "boolean" if seen == {bool} else "long" if seen == {int} else "double" if seen and seen <= {int, float} else "string"

    kinds = {n: kind(n) for n in names}
    make = {"boolean": bool, "long": int, "double": float, "string": lambda v: v if isinstance(v, str) else json.dumps(v)}
    return spark.createDataFrame([tuple(None if r.get(n) is None else make[kinds[n]](r[n]) for n in names) for r in rows], ", ".join(f"`{n}` {kinds[n]}" for n in names))


def rated(df: DataFrame, column: str, question: str, name: str = "score", provider: P.Provider | None = None) -> DataFrame:
    """A score for each row; rows without one go."""
    return df.withColumn(name, P.score(provider or P.OfflineProvider(), F.col(column), question)).filter(F.col(name).isNotNull())


def vector_search(df: DataFrame, column: str, query: Sequence[float], k: int, tie: str) -> DataFrame:
    """The ``k`` rows most similar to a vector, by exact cosine; a top-k in each task, then one of those."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.withColumn("similarity", cosine(F.col(column), q)).orderBy(F.desc("similarity"), tie).limit(k)


def _occurrences(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda t: t == word))


def text_search(df: DataFrame, column: str, question: str, k: int | None = None, tie: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows that have a word of the question, by BM25 over the whole table. Only a few sums reach the driver."""
    wanted = [w for w in dict.fromkeys(P.words(question)) if w not in P.PLAIN]
    ws = tokens(F.col(column))
    tf = df.withColumn("words_", F.size(ws)).withColumns({f"tf_{i}_": _occurrences(ws, w) for i, w in enumerate(wanted)})
    stats = tf.agg(F.count("*").alias("n"), F.avg("words_").alias("mean"), *(F.sum((F.col(f"tf_{i}_") > 0).cast("int")).alias(f"df_{i}") for i in range(len(wanted)))).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        seen = stats[f"df_{i}"] or 0
        idf = math.log(1 + (stats["n"] - seen + 0.5) / (seen + 0.5))
        f = F.col(f"tf_{i}_")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("words_") / (stats["mean"] or 1.0)))
    out = tf.withColumn("relevance", score).filter(F.col("relevance") > 0).drop("words_", *(f"tf_{i}_" for i in range(len(wanted))))
    return out.orderBy(F.desc("relevance"), *([tie] if tie else [])).limit(k) if k is not None else out


#: Vectors in a block, and the bytes of blocks that are sent to all tasks at most.
BLOCK_ROWS, MOST_BROADCAST = 2048, 64 << 20


def _blocks(df: DataFrame, id_col: str, vec: str, n: int) -> DataFrame:
    """(block, dim, ids, vecs): vectors in blocks of about ``BLOCK_ROWS``."""
    many = max(1, math.ceil(n / BLOCK_ROWS))
    rows = df.filter(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    packed = rows.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(many)).cast("int").alias("block"), F.size("v").alias("dim")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return packed.select("block", "dim", F.col("r.id").alias("ids"), F.col("r.v").alias("vecs"))


def _met(left: DataFrame, right: DataFrame, right_rows: int, dim: int, same: bool = False) -> DataFrame:
    """Each pair of blocks with one dimension once: by an equality join, in which small right sides, by their size, are broadcast."""
    many = max(1, math.ceil(right_rows / BLOCK_ROWS))
    left.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    to = F.explode(F.sequence(F.col("block") if same else F.lit(0), F.lit(many - 1)))
    a = left.select("block", "dim", F.col("ids").alias("ids_a"), F.col("vecs").alias("vecs_a"), to.alias("to"))
    b = right.select(F.col("block").alias("to"), "dim", F.col("ids").alias("ids_b"), F.col("vecs").alias("vecs_b"))
    small = right_rows * max(1, dim) * 8 <= MOST_BROADCAST
    return a.join(F.broadcast(b) if small else b, ["to", "dim"]).select((F.col("block") == F.col("to")).alias("own"), "ids_a", "vecs_a", "ids_b", "vecs_b")


def _unit(values: pa.ListScalar) -> np.ndarray:
    """Vectors of length 1; without a length, or with nulls, not numbers."""
    x = values.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    with np.errstate(all="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dim(df: DataFrame, vec: str) -> int:
    first = df.select(F.size(vec)).filter(F.col(vec).isNotNull()).first()
    return first[0] if first else 1


def similarity_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vec: str, threshold: float, same: bool = False, miss: float = 0.0) -> DataFrame:
    """(left_id, right_id, similarity) of pairs with at least that cosine; for ``same`` tables each pair once.

    All pairs are compared, as products of blocks of vectors; only pairs that reach the threshold leave a task. With ``miss`` above 0 signs of random projections make
    keys instead, in so many tables that a pair at the threshold meets in none of them with that probability; the number of signs follows the
    rows, and where keys would make no fewer pairs than there are, blocks are compared after all.
    """
    n, m, dim = left.count(), right.count(), _dim(left, vec)
    if miss:
        angle = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        needed = lambda bits: max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - (1 - angle) ** bits)))) if angle < 1 else 1 << 40
        tables, bits = min(((needed(b), b) for b in range(2, 24) if needed(b) <= 256), key=lambda x: x[0] / 2.0 ** x[1], default=(1, 0))
        if tables < 2 ** (bits - 2):
            return _keyed_join(left, right, left_id, right_id, vec, threshold, same, projection_keys(dim, tables, bits))
    kinds = [dict(d.dtypes)[i] for d, i in ((left, left_id), (right, right_id))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ia, va, ib, vb in zip(*(batch.column(c) for c in ("own", "ids_a", "vecs_a", "ids_b", "vecs_b"))):
                s = _unit(va) @ _unit(vb).T
                r, c = np.nonzero(s >= threshold)
                a, b, s = ia.values.take(pa.array(r)), ib.values.take(pa.array(c)), s[r, c]
                if same:
                    low, first = pc.less(a, b), pc.min_element_wise(a, b)
                    a, b = first, pc.max_element_wise(a, b)
                    keep = low if own.as_py() else pc.not_equal(a, b)
                    a, b, s = a.filter(keep), b.filter(keep), s[keep.to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([a, b, pa.array(s)], ["left_id", "right_id", "similarity"])

    blocks = _blocks(left, left_id, vec, n)
    met = _met(blocks, blocks if same else _blocks(right, right_id, vec, m), n if same else m, dim, same)
    return met.mapInArrow(compare, f"left_id {kinds[0]}, right_id {kinds[1]}, similarity double")


def _keyed_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vec: str, threshold: float, same: bool, keys) -> DataFrame:
    a, b = (d.select(F.col(i).alias("id"), F.explode(keys(F.col(vec))).alias("key")) for d, i in ((left, left_id), (right, right_id)))
    met = a.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & ((F.col("a.id") < F.col("b.id")) if same else F.lit(True)))
    pairs = met.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()  # ids only; vectors come once a pair
    pairs = pairs.join(left.select(F.col(left_id).alias("left_id"), F.col(vec).alias("v_l")), "left_id").join(right.select(F.col(right_id).alias("right_id"), F.col(vec).alias("v_r")), "right_id")
    return pairs.select("left_id", "right_id", cosine(F.col("v_l"), F.col("v_r")).alias("similarity")).filter(F.col("similarity") >= threshold)


def projection_keys(dim: int, tables: int, bits: int, seed: int = 7):
    """A column function: for each table the table's number and the signs of ``bits`` random projections."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = 1 << np.arange(bits)

    @F.pandas_udf("array<long>")
    def keys(vecs: pd.Series) -> pd.Series:
        ok = [v is not None and len(v) == dim for v in vecs]
        x = np.array([v if k else np.zeros(dim) for v, k in zip(vecs, ok)], np.float64).reshape(-1, dim)
        code = ((x @ planes >= 0).reshape(-1, tables, bits) * weights).sum(axis=2) + (np.arange(tables) << bits)
        return pd.Series([c if k else [] for c, k in zip(code, ok)])

    return keys


def nearest(df: DataFrame, id_col: str, vec: str, k: int, queries: Column) -> DataFrame:
    """(query_id, rank, id): the k rows most similar to each row of ``queries``, exactly, ties (to twelve places) to the smaller id.

    Blocks of rows meet blocks of queries; k rows of a block for each query leave a task.
    """
    asked = df.filter(queries)
    n, m, kind = df.count(), asked.count(), dict(df.dtypes)[id_col]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ia, va, ib, vb in zip(*(batch.column(c) for c in ("ids_a", "vecs_a", "ids_b", "vecs_b"))):
                ids, asks = ia.values.to_numpy(zero_copy_only=False), ib.values.to_numpy(zero_copy_only=False)
                s = np.nan_to_num(np.round(_unit(vb) @ _unit(va).T, 12), nan=-2.0)
                by_id = np.argsort(ids, kind="stable")
                s, ids = s[:, by_id], ids[by_id]
                s[asks[:, None] == ids[None, :]] = -3.0
                # stable, so that equal ones stay in the order of ids
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                r, c = np.repeat(np.arange(len(asks)), top.shape[1]), top.ravel()
                ok = s[r, c] > -3.0
                r, c = r[ok], c[ok]
                yield pa.RecordBatch.from_arrays([ib.values.take(pa.array(r)), ia.values.take(pa.array(by_id[c])), pa.array(s[r, c])], ["query_id", "id", "s_"])

    met = _met(_blocks(df, id_col, vec, n), _blocks(asked, id_col, vec, m), m, _dim(df, vec))
    found = met.mapInArrow(best, f"query_id {kind}, id {kind}, s_ double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s_"), "id"))).filter(F.col("rank") <= k).select("query_id", "rank", "id")


def shared_shingles(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str, words: int = 8) -> DataFrame:
    """(left_id, right_id, shared): how many different runs of words two texts share, for pairs that share one.

    Texts meet by the hashes of their runs; hashes of a small side, by their number, are broadcast, so that the other isn't shuffled. What meets
    is compared by the runs themselves. A row's id stands for its text: rows with one id and one text are one.
    """
    hashes = [d.select(F.col(i).alias(n), F.explode(F.array_distinct(ngram_hashes(tokens(F.col(t)), words))).alias("run")) for d, i, t, n in ((left, left_id, left_text, "left_id"), (right, right_id, right_text, "right_id"))]
    total = right.agg(F.sum(F.length(right_text))).first()[0] or 0  # about six signs a word, sixteen bytes a run
    met = hashes[0].join(F.broadcast(hashes[1]) if total * 16 / 6 <= MOST_BROADCAST else hashes[1], "run").select("left_id", "right_id").distinct()
    runs = lambda d, i, t, n: d.select(F.col(i).alias(f"{n}_id"), tokens(F.col(t)).alias(f"{n}_w"))
    both = met.join(runs(left, left_id, left_text, "left"), "left_id").join(runs(right, right_id, right_text, "right"), "right_id")
    pairs = both.groupBy("left_id", "right_id").agg(F.collect_set("left_w").alias("l"), F.collect_set("right_w").alias("r"))
    all_runs = lambda c: F.flatten(F.transform(c, lambda w: ngrams(w, words)))
    return pairs.select("left_id", "right_id", F.size(F.array_intersect(all_runs("l"), all_runs("r"))).cast("long").alias("shared")).filter("shared > 0")


def sentiment_pairs(df: DataFrame, group: str, order: str, label: str, same: bool = True) -> DataFrame:
    """(group, a, b): pairs of a group's rows, the earlier first, with the same label or with opposite ones."""
    a, b = (df.select(F.col(group).alias(f"g{n}"), F.col(order).alias(n), F.col(label).alias(f"l{n}")).filter(F.col(f"l{n}").isin("positive", "negative")) for n in ("a", "b"))
    eq = F.col("la") == F.col("lb")
    return a.join(b, (F.col("ga") == F.col("gb")) & (F.col("a") < F.col("b")) & (eq if same else ~eq)).select(F.col("ga").alias("group"), "a", "b")


def extract(df: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """A column for each rule (column, pattern): the pattern's first group, null without a match; ``$.path`` reads JSON."""
    cols = {}
    for name, (c, rule) in rules.items():
        x = F.get_json_object(F.col(c), rule) if rule.startswith("$") else F.regexp_extract(F.col(c), rule, 1)
        cols[name] = x if rule.startswith("$") else F.when(F.col(c).rlike(rule), x)
    return df.withColumns(cols)


#: Entities that patterns can name, by type.
ENTITY_RULES = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "URL": r"https?://[^\s<>\"]+",
    "MONEY": r"[$€£]\s?\d[\d,]*(?:\.\d+)?",
    "DATE": r"\d{4}-\d{2}-\d{2}",
    "QUANTITY": r"\d+(?:\.\d+)?",
}


def rule_matches(text: Column, kind: str) -> Column:
    """What the pattern of an entity type finds in a text. Addresses are looked for only where there is an @: their pattern begins anew at every letter."""
    found = F.regexp_extract_all(text, F.lit(ENTITY_RULES[kind]), 0)
    return F.when(F.contains(text, F.lit("@")), found).when(text.isNotNull(), F.array().cast("array<string>")) if kind == "EMAIL" else found


def entities(df: DataFrame, id_col: str, text: str, kinds: Sequence[str] = tuple(ENTITY_RULES)) -> DataFrame:
    """(id, kind, entity, n): what the patterns find in each text, and how often."""

    def of(kind: str) -> Column:
        return F.transform(rule_matches(F.col(text), kind), lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entity")))

    found = F.flatten(F.array(*map(of, kinds)))
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("e")).groupBy("id", "e.kind", "e.entity").agg(F.count("*").alias("n"))


def top_phrases(words: Column, k: int, sizes: Sequence[int]) -> Column:
    """(less, phrase): the ``k`` most frequent runs of so many words, ``less`` minus their number, ties to the smaller phrase."""

    def counted(runs: Column) -> Column:
        # equal runs lie together; each begins where its predecessor differs, and its place orders it as its words do
        begins = F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: (i == 0) | (F.get(runs, i) != F.get(runs, i - 1)))
        sizes = lambda at: F.transform(at, lambda b, j: F.struct((b - F.coalesce(F.get(at, j + 1), F.size(runs))).alias("less"), b.alias("b")))
        top = F.transform(F.slice(F.sort_array(bound(begins, sizes)), 1, k), lambda x: F.struct(x["less"].alias("less"), F.get(runs, x["b"]).alias("phrase")))
        return F.when(F.size(runs) > 0, top).otherwise(F.array().cast("array<struct<less:int,phrase:string>>"))

    # ``sort_array`` compares without a lambda
    return bound(words, lambda ws: bound(F.sort_array(F.concat(*(ngrams(ws, n) for n in sizes))), counted))


def key_phrases(df: DataFrame, id_col: str, text: str, k: int = 3, n: int = 2) -> DataFrame:
    """(id, phrase, n, rank): each row's most frequent runs of ``n`` words. Counted inside the row; nothing is shuffled."""
    top = top_phrases(tokens(F.col(text)), k, [n])
    return df.select(F.col(id_col).alias("id"), F.posexplode(top).alias("p_", "x_")).select("id", F.col("x_.phrase").alias("phrase"), (-F.col("x_.less")).cast("long").alias("n"), (F.col("p_") + 1).alias("rank"))


def topic_words(text: Column) -> Column:
    """Words that say something: not those of ``provider.PLAIN``."""
    return F.filter(tokens(text), lambda w: ~w.isin(*sorted(P.PLAIN)))


def topics(df: DataFrame, id_col: str, text: str, k: int = 3) -> DataFrame:
    """(id, topic, score, rank): each row's most frequent words and pairs of words, without those that say nothing, and their share of the row's words."""
    both = df.select(F.col(id_col).alias("id"), topic_words(F.col(text)).alias("w_"))
    out = both.select("id", F.size("w_").alias("all_"), F.posexplode(top_phrases(F.col("w_"), k, [1, 2])).alias("p_", "x_"))
    return out.select("id", F.col("x_.phrase").alias("topic"), F.round(-F.col("x_.less") / F.col("all_"), 4).alias("score"), (F.col("p_") + 1).alias("rank"))
