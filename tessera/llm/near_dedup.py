"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of shingles (runs of five words), each labelled with how often it
occurred before. A sketch takes the ``PICKS`` smallest of them under a hash and keeps them in text
order, so that it is sensitive to order as edit similarity is; ``ROWS`` sketches make a band
and documents that agree in one of ``BANDS`` bands share a bucket.

- Equal texts are one node from the start; only one of them is compared.
- In every bucket, whatever its size, all members are compared with its leader, the member that meets most
  others over all bands. What the links so far hold together needs no other link. Of the members x, y of one leader L that
  are still in different classes, a pair can only be similar if min(|x & L|, |y & L|) shingles would do for
  its lengths, or if x and y share a shingle that L lacks. Both kinds of pairs are found by equality joins, for each leader, and compared; all
  others can't be links, so that none is lost, no cap decides, and a group of thousands of copies isn't paired with itself. Of the shingles
  that L lacks only a member's rarest meet, as many as leave fewer than it must share.
- Similarity: aligned equal shingles m of the two sequences, m / (|a| + |b| - m), shingles by 64-bit hashes. The longest
  common subsequence is found within the band of diagonals that the threshold allows; labelled shingles occur
  once, so that it is a longest increasing run of places, in memory linear in the texts.
- Classes are the components of links with a similarity of at least ``MIN_SIMILARITY``.

Defined results: one row per input row; rows that share a doc_id are one document, so that each of their texts links it. A null doc_id has
a null class. Null texts and texts without a word are classes of their own. Fewer
than five words make one shingle. The class is the smallest doc_id in it. Columns other than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, bounded_batches, mix, shingles, steps, table, tidy, word_hashes, written
from .graph import components

WORDS = 5
MIN_SIMILARITY = 0.8
PICKS, ROWS, BANDS = 3, 2, 32
FILTER_BITS = 1 << 23

_FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with the number of equal ones before."""
    order = np.argsort(h, kind="stable")
    run = h[order]
    new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    if new.all():
        return h
    start = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    out = h.copy()
    again = np.arange(len(run)) - start
    out[order] = np.where(again > 0, mix(run + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), run)
    return out


def order_minhash(h: np.ndarray) -> np.ndarray:
    """The bands' hashes of a document's labelled shingles."""
    n = len(h)
    picks = min(PICKS, n)
    at = np.empty((len(_FACTORS), picks), np.int64)
    chunk = max(1, (1 << 19) // n)
    for i in range(0, len(_FACTORS), chunk):
        v = h[None, :] * _FACTORS[i : i + chunk, None]
        row = np.arange(len(v))
        for p in range(picks):
            best = v.argmin(axis=1)
            at[i : i + chunk, p] = best
            if p + 1 < picks:
                v[row, best] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at.sort(axis=1)
    sketch = np.zeros(len(_FACTORS), np.uint64)
    for p in range(picks):
        sketch = mix(sketch + h[at[:, p]])
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        band = mix(band + sketch[r::ROWS])
    return band


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where in the order of ``b`` each shingle of ``a`` begins and how many equal ones there are, and that order."""
    order = np.argsort(b, kind="stable")
    run = b[order]
    lo = np.searchsorted(run, a)
    return lo, np.searchsorted(run, a, side="right") - lo, order


def aligned(a: np.ndarray, b: np.ndarray, min_similarity: float = MIN_SIMILARITY) -> tuple[int, int]:
    """(equal shingles in the best alignment of two sequences inside the band that the threshold leaves, or 0 if that can't be reached; shingles of the longer that the other has too)."""
    if len(a) < len(b):
        a, b = b, a
    need = min_similarity / (1 + min_similarity) * (len(a) + len(b))
    left, right = len(a) - need, len(b) - need  # what either may leave out
    lo, n, order = common(a, b)
    shared = int((n > 0).sum())
    if right < 0 or shared < need - 1e-6:
        return 0, shared
    i = np.repeat(np.arange(len(a)), n)
    # places in b, those of one shingle from the last to the first, so that only one of them is taken
    j = order[np.repeat(lo + n - 1, n) - (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))]
    inside = (i - j <= int(left) + 1) & (j - i <= int(right) + 1)
    j = j[inside]
    if (j[1:] > j[:-1]).all():
        return len(j), shared
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails), shared


def similarity(a: np.ndarray, b: np.ndarray, min_similarity: float = MIN_SIMILARITY) -> float:
    if not len(a) or not len(b):
        return 0.0
    m = aligned(a, b, min_similarity)[0]
    return m / (len(a) + len(b) - m)


def _sketches(src: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and the bands (empty without words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                words, ends = word_hashes(step.column("text"))
                bands = [order_minhash(labelled(shingles(words[a:b], WORDS))) if b > a else words[:0] for a, b in zip(ends, ends[1:])]
                at = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
                flat = np.concatenate(bands).view(np.int64) if bands else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("h1"), step.column("h2"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "h1", "h2", "bands"])

    return src.mapInArrow(tidy(sketch), "doc_id long, h1 long, h2 long, bands array<long>")


def _sequences(src: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its labelled shingles for each of ``nodes`` (node, doc_id, h1, h2).

    A bitmap of hashed ids, of ``FILTER_BITS`` bits at most, goes to the scan of the texts, so
    that few texts are read in vain and none is shuffled; shingles are then joined exactly by id and text.
    """
    bits = min(FILTER_BITS, 1 << max(16, int(16 * nodes.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = nodes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("b")).collect()  # FILTER_BITS / 64 rows at most
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[[r["w"] for r in words]] = np.array([r["b"] for r in words], np.int64).view(np.uint64)
    held = src.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("slot").to_numpy(zero_copy_only=False).astype(np.uint64)
            batch = batch.filter(pa.array((held.value[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for step in steps(batch, "text"):
                words, ends = word_hashes(step.column("text"))
                seq = [labelled(shingles(words[a:b], WORDS)).tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*(step.column(c) for c in ("doc_id", "h1", "h2")), pa.array(seq, pa.binary())], ["doc_id", "h1", "h2", "seq"])

    found = src.withColumn("slot", slot).mapInArrow(tidy(make), "doc_id long, h1 long, h2 long, seq binary")
    return found.join(nodes, ["doc_id", "h1", "h2"]).groupBy("node").agg(F.min("seq").alias("seq"))


def _both(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the shingles of both."""
    one = pairs.join(sequences.select(F.col("node").alias("b"), F.col("seq").alias("seq_b")), "b")
    return one.join(sequences.select(F.col("node").alias("a"), F.col("seq").alias("seq_a")), "a")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    for batch in batches:
        yield batch, [tuple(np.frombuffer(v.as_buffer(), np.uint64) for v in p) for p in zip(batch.column("seq_a"), batch.column("seq_b"))]


def _verified(pairs: DataFrame, sequences: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs (a, b) with whether they are similar, the number of shingles of each, and of those in both."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, each in _pairs(batches):
            got = [aligned(x, y, min_similarity) for x, y in each]
            ok = [m >= min_similarity * (len(x) + len(y) - m) - 1e-9 for (m, _), (x, y) in zip(got, each)]
            counts = [[len(x) for x, _ in each], [len(y) for _, y in each], [n for _, n in got]]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_()), *(pa.array(c, pa.int64()) for c in counts)], ["a", "b", "similar", "n_a", "n_b", "shared"])

    return _both(pairs, sequences).select("a", "b", "seq_a", "seq_b").mapInArrow(tidy(verify), "a long, b long, similar boolean, n_a long, n_b long, shared long")


def _added(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pairs (a, b) with each shingle of b that a lacks."""

    def lacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, each in _pairs(batches):
            new = [y[common(y, x)[1] == 0] for x, y in each]
            ends = np.cumsum([0, *map(len, new)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *new]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["a", "b", "added"])

    return _both(pairs, sequences).select("a", "b", "seq_a", "seq_b").mapInArrow(tidy(lacks), "a long, b long, added array<long>").select("a", "b", F.explode("added").alias("shingle"))


def _possible(tried: DataFrame, held: DataFrame, sequences: DataFrame, min_similarity: float, s: Scratch) -> DataFrame:
    """Pairs (a, b) of different classes that share a leader and can be similar; ``tried``: leaders (a) and their members (b) as compared."""
    class_of = held.select("node", "class")
    sizes = s.written(tried.groupBy("a").agg(F.count("*").alias("size")), "sizes")
    # two members of one leader of most members need only be looked at there: what rules them out with one leader rules them out
    main = s.written(tried.join(sizes, "a").groupBy("b").agg(F.max(F.struct("size", "a"))["a"].alias("main")), "main")
    rows = s.written(tried.join(class_of.withColumnRenamed("node", "b"), "b", "left").withColumn("class", F.coalesce("class", "b")).join(main, "b"), "rows")
    lead = sizes.select("a").join(class_of.withColumnRenamed("node", "a").withColumnRenamed("class", "lead"), "a", "left").withColumn("lead", F.coalesce("lead", "a"))
    # leaders whose members are in several classes; its own class counts
    spread = s.written(rows.groupBy("a").agg(F.min("class").alias("least"), F.max("class").alias("most")), "spread")
    mixed = s.written(spread.join(lead, "a").filter((F.col("least") < F.col("most")) | (F.col("least") != F.col("lead"))).select("a"), "mixed")
    ratio = (1 + min_similarity) / min_similarity
    # the most shingles that another can have which shares none with b but those in a
    longest = F.floor(F.col("shared") * ratio - F.col("n_b") + 1e-6)
    # and the fewest that it must share beside those in a: all of its own share of the threshold that a hasn't
    least = F.greatest(F.lit(1), F.ceil(F.lit(min_similarity) * F.col("n_b") - F.col("shared") - 1e-6))
    open_ = s.written(rows.join(mixed, "a", "left_semi").select("a", "b", "class", "main", "n_a", "n_b", "similar", longest.alias("longest"), least.alias("need")), "open")

    posts = s.written(_added(open_.select("a", "b"), sequences), "added").join(open_.select("a", "b", "class", "main", "need"), ["a", "b"])
    shared = posts.groupBy("a", "shingle").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.min("main").alias("low"), F.max("main").alias("high"), F.count("*").alias("n")).filter("least < most and (low < high or low = a)").select("a", "shingle", "n")
    # of k shingles of which need must be shared, one of the k - need + 1 rarest is; a member's are no more than its text has
    own = Window.partitionBy("a", "b")
    posts = posts.join(shared, ["a", "shingle"]).withColumn("k", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("n", "shingle")))
    posts = s.written(posts.filter("at <= k - need + 1").select("a", "b", "shingle", "class", "main"), "posts")
    mates = posts.select("a", "shingle", F.col("b").alias("mate"), F.col("class").alias("mate_class"), F.col("main").alias("mate_main"))
    meet = posts.join(mates, ["a", "shingle"]).filter("class < mate_class and (main <> mate_main or main = a)").select("b", "mate")

    # without such a shingle: one of the two is no link of a. Where it shares too little with a, the other is shorter than a; where it shares enough
    # but in another order, so does the other
    strange = open_.filter("not similar").select("a", "b", "class", "main", "n_b", "longest", (F.col("longest") >= F.col("n_a")).alias("alike"))
    low, high = open_.filter("n_b < n_a").withColumn("alike", F.lit(False)), open_.filter("longest >= n_a").withColumn("alike", F.lit(True))
    others = low.unionByName(high).select("a", "alike", F.col("b").alias("mate"), F.col("class").alias("mate_class"), F.col("main").alias("mate_main"), F.col("n_b").alias("mate_n"), F.col("longest").alias("mate_longest"))
    short = strange.join(others, ["a", "alike"]).filter("class <> mate_class and mate_n <= longest and n_b <= mate_longest and (main <> mate_main or main = a)").select("b", "mate")
    # written: what follows must see each pair once, however many shingles it shares
    return s.written(meet.unionByName(short).select(F.least("b", "mate").alias("a"), F.greatest("b", "mate").alias("b")).distinct(), "pairs")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id and class_id for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    known = src.filter("doc_id is not null")
    hashed = known.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    with Scratch(docs.sparkSession, "near") as s:
        sketches = s.written(_sketches(hashed), "sketches")
        worded = sketches.filter(F.size("bands") > 0)
        # one of each text, numbered: partial minima before the shuffle, whatever the number of copies
        texts = worded.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "bands")).alias("m"), F.count("*").alias("copies"))
        nodes = s.written(texts.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "copies", "m.*"), "nodes")

        rows = nodes.select("node", F.explode("bands").alias("bucket"))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        members = s.written(rows.join(sizes, "bucket"), "members")
        popular = s.written(members.groupBy("node").agg(F.sum("size").alias("meets")), "popular")
        leaders = members.join(popular, "node").groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("node")).alias("neg"))).alias("m")).select("bucket", (-F.col("m.neg")).alias("leader"))
        led = s.written(members.join(leaders, "bucket").select("bucket", "node", "leader"), "led")
        sequences = s.written(_sequences(hashed, nodes.select("node", "doc_id", "h1", "h2").join(popular, "node", "left_semi")), "sequences")

        first = s.written(led.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "first")
        tried = s.written(_verified(first, sequences, min_similarity), "tried")
        held = s.written(components(tried.filter("similar"), "a", "b"), "held")
        pairs = _possible(tried, held, sequences, min_similarity, s)
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = s.written(pairs.join(done, ["a", "b"], "left_anti"), "more")
        found = s.written(_verified(more, sequences, min_similarity).filter("similar").select("a", "b"), "found")

        # documents of each text; where copies are none, that is the node's own
        own = nodes.filter("copies = 1").select("doc_id", "node")
        of = s.written(own.unionByName(worded.select("doc_id", "h1", "h2").join(nodes.filter("copies > 1").select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node").distinct()), "documents")
        several = of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
        joined = found.unionByName(of.join(several, "doc_id").select("a", F.col("node").alias("b")))
        # links between the classes held so far, then the two steps together
        for end in ("a", "b"):
            joined = joined.join(held.select(F.col("node").alias(end), F.col("class").alias("class_")), end, "left").withColumn(end, F.coalesce("class_", end)).drop("class_")
        merged = s.written(components(joined, "a", "b"), "merged")
        class_of = nodes.select("node", "doc_id").join(held, "node", "left").withColumn("class", F.coalesce("class", "node"))
        class_of = class_of.join(merged.select(F.col("node").alias("class"), F.col("class").alias("top")), "class", "left").select("node", "doc_id", F.coalesce("top", "class").alias("class"))
        class_of = s.written(class_of, "class_of")
        least = class_of.groupBy("class").agg(F.min("doc_id").alias("class_id"))
        classes = of.join(class_of.select("node", "class"), "node").join(least, "class").filter("doc_id <> class_id").select("doc_id", "class_id").distinct()
        labelled_ = known.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
        return written(labelled_.unionByName(src.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))), "classes")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest doc_id of each class; of rows that share a doc_id the one with the smallest text. Rows without doc_id stay."""
    key = F.col(f"`{id_col}`")
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id_")).distinct()
    packed = docs.filter(key.isNotNull()).select(key.cast("long").alias("gone_id_"), F.col(f"`{text_col}`").alias("order_"), F.struct("*").alias("row_"))
    kept = packed.join(gone, "gone_id_", "left_anti")
    one = kept.withColumn("n_", F.row_number().over(Window.partitionBy("gone_id_").orderBy("order_"))).filter("n_ = 1").select("row_.*")
    return one.unionByName(docs.filter(key.isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
