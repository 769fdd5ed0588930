"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

- Features: runs of one to three characters of the lower-case text, in which all but
  letters is one space, hashed to ``FEATURES`` numbers; weight log(1 + tf) * idf, scaled to length 1.
- Document frequencies are counted over all labelled training documents.
- Weights: follow-the-regularised-leader with per-coordinate rates and an elastic net (L1 makes
  most weights exactly 0), on at most ``PER_LANGUAGE`` training documents of each language, those with the
  smallest hashes. A fifth of them is held back and calibrates one temperature by likelihood.
- The model (FEATURES x languages numbers) is broadcast; documents are scored in one scan.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is
every text if no training document has a label. Equal scores go to the language that sorts first. A
null doc_id is never held out and never trains. Only id, text and label are read, the label for training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bounded_batches, steps, table, tidy, written

FEATURES = 1 << 13
#: The bound on training documents of each language.
PER_LANGUAGE = 800
#: A sample of ids up to this many goes to all tasks, a larger one, of very many languages, is shuffled.
MOST_BROADCAST = 200_000
UNKNOWN = "und"
#: The pipeline's stage rejects a document whose score is no further than this share of the way from chance, 1 / languages, to 1.
MIN_MARGIN = 1 / 15
#: It also rejects one of whose letters less than this share occurs in the sample that the model was fitted on.
MIN_KNOWN = 0.5

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[ord("a")]:
        _LETTER[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return _LETTER


def counts(text: str) -> np.ndarray | None:
    """How often each feature occurs in a text; None without letters."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[raw]
    if not is_letter.any():
        return None
    c = np.where(is_letter, raw, np.uint32(32))
    space = np.concatenate([[True], ~is_letter, [True]])
    c = np.concatenate([[32], c, [32]])[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + one[2:]
    out = np.bincount(one >> shift, minlength=FEATURES)
    for h in (two, three):
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
        out += np.bincount(h >> shift, minlength=FEATURES)
    return out


def tf_idf(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features (the last is the bias) x languages
    temperature: float
    letters: np.ndarray  # code points of the letters in the sample, sorted

    def knows(self, text: str) -> float:
        """The share of a text's letters that the sample has; 1 without letters."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = raw[_letters()[raw]]
        at = np.searchsorted(self.letters, raw)
        return float((self.letters[np.minimum(at, len(self.letters) - 1)] == raw).mean()) if len(raw) and len(self.letters) else 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of rows of TF-IDF."""
        return softmax((x @ self.weights[:-1] + self.weights[-1]) / self.temperature)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_languages: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 0) -> np.ndarray:
    """FTRL-proximal over sparse rows (features, values); the bias is the last row of weights."""
    z, n = np.zeros((FEATURES + 1, n_languages)), np.zeros((FEATURES + 1, n_languages))

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x = rows[i]
            f, x = np.append(f, FEATURES), np.append(x, 1.0)
            w = weights(f)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = np.outer(x, p)
            g2 = g * g
            z[f] += g - (np.sqrt(n[f] + g2) - np.sqrt(n[f])) / alpha * w
            n[f] += g2
    return weights(np.arange(FEATURES + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the highest likelihood on held-back documents, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b, g = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on labelled documents; None without any."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    src = labelled.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("y")).filter("y is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for step in steps(batch, "text"):
                for t in step.column("text").to_pylist():
                    c = counts(t)
                    if c is not None:
                        df += c > 0
                        n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(df, n))], ["f", "n"])

    df = np.zeros(FEATURES + 1)
    for r in src.select("text").mapInArrow(tidy(frequencies), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows
        df[r["f"]] = r["n"]
    if not df[-1]:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1

    # candidates: a share of each language's documents by hash, then exactly the smallest hashes
    key = src.select("i", "y", F.xxhash64("i", F.lit(17)).alias("h"))
    sizes = written(key.groupBy("y").agg(F.count("*").alias("all_")), "language-sizes")
    if sizes.count() <= MOST_BROADCAST:  # a row for each language
        sizes = F.broadcast(sizes)
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 200) / F.col("all_"))
    near = key.join(sizes, "y").filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("i", "y", "h")
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(F.pmod("h", F.lit(1 << 20)), "h", "i"))).filter(F.col("n") <= per_language).select("i", "y", "n")
    sample = written(first, "language-sample")  # per_language rows of each language at most
    small = sample.count() <= MOST_BROADCAST
    chosen = src.join(F.broadcast(sample) if small else sample, ["i", "y"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                out = []
                for t, y, n in zip(*(step.column(c).to_pylist() for c in ("text", "y", "n"))):
                    c = counts(t)
                    if c is not None:
                        f = np.flatnonzero(c)
                        raw = np.unique(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32))
                        out.append((y, n, f.astype("<u2").tobytes(), np.minimum(c[f], 65535).astype("<u2").tobytes(), raw[_letters()[raw]].astype("<u4").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["y", "n", "f", "c", "l"])

    got = chosen.mapInArrow(tidy(features), "y string, n long, f binary, c binary, l binary").collect()  # the bounded sample
    got.sort(key=lambda r: (r["y"], r["n"], r["f"]))
    languages = sorted({r["y"] for r in got})
    if not languages:
        return None
    rows = []
    for r in got:
        f = np.frombuffer(r["f"], "<u2").astype(np.int64)
        x = np.log1p(np.frombuffer(r["c"], "<u2")) * idf[f]
        rows.append((f, x / max(1e-12, np.sqrt((x * x).sum()))))
    y = np.array([languages.index(r["y"]) for r in got])
    back = np.array([r["n"] % 5 == 0 for r in got])
    weights = fit_ftrl([x for x, b in zip(rows, back) if not b], y[~back], len(languages))
    logits = np.array([x @ weights[f] + weights[-1] for (f, x), b in zip(rows, back) if b]).reshape(-1, len(languages))
    letters = np.unique(np.frombuffer(b"".join(r["l"] for r in got), "<u4"))
    return Model(languages, idf, weights, fit_temperature(logits, y[back]), letters)


def scored(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Languages and scores of texts."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return lang, score
    got, rows = [], []
    for i, t in enumerate(texts.to_pylist()):
        c = counts(t) if t else None
        if c is not None:
            got.append(i)
            rows.append(c)
        if rows and (len(rows) == 64 or i + 1 == len(texts)):
            p = model.score(tf_idf(np.array(rows), model.idf))
            for j, k, s in zip(got, p.argmax(axis=1), p.max(axis=1)):
                lang[j], score[j] = model.languages[k], s
            got, rows = [], []
    if rows:
        p = model.score(tf_idf(np.array(rows), model.idf))
        for j, k, s in zip(got, p.argmax(axis=1), p.max(axis=1)):
            lang[j], score[j] = model.languages[k], s
    return lang, np.clip(score, 0.0, 1.0)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                lang, score = scored(step.column("text"), held.value)
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def trained_on(docs: DataFrame, **kw) -> Model | None:
    """A model of the documents that aren't held out."""
    return train(docs.filter(~is_held_out() & F.col("doc_id").isNotNull()), **kw)


def keep_identified(docs: DataFrame, model: Model | None, *, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised better than by chance, by that margin, and most of whose letters are known."""
    bounded_batches(docs.sparkSession)
    n = len(model.languages) if model else 1
    min_score = 1 / n + min_margin * (1 - 1 / n) - 1e-12
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text_col):
                lang, score = scored(step.column(text_col), held.value)
                ok = (np.array(lang, object) != UNKNOWN) & (score >= min_score)
                known = [k and held.value.knows(t) >= MIN_KNOWN for t, k in zip(step.column(text_col).to_pylist(), ok.tolist())]
                yield step.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, trained_on(docs))
