"""Text expressions: normal forms, word counts, windows of sentences, numbers in text."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def word_count(c: Column) -> Column:
    """White-space separated words; none in an empty or null text."""
    t = F.trim(c)
    return F.when(F.length(t) > 0, F.size(F.split(t, r"\s+"))).otherwise(0)


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def joined(*cols: Column) -> Column:
    return F.concat_ws(" ", *cols)


def paragraphs(c: Column) -> Column:
    """Non-empty lines, trimmed."""
    return F.filter(F.transform(F.split(c, r"\n+"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)


def word_windows(c: Column, words: int = 120) -> Column:
    """Runs of about ``words`` words that end with a sentence: a sentence joins the run while the run is shorter."""
    sentences = F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        run = F.when(acc["run"] == "", s).otherwise(F.concat(acc["run"], F.lit(" "), s))
        n = acc["n"] + F.size(F.split(s, r"\s+"))
        full = n >= words
        return F.struct(F.when(full, F.concat(acc["done"], F.array(run))).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(run).alias("run"), F.when(full, F.lit(0)).otherwise(n).alias("n"))

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["run"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["run"]))))


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("long")


def numbers(c: Column) -> Column:
    """All numbers of a text, thousands separators dropped."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"-?\d[\d,]*(?:\.\d+)?"), 0), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bound(c: Column, body) -> Column:
    """``body`` of a column whose value is computed once, not again for every use."""
    return F.transform(F.array(c), body)[0]


def _runs(words: Column, n: int, make, kind: str) -> Column:
    def runs(ws: Column) -> Column:
        last = F.size(ws) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: make(F.slice(ws, i, n)))).otherwise(F.array().cast(f"array<{kind}>"))

    return bound(words, runs)


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by spaces."""
    run = lambda ws: F.transform(ws, lambda w, i: F.concat_ws(" ", w, *(F.get(ws, i + j) for j in range(1, n))))
    return bound(F.coalesce(words, F.array().cast("array<string>")), lambda ws: F.slice(run(ws), 1, F.greatest(F.lit(0), F.size(ws) - (n - 1))))


def ngram_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of the runs of ``n`` words."""
    return _runs(words, n, lambda r: F.xxhash64(r), "bigint")


def with_typos(text: str, share: float = 0.1, seed: int = 0) -> str:
    """A question with neighbouring letters of so many of its words of four letters or more swapped inside; the same for the same seed."""
    rng = random.Random(f"{seed}:{text}")

    def swap(m: re.Match) -> str:
        w = m[0]
        if rng.random() >= share:
            return w
        at = [i for i in range(1, len(w) - 2) if w[i] != w[i + 1]]
        if not at:
            return w
        i = rng.choice(at)
        return w[:i] + w[i + 1] + w[i] + w[i + 2 :]

    return re.sub(r"[^\W\d_]{4,}", swap, text)
