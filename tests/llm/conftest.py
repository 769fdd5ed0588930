import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n=40):
    return " ".join(rng.choice(["the", "of", "river", "stone", "amber", "quiet", "lantern", "forge", "meadow", "cipher", "walnut", "harbor", "velvet", "onyx"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, and columns whose names clash with internal ones."""
    rng = random.Random(1)
    long = sentence(rng, 30_000)
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "no id here", "en", "s", 3), (None, None, None, None, None), (3, "a", "en", "s", 1), (4, long, "en", "s", len(long)), (5, "!!! ???", "de", "s", 7), (6, "same row", "en", "s", 8), (6, "same row", "en", "s", 8), (7, "same row", None, "s", 8), (-1, "ünïcode   ퟿ ✓\tend", "fr", "s", 9)]
    df = spark.createDataFrame(rows, DDL)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(("row_", "text_", "part", "bands", "h1", "slot", "class_id", "gone_id_", "order_", "kinds_", "rank_", "before_", "score"))))


@pytest.fixture(scope="session")
def none(spark, odd):
    """The same without rows."""
    return odd.limit(0)
