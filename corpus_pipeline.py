"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. language ID: documents whose language isn't recognised go;
2. near-duplicates: one document of each group stays;
3. decontamination: documents that overlap a benchmark item go;
4. PII: validated values are replaced by pseudonyms;
5. packing: the ids of what is left, cut and packed into sequences.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import table, written
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.langid import keep_identified, trained_on
from tessera.llm.near_dedup import drop_near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.pii import DEMO_KEY, pseudonymized


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, trained_on(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; ``n_chars`` follows the new text."""
    new = pseudonymized(docs, DEMO_KEY)
    return new.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(new.schema["n_chars"].dataType))) if "n_chars" in new.columns else new


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # small steps: workers still hold what the stages before needed
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False, step_bytes=1 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learned language model, sketches and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
