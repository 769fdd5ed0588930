import re

import pytest

import corpus_pipeline
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.written(stage(spark, kept, SF), "test")
        assert new.columns == docs.columns and new.dtypes == docs.dtypes
        ids, before = {r["doc_id"] for r in new.collect()}, {r["doc_id"] for r in kept.collect()}
        assert ids <= before and new.count() == len(ids)
        if name == "near_dedup":
            assert len({r["text"] for r in new.collect()}) == new.count() < kept.count()
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r["text"] for r in new.collect() for i in items)
            assert {r["doc_id"] for r in kept.collect() if not any(i in r["text"] for i in items)} == ids
        kept = new
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in kept.collect()}
    assert sorted(map(tuple, last)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_stages_on_odd_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            got = stage(spark, df, SF)
            got.collect()
            assert name == "packing" or got.columns == df.columns


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_run(spark, name):
    assert re.match(r"op\d+_", name)
    assert QUERIES[name](spark, SF).count() > 0


def test_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        rel = con.sql(sql)
        at = [list(rel.columns).index(c) for c in sorted(df.columns)]
        assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
