"""Registered queries against SQL, and the pipeline."""

import compare
import pytest

import corpus_pipeline
from gridloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    status, message, _ = compare.compare(spark, compare.connect(SF), SF, name, QUERIES[name], ORACLE[name])
    assert status == "ok", message


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert 0 < len(rows) <= 2 * before and all(r.n_tokens == len(r.token_ids) for r in rows)
