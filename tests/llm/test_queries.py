"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

import collections

import duckdb
import pytest

import corpus_pipeline
from assaykit.llm.queries import CHECKS, QUERIES
from assaykit.llm.shared import written


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    rel = con.sql(CHECKS[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = collections.Counter(map(str, rel.fetchall()))
    got = collections.Counter(str(tuple(r)) for r in df.select(*rel.columns).collect())
    assert got == want


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        kept.append(docs.count())
        gone = before.select("text").subtract(docs.select("text"))
        if name == "language_id":
            assert kept[-1] == kept[-2]                       # all are clean documents
        if name == "exact_dedup":
            assert gone.count() == 0                          # every text is still there
            assert docs.select("text").distinct().count() == kept[-1] < kept[-2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_stages_on_odd_rows(request, spark, sf_dir, table):
    docs = request.getfixturevalue(table)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        assert name == "packing" or docs.columns == columns
