"""Registered queries against their SQL, and the pipeline's stages in their order."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from locengine.config import materialise
from locengine.llm.oracles import ORACLES
from locengine.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    theirs = duck.sql(ORACLES[name])
    made = QUERIES[name](spark, DATA)
    columns = sorted(made.columns)
    assert columns == sorted(theirs.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in made.collect()), key=str)
    want = sorted(theirs.select(*columns).fetchall(), key=str)
    assert ours == want and ours


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == ids
