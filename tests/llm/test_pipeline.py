from __future__ import annotations

import itertools
import os
import re

import duckdb
import pytest
from conftest import SF

import corpus_pipeline
from veilspan.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    result = con.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in result.description]
    order = lambda cols, rows: sorted(repr(tuple(r[k] for k in sorted(range(len(cols)), key=lambda k: cols[k]))) for r in rows)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == columns and at.dtypes == docs.dtypes
        rows = {r.doc_id: r for r in at.collect()}
        assert rows and all(r.n_chars == len(r.text) for r in rows.values())
        if name == "ngram_jaccard_join":
            sets = {}
            for d, r in rows.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
                sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            for a, b in itertools.combinations(sets.values(), 2):
                assert len(a & b) < 0.8 * len(a | b)
        if name == "benchmark_decontamination":
            assert not any(i in r.text for r in rows.values() for i in items)
    assert set(rows) < set(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {p.doc_id for p in packed} == set(rows)
    whole = corpus_pipeline.run(spark, SF).collect()  # the cuts depend on the partitions, the tokens don't
    assert {(p.doc_id, p.doc_tokens) for p in whole} == {(p.doc_id, p.doc_tokens) for p in packed}


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
