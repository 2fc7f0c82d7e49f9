from __future__ import annotations

import os

import duckdb
import pytest
from conftest import SF

from veilspan.plans import catalogue


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    result = db.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())


def test_entry_and_commands(spark, capsys):
    import __spark_entry__
    from veilspan.__main__ import main

    assert __spark_entry__.entry(spark).count() == 200
    assert main(["mail b@x.io", "--text-only"]) == 0
    assert "mail <PRIVATE_EMAIL>" in capsys.readouterr().out
