"""Every catalogued query against the SQL that says the same, on the driver's smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from evidentry.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return connection


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    found = sorted((tuple(shown(r[c]) for c in sorted(frame.columns)) for r in frame.collect()), key=repr)
    assert found
    if name in ORACLES:
        answer = duck.sql(ORACLES[name])
        assert sorted(answer.columns) == sorted(frame.columns)
        at = [answer.columns.index(c) for c in sorted(answer.columns)]
        assert found == sorted((tuple(shown(r[i]) for i in at) for r in answer.fetchall()), key=repr)
