"""Every registered query on whole tables: against its SQL where it has one, else for rows."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from aislemetrics.plans.oracle import ORACLE_SQL as SQL
from aislemetrics.plans.queries import QUERIES
from aislemetrics.sources.star import SCHEMAS

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in SCHEMAS:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return connection


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_query_is_registered():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    ours = comparable([tuple(r) for r in result.collect()], result.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = comparable(cursor.fetchall(), names)
    assert sorted(result.columns) == sorted(names)
    assert len(ours) == len(theirs) > 0
    for mine, other in zip(ours, theirs):
        assert [type(v) for v in mine] == [type(v) for v in other]
        assert mine == other
    flat = [v for row in ours for v in row if isinstance(v, float)]
    assert not any(math.isnan(v) for v in flat)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert len(QUERIES[name](spark, FOLDER).take(1)) == 1


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_components_fit_the_sql_covariance(spark, duck):
    """Spark ML's components against the covariance that SQL computes over the whole tables."""
    rows = duck.execute(SQL["feature_covariance"]).fetchall()
    names = sorted({row[0] for row in rows})
    cov = np.zeros((len(names), len(names)))
    for i, j, value in rows:
        cov[names.index(i), names.index(j)] = value
    found = QUERIES["pca_rows"](spark, FOLDER).collect()
    for k in {r.component for r in found}:
        own = {r.feature: r for r in found if r.component == k}
        weights = np.array([own[n].weight for n in names])
        value = own[names[0]].eigenvalue
        assert np.abs(cov @ weights - value * weights).max() < 1e-6
        assert own[names[0]].share == pytest.approx(value / np.trace(cov), abs=1e-6)
