"""Hot keys without broadcasts: the joins and groupings that cluster-size tables get.

A third of all lines falls on one basket (so on one card and one week), a third on one product and
store, and AQE's skew thresholds are set low enough to split them.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from aislemetrics.sources.star import SCHEMAS
from test_oracle import comparable

SOURCE = "/root/testdata/sf0.01"
OPTIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
}
NAMES = [
    "item_slice",
    "customer_overlap_control",
    "daily_group_kpi",
    "token_sets",
    "greedy_reach_cards",
    "price_points",
    "price_by_group",
    "weekly_kpi",
    "shopping_cycle_overall",
    "price_points_period",
    "need_state",
    "segment_correlation",
    "cluster_r2_ratio",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    connection.execute("SET preserve_insertion_order = true")
    for table in SCHEMAS:
        rows = f"SELECT * FROM read_parquet('{SOURCE}/{table}.parquet')"
        if table == "lineitem":
            hot_order = f"(SELECT min(o_orderkey) FROM read_parquet('{SOURCE}/orders.parquet') WHERE o_orderpriority = '1-URGENT')"
            rows = f"""
                SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN {hot_order} ELSE l_orderkey END AS l_orderkey,
                                  CASE WHEN n % 3 = 1 THEN 3 ELSE l_partkey END AS l_partkey,
                                  CASE WHEN n % 3 = 1 THEN 7 ELSE l_suppkey END AS l_suppkey)
                FROM (SELECT *, row_number() OVER () AS n FROM ({rows}))"""
        connection.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return str(folder), connection


@pytest.fixture
def no_broadcast(spark):
    before = {key: spark.conf.get(key, None) for key in OPTIONS}
    for key, value in OPTIONS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, skewed, no_broadcast, name):
    folder, connection = skewed
    result = entry.queries()[name](spark, folder)
    ours = comparable([tuple(r) for r in result.collect()], result.columns)
    cursor = connection.execute(entry.oracle_sql()[name])
    theirs = comparable(cursor.fetchall(), [d[0] for d in cursor.description])
    assert ours == theirs and ours
