"""Shapes of the plans that large tables get: no broadcasts, and no avoidable shuffle of the fact."""

import re

import pytest

from aislemetrics.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def depth(line):
    return re.search(r"[A-Za-z(*]", line).start()


def test_need_state_groups_without_a_shuffle_after_the_basket_join(spark):
    lines = plan(spark, "need_state").splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin [transaction_fid" in line)
    above = [line for line in lines[:join] if "Exchange" in line]
    # Only by card and subclass, and by card: rows of one per card, basket and subclass at most.
    assert len(above) == 2 and all("transaction_fid" not in line for line in above)
    assert not any("hashpartitioning(card_id" in line and "transaction_fid" in line for line in lines)


def test_shoppers_are_joined_to_the_basket_headers(spark):
    lines = plan(spark, "price_points").splitlines()
    semi = [i for i, line in enumerate(lines) if re.search(r"SortMergeJoin \[card_id.*LeftSemi", line)]
    fact = next(i for i, line in enumerate(lines) if "SortMergeJoin [transaction_fid" in line)
    assert semi and depth(lines[semi[0]]) > depth(lines[fact])


def test_tags_are_joined_to_the_basket_headers(spark):
    text = plan(spark, "token_sets")
    assert "xxhash64" not in text and "_spread" not in text
    lines = text.splitlines()
    tag = next(i for i, line in enumerate(lines) if re.search(r"SortMergeJoin \[card_id.*Inner", line))
    fact = next(i for i, line in enumerate(lines) if "SortMergeJoin [transaction_fid" in line)
    assert depth(lines[tag]) > depth(lines[fact])


def test_two_counts_do_not_double_the_rows(spark):
    assert "Expand" not in plan(spark, "daily_group_kpi")
