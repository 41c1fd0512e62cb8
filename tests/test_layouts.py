"""Table layouts: what they save is read off the plans."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemetrics.operators import cycle, items, price
from aislemetrics.sources import sinks

DAY = dt.date(2000, 1, 3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sold(spark):
    days = "date_add(DATE '2000-01-03', cast(id % 60 as int)) AS date_id"
    lines = spark.range(3_000).selectExpr("id AS transaction_fid", "if(id % 5 = 0, null, id % 70) AS card_id", days, "1D AS item_qty")
    return lines.withColumn("fis_week_id", (F.datediff("date_id", F.lit(DAY)) / 7).cast("int") + 200001)


def test_bucketed_table_saves_the_shuffle(spark, sold):
    sinks.write_bucketed(sold.select("card_id", "date_id"), "card_days", ["card_id"], 4)
    try:
        days = cycle.shopper_days(spark.table("card_days"))
        assert "Exchange" not in _plan(days) and "Exchange" in _plan(cycle.shopper_days(sold))
        cycles = cycle.shopping_cycle(spark.table("card_days"))
        assert "Exchange" not in _plan(cycles)
        assert sorted(cycles.collect()) == sorted(cycle.shopping_cycle(sold).collect())
    finally:
        spark.sql("DROP TABLE card_days")


def test_weeks_prune_folders(spark, sold, tmp_path):
    path = str(tmp_path / "weeks")
    sinks.write_by_week(sold, path, tasks_per_week=2)
    stored = spark.read.parquet(path)
    sliced = items.weeks_between(stored, 200003, 200004)
    assert "PartitionFilters: [isnotnull(fis_week_id" in _plan(sliced)
    assert sliced.count() == sold.filter("fis_week_id IN (200003, 200004)").count() == 700
    # A week known only at run time prunes too.
    sold.select("fis_week_id", "date_id").distinct().write.parquet(str(tmp_path / "dates"))
    dates = spark.read.parquet(str(tmp_path / "dates")).filter(F.col("date_id") == DAY)
    joined = stored.join(dates.select("fis_week_id"), "fis_week_id")
    assert "dynamicpruning" in _plan(joined) and joined.count() == 350
    with pytest.raises(ValueError):
        sinks.write_by_week(stored, path)


def test_a_repeated_run_stands_once(spark, tmp_path):
    path = str(tmp_path / "report")
    for run, rows in (("a", 3), ("b", 2), ("a", 4)):
        sinks.write_run(spark.range(rows), path, run)
    report = spark.read.parquet(path)
    assert sorted((r.run, r.id) for r in report.collect()) == [*(("a", i) for i in range(4)), ("b", 0), ("b", 1)]


def test_snapshot_by_a_calendar_of_ones_own(spark):
    dates = spark.createDataFrame([(DAY + dt.timedelta(days=i), i // 5) for i in range(12)], "date_id date, fis_week_id int")
    snapshots = spark.createDataFrame([(1, DAY + dt.timedelta(days=9), 7), (2, DAY + dt.timedelta(days=6), 7)], "prsn_id int, date_id date, seg_value_id int")
    values = spark.createDataFrame([(7, "t", "LA")], "seg_value_id int, seg_type_code string, seg_value_code string")
    cards = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "card_id int, prsn_id int")
    found = price.segment_cards(snapshots, values, cards, 1, "t", ["LA"], dates).collect()
    assert sorted(r.card_id for r in found) == [10, 11]
    assert price.segment_cards(snapshots, values, cards, 9, "t", ["LA"], dates).collect() == []


def test_quantiles_by_rank(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=40_000), "b": np.repeat([1.0, 2.0, 5.0], [1, 9_000, 2]), "c": np.array([4.0]), "d": np.array([])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("d", None), ("a", None), (None, 3.0)]
    points = spark.createDataFrame(rows, "g string, x double").repartition(6)
    found = {r.g: r for r in price.describe(points, ["x"], ["g"]).collect()}
    assert found[None].q50 == 3.0 and found["d"]["count"] == 0 and found["d"].q25 is None
    for g in "abc":
        wanted = np.quantile(groups[g], [0, 0.25, 0.5, 0.75, 1])
        assert [found[g][c] for c in ("min", "q25", "q50", "q75", "max")] == pytest.approx(wanted.tolist())
    # A group's values are in several tasks.
    long = points.filter("g = 'a'").select("g", F.col("x").alias("value"))
    three = price.exact_quantiles(long, ["g"], {"low": 0.001, "high": 0.999}).collect()[0]
    assert [three.low, three.high] == pytest.approx(np.quantile(groups["a"], [0.001, 0.999]).tolist())
