import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from aislemetrics.functions.calendar import Weeks, date_dim
from aislemetrics.operators import cycle, seasonality


@pytest.fixture(scope="module")
def visits(spark):
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    rows = [(1, day(0)), (1, day(2)), (1, day(7)), (2, day(3)), (3, day(3)), (3, day(3)), (None, day(0)), (None, day(9))]
    rows += [(4, day(0)), (4, day(10))]
    return spark.createDataFrame(rows, "card_id long, date_id date")


def test_cycle_needs_two_days(visits):
    found = {r.card_id: r.median_day_cycle for r in cycle.shopping_cycle(visits).collect()}
    assert found == {1: 3.5, 4: 10.0}


def test_overall_and_cumulative(visits):
    cycles = cycle.shopping_cycle(visits)
    assert tuple(cycle.overall_cycle(cycles).first()) == (6.75, 2)
    running = [tuple(r) for r in cycle.cumulative_cycles(cycles).orderBy("median_day_cycle").collect()]
    assert running == [(3.5, 1, 1), (10.0, 1, 2)]


def test_histogram_closes_the_last_bin(spark):
    values = spark.createDataFrame([(float(v),) for v in range(21)], "v double")
    bins = {r.bin: r.n for r in cycle.histogram(values, "v").collect()}
    assert bins == {**{b: 1 for b in range(1, 20)}, 20: 2}
    one = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [tuple(r) for r in cycle.histogram(one, "v").collect()] == [(1, 2)]


def _week_ids(n):
    first = dt.date(1997, 1, 6)
    days = [first + dt.timedelta(weeks=w) for w in range(n)]
    return [d.isocalendar()[0] * 100 + d.isocalendar()[1] for d in days]


def test_constant_series_has_index_one(spark):
    kpi = spark.createDataFrame([("a", w, 5.0) for w in _week_ids(104)], "l string, fis_week_id int, units double")
    index = seasonality.seasonality_index(kpi, ["units"], "fis_week_id", "l").collect()
    assert {r.med_idx_units for r in index} == {1.0}
    # 53 weeks are kept, of which the first and the last share a number.
    assert len(index) == 52


def test_index_equals_brute_force(spark):
    ids = _week_ids(30)
    series = {"a": [float((7 * w) % 11 + 1) for w in range(30)], "b": [float(w * w % 13 + 2) for w in range(20)]}
    rows = [(g, ids[w], v) for g, values in series.items() for w, v in enumerate(values)]
    kpi = spark.createDataFrame(rows, "l string, fis_week_id int, units double")
    found = {(r.l, r.fis_week_id): r.idx_units for r in seasonality.index_weeks(kpi, ["units"], "fis_week_id", "l", (-3, 2)).collect()}
    wanted = {}
    for group, values in series.items():
        for w in range(3, len(values) - 2):
            wanted[group, ids[w]] = values[w] / statistics.fmean(values[w - 3 : w + 3])
    assert found == pytest.approx(wanted)


@pytest.fixture(scope="module")
def fact(spark):
    dates = date_dim(spark, dt.date(1996, 1, 1), dt.date(2000, 12, 31)).cache()
    monday = dates.filter("fis_day_of_week_num = 1")
    both = monday.withColumn("prod_code", F.explode(F.array(F.lit("p1"), F.lit("p2"))))
    both = both.filter("NOT (prod_code = 'p2' AND fis_week_id = 199805)")
    items = both.selectExpr(
        "prod_code", "date_id", "fis_week_id", "2.0D AS item_qty", "cast(NULL as double) AS weight_uom_qty",
        "cast(1 as decimal(18,4)) AS net_spend_amt",
    )
    products = spark.createDataFrame(
        [("p1", "A", "01"), ("p2", "B", "01"), ("p3", "C", "99")],
        "prod_code string, lvl string, prod_hier_l50_code string",
    )
    return items, products, Weeks()


def test_padding_completeness_and_extra_week(fact):
    items, products, weeks = fact
    kpi = seasonality.weekly_kpi(items, products, weeks, "lvl", 199801, 199852, divisions=["01"])
    # 26 weeks before, 25 + 1 after; the group that misses one week is dropped.
    assert {r.lvl for r in kpi.collect()} == {"A"}
    assert kpi.count() == 26 + 52 + 26
    kept = seasonality.index_weeks(kpi, ["units"], "fis_week_id", "lvl")
    assert tuple(kept.agg(F.min("fis_week_id"), F.max("fis_week_id")).first()) == (199801, 199853)
    exact = seasonality.weekly_kpi(items, products, weeks, "lvl", 199801, 199852, extra_week=False)
    kept = seasonality.index_weeks(exact, ["units"], "fis_week_id", "lvl")
    assert tuple(kept.agg(F.min("fis_week_id"), F.max("fis_week_id")).first()) == (199801, 199852)


def test_recent_index_covers_the_asked_weeks(fact):
    items, products, weeks = fact
    index = seasonality.recent_seasonality(items, products, weeks, "lvl", 199920, 199922, 199952, divisions=["01"])
    # The last 104 weeks reach back to 199802, so the missing week drops a group.
    assert {r.period_no for r in index.collect()} == {"20", "21", "22"}
    assert {r.lvl for r in index.collect()} == {"A"}
