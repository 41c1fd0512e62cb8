import datetime as dt

import pytest
from pyspark.sql import functions as F

from aislemetrics.functions import calendar, columns
from aislemetrics.functions.calendar import Weeks, date_dim, shift_weeks
from aislemetrics.operators import items


@pytest.fixture(scope="module")
def dates(spark):
    return date_dim(spark, dt.date(1997, 12, 1), dt.date(1999, 2, 28)).cache()


def test_padding_never_cuts(spark):
    codes = spark.createDataFrame([("1",), ("000000012",), ("1234567890",), (None,)], "prod_code string")
    padded = [r[0] for r in codes.select(columns.pad_code(F.col("prod_code"))).collect()]
    assert padded == ["000000001", "000000012", "1234567890", None]
    assert columns.all_padded(codes).first()[0] is False


def test_small_expressions(spark):
    df = spark.createDataFrame(
        [(2.0, 3.0, "a,b ,c", "s12"), (0.0, 3.0, "x", "s7"), (-1.0, 3.0, "x", "s7"), (None, 3.0, "x", "s7")],
        "weight_uom_qty double, item_qty double, codes string, name string",
    )
    rows = df.select(
        columns.units().alias("u"),
        columns.split_codes(F.col("codes")).alias("c"),
        columns.strip_prefix(F.col("name")).alias("n"),
        columns.ratio(F.col("item_qty"), F.lit(0)).alias("r"),
        columns.row_sum([F.col("weight_uom_qty"), F.col("item_qty")]).alias("s"),
        columns.row_sum([F.col("weight_uom_qty"), F.col("item_qty")], zero_fill=True).alias("z"),
    ).collect()
    assert [r.u for r in rows] == [2.0, 3.0, 3.0, 3.0]
    assert rows[0].c == ["a", "b ", "c"]
    assert [r.n for r in rows[:2]] == ["12", "7"]
    assert rows[0].r is None
    assert [r.s for r in rows] == [5.0, 3.0, 2.0, None]
    assert rows[3].z == 3.0


def test_date_dim_is_the_iso_calendar(dates):
    for row in dates.collect():
        year, week, day = row.date_id.isocalendar()
        assert row.fis_week_id == year * 100 + week
        assert row.fis_day_of_week_num == day
        assert row.fis_week_of_epoch_num == (row.date_id - calendar.FIRST_MONDAY).days // 7


def test_shift_crosses_a_53_week_year(dates):
    back = {r.fis_week_id: r.shifted_week_id for r in shift_weeks(dates, 1).collect()}
    assert back[199901] == 199853 and back[199853] == 199852
    later = {r.fis_week_id: r.shifted_week_id for r in shift_weeks(dates, -2).collect()}
    assert later[199852] == 199901


def test_week_ids():
    weeks = Weeks()
    assert weeks.shifted(199901, 1) == 199853
    assert weeks.shifted(199852, -2) == 199901
    assert weeks.count(199852, 199901) == 3
    assert weeks.between(199852, 199902) == [199852, 199853, 199901, 199902]
    assert weeks.days(199853, 199901) == (dt.date(1998, 12, 28), dt.date(1999, 1, 10))
    assert weeks.shifted(198501, 52) == 198401 and weeks.shifted(204552, -1) == 204601
    with pytest.raises(ValueError):
        weeks.number(199954)
    with pytest.raises(ValueError):
        weeks.days(199902, 199901)


def test_any_date_has_a_week_and_a_day(spark):
    days = [dt.date(1985, 1, 1), dt.date(1985, 12, 30), dt.date(2045, 1, 1), dt.date(1901, 6, 5)]
    frame = spark.createDataFrame([(d,) for d in days], "date_id date")
    for r in calendar.with_calendar(frame).select("*", calendar.week_at(F.col("fis_week_of_epoch_num")).alias("w")).collect():
        year, week, day = r.date_id.isocalendar()
        assert (r.fis_week_id, r.fis_day_of_week_num, r.w) == (year * 100 + week, day, year * 100 + week)
    kept = items.filter_day_of_week(frame, [d.isoweekday() for d in days])
    assert kept.count() == len(days)


def test_period_no(spark):
    df = spark.createDataFrame([(199853,), (199901,)], "w int").select(calendar.period_no(F.col("w")))
    assert [r[0] for r in df.collect()] == ["53", "01"]
