"""Seasonality index: weekly sales against their moving average, median per week of the year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.functions.calendar import Weeks, period_no
from aislemetrics.functions.columns import ratio, units
from aislemetrics.operators.items import product_levels, weeks_between

YEAR_AVERAGE = (-26, 25)


def level_week_kpi(items: DataFrame, products: DataFrame, level: str, divisions=None) -> DataFrame:
    """Units and sales per level and week, returns left out."""
    sold = items.filter(F.col("net_spend_amt") > 0).join(product_levels(products, level, divisions), "prod_code")
    sold = sold.select(level, "fis_week_id", units().alias("units"), "net_spend_amt")
    return sold.groupBy(level, "fis_week_id").agg(F.sum("units").alias("units"), F.sum("net_spend_amt").alias("sales"))


def complete_groups(kpi: DataFrame, level: str, n_weeks: int) -> DataFrame:
    """Groups that sold in each of the weeks."""
    n_wk = F.count("*").over(Window.partitionBy(level))
    return kpi.withColumn("n_wk", n_wk).filter(F.col("n_wk") >= n_weeks).drop("n_wk")


def weekly_kpi(
    items: DataFrame,
    products: DataFrame,
    weeks: Weeks,
    level: str,
    week_from: int,
    week_to: int,
    ma: Sequence[int] = YEAR_AVERAGE,
    divisions=None,
    extra_week: bool = True,
) -> DataFrame:
    """Weekly KPIs, padded so that each week has its whole moving average.

    ``extra_week`` adds one more week after the end, which the index then keeps as well.
    """
    before, after = (abs(int(n)) for n in ma)
    first = weeks.shifted(week_from, before)
    last = weeks.shifted(week_to, -(after + 1 if extra_week else after))
    padded = weeks_between(items, first, last, weeks)
    return complete_groups(level_week_kpi(padded, products, level, divisions), level, weeks.count(first, last))


def index_weeks(
    kpi: DataFrame, kpis: Sequence[str], time_col: str, level: str, ma: Sequence[int] = YEAR_AVERAGE
) -> DataFrame:
    """(level, time, period_no, idx_<kpi>...): KPI over its moving average, edges trimmed.

    A group's window holds one row per week.  Rank and row count are per group, so groups of
    uneven length are trimmed rightly too.
    """
    before, after = (abs(int(n)) for n in ma)
    in_time = Window.partitionBy(level).orderBy(time_col)
    around = in_time.rowsBetween(-before, after)
    indices = {f"idx_{k}": ratio(F.col(k).cast("double"), F.avg(F.col(k).cast("double")).over(around)) for k in kpis}
    ranked = kpi.withColumns(
        {**indices, "rank": F.row_number().over(in_time), "n_rank": F.count("*").over(Window.partitionBy(level))}
    )
    whole = ranked.filter((F.col("rank") > before) & (F.col("rank") <= F.col("n_rank") - after))
    return whole.select(level, time_col, period_no(F.col(time_col)).alias("period_no"), *indices)


def seasonality_index(
    kpi: DataFrame, kpis: Sequence[str], time_col: str, level: str, ma: Sequence[int] = YEAR_AVERAGE
) -> DataFrame:
    """(level, period_no, med_idx_<kpi>...): median index per week of the year, to 2 digits."""
    indexed = index_weeks(kpi, kpis, time_col, level, ma)
    medians = [F.round(F.median(f"idx_{k}"), 2).alias(f"med_idx_{k}") for k in kpis]
    return indexed.groupBy(level, "period_no").agg(*medians)


def recent_seasonality(
    items: DataFrame,
    products: DataFrame,
    weeks: Weeks,
    level: str,
    start_week: int,
    end_week: int,
    data_week_end: int,
    kpis: Sequence[str] = ("units",),
    n_weeks: int = 104,
    ma: Sequence[int] = (-2, 1),
    divisions=None,
) -> DataFrame:
    """Index for the weeks of the year between start and end, from the last ``n_weeks`` weeks of data."""
    first = weeks.shifted(data_week_end, n_weeks - 1)
    data = weeks_between(items, first, data_week_end, weeks)
    kpi = complete_groups(level_week_kpi(data, products, level, divisions), level, n_weeks)
    index = seasonality_index(kpi, kpis, "fis_week_id", level, ma)
    wanted = {str(week)[4:] for week in weeks.between(start_week, end_week)}
    return index.filter(F.col("period_no").isin(sorted(wanted)))
