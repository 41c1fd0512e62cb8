"""Shopping cycle: how many days lie between a customer's purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.session import materialise


def shopper_days(items: DataFrame) -> DataFrame:
    """Distinct (card_id, date_id) of card holders."""
    return items.filter(F.col("card_id").isNotNull()).select("card_id", "date_id").distinct()


def purchase_gaps(items: DataFrame) -> DataFrame:
    """Days to the next purchase day, per card.

    The distinct combines on the map side, so a card's window holds one row per shopping day
    however many lines the card has.
    """
    in_time = Window.partitionBy("card_id").orderBy("date_id")
    days = shopper_days(items).withColumn("next_date_id", F.lead("date_id").over(in_time))
    gap = F.datediff("next_date_id", "date_id")
    return days.filter(F.col("next_date_id").isNotNull()).select("card_id", gap.alias("day_next_purchase"))


def shopping_cycle(items: DataFrame) -> DataFrame:
    """Median gap per card; a card needs two shopping days."""
    return purchase_gaps(items).groupBy("card_id").agg(F.median("day_next_purchase").alias("median_day_cycle"))


def overall_cycle(cycles: DataFrame) -> DataFrame:
    """One row: the median of the cards' medians."""
    return cycle_counts(cycles).agg(
        F.expr("percentile(median_day_cycle, 0.5, n_card)").alias("overall_cycle"), F.sum("n_card").alias("n_card")
    )


def cycle_counts(cycles: DataFrame) -> DataFrame:
    """Cards per median value."""
    return cycles.groupBy("median_day_cycle").agg(F.count("*").alias("n_card"))


def cumulative_cycles(cycles: DataFrame) -> DataFrame:
    """Running number of cards by cycle length.

    The unpartitioned window runs over the counted table: one row per half day at most.
    """
    upto = Window.orderBy("median_day_cycle").rowsBetween(Window.unboundedPreceding, 0)
    return cycle_counts(cycles).withColumn("accu_n_card", F.sum("n_card").over(upto))


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from the minimum to the maximum; the last bin is closed.

    The values are counted and written to the shared folder, so that the bounds are read off the
    counts and not found by a second pass over what lies below.
    """
    counted = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v"))
    counted = materialise(counted.agg(F.count("*").alias("n")), "histogram")
    low, high = counted.agg(F.min("v"), F.max("v")).first()
    if low is None or low == high:
        bin_no = F.lit(1)
    else:
        bin_no = F.least(F.width_bucket("v", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return counted.groupBy(bin_no.cast("int").alias("bin")).agg(F.sum("n").alias("n"))
