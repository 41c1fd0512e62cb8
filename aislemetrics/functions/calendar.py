"""Week calendar: Monday weeks, ids ``yyyyww`` by the ISO rules, and a gapless week counter.

Week ids are never added to or subtracted from; shifts go through the counter, so year ends and
53-week years come out right.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The Monday on which week 0 of the counter starts.
FIRST_MONDAY = dt.date(1969, 12, 29)


def week_of_date(date: Column) -> Column:
    return (F.extract(F.lit("YEAROFWEEK"), date) * 100 + F.weekofyear(date)).cast("int")


def week_number(date: Column) -> Column:
    return F.floor(F.datediff(date, F.lit(FIRST_MONDAY)) / 7).cast("int")


def day_of_week(date: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return (F.weekday(date) + 1).cast("int")


def period_no(week_id: Column) -> Column:
    """``yyyyww`` to the text ``ww``."""
    return F.substring(week_id.cast("string"), 5, 2)


def week_at(number: Column) -> Column:
    """Id of the week with a counter."""
    return week_of_date(F.date_add(F.lit(FIRST_MONDAY), 7 * number))


def with_calendar(df: DataFrame) -> DataFrame:
    """Add week id, week counter and day of the week to a frame with ``date_id``, whatever the dates."""
    date = F.col("date_id")
    return df.withColumns(
        {
            "fis_week_id": week_of_date(date),
            "fis_week_of_epoch_num": week_number(date),
            "fis_day_of_week_num": day_of_week(date),
        }
    )


def date_dim(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per date from ``first`` to ``last``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date_id"))
    return with_calendar(days)


def weeks(dates: DataFrame) -> DataFrame:
    return dates.select("fis_week_id", "fis_week_of_epoch_num").distinct()


def shift_weeks(dates: DataFrame, back: int) -> DataFrame:
    """(fis_week_id, shifted_week_id): the week ``back`` weeks earlier, later when negative."""
    shifted = week_at(F.col("fis_week_of_epoch_num") - back).alias("shifted_week_id")
    return weeks(dates).select("fis_week_id", shifted)


class Weeks:
    """Week ids of plan parameters: shifts, counts and dates, by the ISO rules alone."""

    def monday(self, week_id: int) -> dt.date:
        try:
            return dt.date.fromisocalendar(week_id // 100, week_id % 100, 1)
        except ValueError:
            raise ValueError(f"there is no week {week_id}") from None

    def number(self, week_id: int) -> int:
        """Counter of a week."""
        return (self.monday(week_id) - FIRST_MONDAY).days // 7

    def at(self, number: int) -> int:
        """Id of the week with a counter."""
        year, week, _ = (FIRST_MONDAY + dt.timedelta(weeks=number)).isocalendar()
        return year * 100 + week

    def shifted(self, week_id: int, back: int) -> int:
        """Id of the week ``back`` weeks earlier, later when negative."""
        return self.at(self.number(week_id) - back)

    def count(self, week_from: int, week_to: int) -> int:
        return self.number(week_to) - self.number(week_from) + 1

    def between(self, week_from: int, week_to: int) -> list[int]:
        return [self.at(n) for n in range(self.number(week_from), self.number(week_to) + 1)]

    def days(self, week_from: int, week_to: int) -> tuple[dt.date, dt.date]:
        """First and last date of an inclusive week range."""
        if week_from > week_to:
            raise ValueError(f"no weeks from {week_from} to {week_to}")
        return self.monday(week_from), self.monday(week_to) + dt.timedelta(days=6)
