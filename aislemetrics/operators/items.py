"""Slices and filters of the item fact."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.functions.calendar import Weeks, day_of_week

# Rows without a card all share the null join key; they are spread over this many join keys.
NULL_KEY_SPREAD = 1024


def as_list(values) -> list:
    """A scalar stands for a one-element list."""
    if isinstance(values, Iterable) and not isinstance(values, str):
        return list(values)
    return [values]


def weeks_between(items: DataFrame, week_from: int, week_to: int, weeks: Weeks | None = None) -> DataFrame:
    """Inclusive week range.  With the week table, the date bounds go down to the scan too."""
    kept = items.filter(F.col("fis_week_id").between(week_from, week_to))
    if weeks is not None:
        kept = kept.filter(F.col("date_id").between(*weeks.days(week_from, week_to)))
    return kept


def in_formats(items: DataFrame, stores: DataFrame, formats) -> DataFrame:
    scope = stores.filter(F.col("format_code").isin(as_list(formats))).select("store_id")
    return items.join(scope, "store_id", "left_semi")


def tag_customers(baskets: DataFrame, segments: DataFrame) -> DataFrame:
    """Left join of the customer tags on ``card_id``, for basket headers or for whole lines.

    A basket has one card, so tags are best joined to the headers, before the lines.  A row without
    a card matches nothing, so it gets a spread-out second key instead of meeting all other such
    rows in one join task.
    """
    no_card = F.col("card_id").isNull()
    spread = F.pmod(F.xxhash64("transaction_fid"), F.lit(NULL_KEY_SPREAD)) + 1
    left = baskets.withColumn("_spread", F.when(no_card, spread).otherwise(F.lit(0)))
    right = segments.withColumn("_spread", F.when(no_card, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return left.join(right, ["card_id", "_spread"], "left").drop("_spread")


def item_slice(
    items: DataFrame,
    week_from: int,
    week_to: int,
    *,
    weeks: Weeks | None = None,
    stores: DataFrame | None = None,
    formats=None,
    segments: DataFrame | None = None,
) -> DataFrame:
    """Item fact between two weeks, optionally of some store formats and with customer tags."""
    sliced = weeks_between(items, week_from, week_to, weeks)
    if formats is not None:
        sliced = in_formats(sliced, stores, formats)
    if segments is not None:
        sliced = tag_customers(sliced, segments)
    return sliced


def end_customer_baskets(
    baskets: DataFrame, segments: DataFrame, traders: Sequence[str] = ("Trader", "trader")
) -> DataFrame:
    """Basket headers of card holders that are not traders, tagged; an unknown tag is dropped.

    A plain inner join of headers with the wanted customers: rows without a card go before it.
    """
    wanted = segments.filter(~F.col("kptr_seg").isin(list(traders)))
    return baskets.filter(F.col("card_id").isNotNull()).join(wanted, "card_id")


def end_customers(items: DataFrame, traders: Sequence[str] = ("Trader", "trader")) -> DataFrame:
    """Card holders that are not traders; an unknown tag (null) is dropped as well."""
    return items.filter(F.col("card_id").isNotNull()).filter(~F.col("kptr_seg").isin(list(traders)))


def filter_day_of_week(items: DataFrame, days, dates: DataFrame | None = None) -> DataFrame:
    """Items of the given week days; adds ``fis_day_of_week_num``.

    The day follows from the date; a caller with a date table of its own may give that instead.
    """
    if dates is None:
        dated = items.withColumn("fis_day_of_week_num", day_of_week(F.col("date_id")))
    else:
        own = dates.select(F.col("date_id").cast("date").alias("date_id"), "fis_day_of_week_num")
        dated = items.join(own, "date_id")
    return dated.filter(F.col("fis_day_of_week_num").isin(as_list(days)))


def filter_products(items: DataFrame, products: DataFrame, codes) -> DataFrame:
    """Items of the given products, as far as the product table knows them.

    ``codes`` is a code, a list of codes, or a frame with ``prod_code``.
    """
    if isinstance(codes, DataFrame):
        wanted = products.join(codes.select("prod_code"), "prod_code", "left_semi")
    else:
        wanted = products.filter(F.col("prod_code").isin(as_list(codes)))
    return items.join(wanted.select("prod_code"), "prod_code", "left_semi")


def in_divisions(products: DataFrame, divisions) -> DataFrame:
    return products.filter(F.col("prod_hier_l50_code").isin(as_list(divisions)))


def of_styles(products: DataFrame, styles: DataFrame) -> DataFrame:
    """Products of the listed styles."""
    return products.join(styles.select("prod_style_code"), "prod_style_code", "left_semi")


def product_levels(products: DataFrame, level: str, divisions=None) -> DataFrame:
    """Distinct (prod_code, level) pairs in scope."""
    scope = products if divisions is None else in_divisions(products, divisions)
    return scope.select(*dict.fromkeys(["prod_code", level])).distinct()


def like_for_like_stores(items: DataFrame) -> DataFrame:
    """Stores that sold in every week present in ``items``."""
    store_weeks = items.select("store_id", "fis_week_id").distinct()
    n_weeks = store_weeks.agg(F.countDistinct("fis_week_id")).scalar()
    return store_weeks.groupBy("store_id").agg(F.count("*").alias("n_wk")).filter(F.col("n_wk") == n_weeks)
