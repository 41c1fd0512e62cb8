"""Need states: how a customer's visits and spend divide over product subclasses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.functions.columns import feature_name, ratio
from aislemetrics.operators.items import product_levels

SUBCLASS = "prod_hier_l10_code"


def _in_scope(lines: DataFrame, products: DataFrame, divisions, baskets: DataFrame | None) -> DataFrame:
    """Lines of card holders with their subclass; ``baskets`` has the headers if the lines lack them.

    Products come before baskets: rows joined on the basket last stay partitioned by basket, which
    is the partitioning that the groupings by card and basket need.
    """
    found = lines.join(product_levels(products, SUBCLASS, divisions), "prod_code")
    if baskets is not None:
        held = baskets.filter(F.col("card_id").isNotNull()).select("transaction_fid", "card_id")
        found = found.select("transaction_fid", SUBCLASS, "net_spend_amt").join(held, "transaction_fid")
    return found.filter(F.col("card_id").isNotNull())


def _basket_parts(lines: DataFrame, products: DataFrame, divisions, baskets: DataFrame | None) -> DataFrame:
    """Spend per card, basket and subclass: counting rows then replaces counting distinct baskets.

    Lines combine on the map side, so a hot card or basket leaves one row per subclass of a basket.
    """
    joined = _in_scope(lines, products, divisions, baskets)
    return joined.groupBy("card_id", "transaction_fid", SUBCLASS).agg(F.sum("net_spend_amt").alias("spend"))


def card_subclass_metrics(
    lines: DataFrame, products: DataFrame, divisions=None, baskets: DataFrame | None = None
) -> DataFrame:
    """Visits and sales per card and subclass."""
    parts = _basket_parts(lines, products, divisions, baskets)
    return parts.groupBy("card_id", SUBCLASS).agg(
        F.count("*").alias("subcl_visits"), F.sum("spend").alias("subcl_sales")
    )


def card_metrics(
    lines: DataFrame, products: DataFrame, divisions=None, baskets: DataFrame | None = None
) -> DataFrame:
    """Visits and sales per card, over the divisions in scope."""
    joined = _in_scope(lines, products, divisions, baskets)
    baskets = joined.groupBy("card_id", "transaction_fid").agg(F.sum("net_spend_amt").alias("spend"))
    return baskets.groupBy("card_id").agg(F.count("*").alias("visits"), F.sum("spend").alias("sales"))


def need_state(
    lines: DataFrame, products: DataFrame, divisions=None, baskets: DataFrame | None = None
) -> DataFrame:
    """(card_id, subcl, pct_visits, pct_sales); baskets without a card have no need state.

    One chain instead of two aggregates and a join: each basket is counted in its first subclass
    only, so a card's distinct baskets are a plain sum over its subclasses.  Windows hold the
    subclasses of one basket, then those of one card.
    """
    basket, card = Window.partitionBy("card_id", "transaction_fid"), Window.partitionBy("card_id")
    first = F.when(F.col(SUBCLASS) == F.min(SUBCLASS).over(basket), F.lit(1)).otherwise(F.lit(0))
    counted = _basket_parts(lines, products, divisions, baskets).withColumn("first", first)
    counted = counted.groupBy("card_id", SUBCLASS).agg(
        F.count("*").alias("subcl_visits"), F.sum("spend").alias("subcl_sales"), F.sum("first").alias("firsts")
    )
    totals = counted.withColumns({"visits": F.sum("firsts").over(card), "sales": F.sum("subcl_sales").over(card)})
    return totals.select(
        "card_id",
        feature_name(F.col(SUBCLASS)).alias("subcl"),
        ratio(F.col("subcl_visits"), F.col("visits")).alias("pct_visits"),
        ratio(F.col("subcl_sales").cast("double"), F.col("sales").cast("double")).alias("pct_sales"),
    )


def feature_values(products: DataFrame, divisions=None) -> list[str]:
    """Sorted feature names, from the product table: the pivot's explicit values."""
    names = product_levels(products, SUBCLASS, divisions).select(feature_name(F.col(SUBCLASS)).alias("f")).distinct()
    return sorted(row.f for row in names.collect())


def need_matrix(
    need: DataFrame,
    features: Sequence[str],
    value: str = "pct_visits",
    keys: Sequence[str] = ("card_id",),
    feature: str = "subcl",
) -> DataFrame:
    """Wide, zero-filled matrix: one row per card, one column per feature."""
    wide = need.groupBy(*keys).pivot(feature, list(features)).agg(F.first(value))
    return wide.fillna(0, subset=list(features))
