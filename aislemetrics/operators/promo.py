"""Roll a promotion's products up to the hierarchy nodes they belong to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.functions.columns import ratio, row_sum

# Level of analysis -> prefix of the product table's code and description columns.
LEVELS = {"subclass": "prod_hier_l10", "class": "prod_hier_l20"}


@dataclass(frozen=True)
class PromoRollup:
    products: DataFrame
    share: DataFrame | None


def promo_rollup(products: DataFrame, promo: DataFrame, level: str, zero_fill: bool = False) -> PromoRollup:
    """Products for analysis, and each promoted node's share of promoted products.

    ``product`` keeps the list as given.  ``subclass`` and ``class`` take all products of every
    promoted node.  A node with no promoted (or no other) product left has a null count there,
    and so a null total and percent, unless ``zero_fill``.
    """
    if level == "product":
        return PromoRollup(promo, None)
    if level not in LEVELS:
        raise ValueError(f"level must be 'product' or one of {sorted(LEVELS)}, not {level!r}")
    code, desc = f"{LEVELS[level]}_code", f"{LEVELS[level]}_desc"

    listed = promo.select("prod_code").distinct()
    nodes = products.join(listed, "prod_code", "left_semi").select(code).distinct()
    rolled = products.join(nodes, code, "left_semi").select(code, desc, "prod_code").distinct()
    return PromoRollup(rolled.select("prod_code").distinct(), promo_share(rolled, listed, code, desc, zero_fill))


def promo_share(products: DataFrame, listed: DataFrame, code: str, desc: str, zero_fill: bool = False) -> DataFrame:
    """Per node: products on the promotion list, products off it, all of them, and the listed percentage.

    One left join marks the listed products; a node's two counts are sums over its rows.
    """
    marks = listed.select("prod_code", F.lit(1).alias("on_list"))
    off_list = F.count("*") - F.count("on_list")
    nodes = products.join(marks, "prod_code", "left").groupBy(code, desc).agg(
        *(
            (n if zero_fill else F.nullif(n, F.lit(0))).alias(name)
            for name, n in (("n_listed", F.count("on_list")), ("n_other", off_list))
        )
    )
    total = row_sum([F.col("n_listed"), F.col("n_other")])
    percent = F.round(ratio(F.col("n_listed"), total) * 100, 2)
    return nodes.withColumns({"n_products": total, "pct_listed": percent}).orderBy(F.desc_nulls_last("pct_listed"), code)
