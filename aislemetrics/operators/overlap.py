"""How many customers product groups have in common, for every combination of groups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.functions.calendar import Weeks, day_of_week
from aislemetrics.operators.items import weeks_between

# Rows of the full report: 2^16.
MAX_GROUPS = 16
# Bits of a mask that one pass of the superset sums takes.
STRIDE = 4
CONTROL_SCHEMA = "prod_code string, bit int, fmt string, date_id date"


@dataclass(frozen=True)
class ProductGroup:
    """One row of the control file.  No format, or no dates, means any."""

    name: str
    products: Sequence[str]
    fmt: str | None = None
    dates: Sequence[dt.date] = ()


def control_table(spark: SparkSession, groups: Sequence[ProductGroup]) -> DataFrame:
    """(prod_code, bit, fmt, date_id): the control file, one row per product and date of a group."""
    rows = [
        (code, bit, group.fmt, date)
        for bit, group in enumerate(groups)
        for code in group.products
        for date in (group.dates or [None])
    ]
    return spark.createDataFrame(rows, CONTROL_SCHEMA)


def level_table(products: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """The same table for groups that are the values of one product column."""
    listed = products.filter(F.col(column).isin(list(values)))
    bit = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1
    return listed.select(
        "prod_code",
        bit.cast("int").alias("bit"),
        F.lit(None).cast("string").alias("fmt"),
        F.lit(None).cast("date").alias("date_id"),
    )


def card_masks(items: DataFrame, control: DataFrame) -> DataFrame:
    """(card_id, mask): bit g is set when the card bought from group g.

    A product's conditions ride along as one array, so the fact is read once and keeps its row
    count, whatever the number of groups.  Bits combine on the map side: a hot card sends one row
    per task.  Items need ``format_code`` only where the control table names formats.
    """
    conditions = control.distinct().groupBy("prod_code")
    conditions = conditions.agg(F.collect_list(F.struct("bit", "fmt", "date_id")).alias("conditions"))
    has_format = "format_code" in items.columns
    fmt = F.col("format_code") if has_format else F.lit(None).cast("string")

    def holds(c: F.Column) -> F.Column:
        any_format, any_date = c["fmt"].isNull(), c["date_id"].isNull()
        return (any_format | (c["fmt"] == fmt)) & (any_date | (c["date_id"] == F.col("date_id")))

    one = F.lit(1).cast("long")
    mask = F.aggregate(
        F.filter("conditions", holds),
        F.lit(0).cast("long"),
        lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", one, c["bit"])),
    )
    hits = items.filter(F.col("card_id").isNotNull()).join(conditions, "prod_code")
    hits = hits.select("card_id", mask.alias("mask")).filter(F.col("mask") != 0)
    return hits.groupBy("card_id").agg(F.bit_or("mask").alias("mask"))


def _superset_sums(by_mask: DataFrame, n: int) -> DataFrame:
    """(comb, n_custs): for every combination the sum over the masks that contain it.

    The zeta transform, ``STRIDE`` bits a pass: a mask yields its sub-masks in these bits only, and a
    pass leaves at most a row per combination, so 16 groups cost four passes of at most 5 x 65,536 rows
    instead of the 43 million sub-masks of all masks.
    """
    for low in range(0, n, STRIDE):
        part = ((1 << min(STRIDE, n - low)) - 1) << low
        parts = F.array(*[F.lit(sub << low).cast("long") for sub in range(1 << min(STRIDE, n - low))])
        rest = F.col("mask").bitwiseAND(F.lit(~part).cast("long"))
        own = F.filter(parts, lambda sub: F.col("mask").bitwiseAND(sub) == sub)
        held = by_mask.select(F.explode(F.transform(own, lambda sub: rest.bitwiseOR(sub))).alias("comb"), "n")
        by_mask = held.groupBy(F.col("comb").alias("mask")).agg(F.sum("n").alias("n"))
    return by_mask.select(F.col("mask").alias("comb"), F.col("n").alias("n_custs"))


def _small_subsets(by_mask: DataFrame, bits: F.Column, max_size: int) -> DataFrame:
    """(comb, n_custs) of the combinations of at most ``max_size`` groups that some mask contains."""
    own_bits = F.filter(bits, lambda b: F.col("mask").bitwiseAND(b) != 0)

    def grown(acc: F.Column, b: F.Column) -> F.Column:
        small = F.filter(acc, lambda x: F.bit_count(x) < max_size)
        return F.concat(acc, F.transform(small, lambda x: x.bitwiseOR(b)))

    subsets = F.aggregate(own_bits, F.array(F.lit(0).cast("long")), grown)
    return by_mask.select(F.explode(subsets).alias("comb"), "n").groupBy("comb").agg(F.sum("n").alias("n_custs"))


def combination_counts(masks: DataFrame, names: Sequence[str], max_size: int | None = None) -> DataFrame:
    """(comb_size, comb_flag, n_custs) per combination of groups.

    Cards are first counted by mask, at most one row per mask that occurs, and the counts are summed
    over the masks that contain a combination.  The full report lists every non-empty combination, zeros included, of up to
    ``MAX_GROUPS`` groups; with ``max_size`` it lists combinations of at most that many groups that
    some customer holds, for up to 63 groups.
    """
    n = len(names)
    if max_size is None and not 1 <= n <= MAX_GROUPS:
        raise ValueError(f"the full report has a row per combination: give 1 to {MAX_GROUPS} groups, or max_size")
    if not 1 <= n <= 63:
        raise ValueError(f"a mask holds 1 to 63 groups, not {n}")
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(n)])
    by_mask = masks.groupBy("mask").agg(F.count("*").alias("n"))
    held = _superset_sums(by_mask, n) if max_size is None else _small_subsets(by_mask, bits, max_size)

    labels = F.array(*[F.lit(name) for name in names])
    own_names = F.filter(labels, lambda _, i: F.col("comb").bitwiseAND(F.get(bits, i)) != 0)
    if max_size is None:
        combos = masks.sparkSession.range(1, 1 << n).withColumnRenamed("id", "comb")
    else:
        combos = held.select("comb").filter(F.col("comb") != 0)
    combos = combos.withColumns(
        {"comb_size": F.bit_count("comb").cast("int"), "comb_flag": F.array_join(own_names, " , ")}
    )
    counted = combos.join(held, "comb", "left")
    return counted.select("comb_size", "comb_flag", F.coalesce("n_custs", F.lit(0)).alias("n_custs"))


def customer_overlap(
    items: DataFrame,
    control: DataFrame,
    names: Sequence[str],
    stores: DataFrame | None = None,
    period: tuple[int, int] | None = None,
    weeks: Weeks | None = None,
) -> DataFrame:
    """Overlap report; ``names`` are the groups in the order of their bits."""
    if period is not None:
        items = weeks_between(items, *period, weeks)
    # The semi join moves below the fact's own joins.
    items = items.join(control.select("prod_code").distinct(), "prod_code", "left_semi")
    if stores is not None:
        items = items.join(stores.select("store_id", "format_code"), "store_id")
    return combination_counts(card_masks(items, control), names)


def daily_group_kpi(
    items: DataFrame,
    groups: DataFrame,
    stores: DataFrame,
    periods: dict[str, tuple[int, int]],
    weeks: Weeks | None = None,
) -> DataFrame:
    """Distinct baskets and cards per period, format, product group and date.

    ``groups`` holds (prod_gr, prod_code, format_code, fis_day_of_week_num), the exploded control
    file; ``periods`` maps a tag to an inclusive week range.  A basket has one card, so the baskets
    of each card are counted first and the cards after them: two plain groupings on the same rows.
    """
    tag = F.lit(None).cast("string")
    for name, (first, last) in periods.items():
        tag = F.when(F.col("fis_week_id").between(first, last), F.lit(name)).otherwise(tag)
    low, high = min(p[0] for p in periods.values()), max(p[1] for p in periods.values())
    sold = weeks_between(items, low, high, weeks).withColumn("year", tag).filter(F.col("year").isNotNull())
    sold = sold.join(groups.select("prod_code").distinct(), "prod_code", "left_semi")
    sold = sold.withColumn("fis_day_of_week_num", day_of_week(F.col("date_id")))
    sold = sold.join(stores.select("store_id", "format_code"), "store_id")
    grouped = sold.join(groups, ["prod_code", "format_code", "fis_day_of_week_num"])
    keys = ["year", "format_code", "prod_gr", "date_id", "fis_day_of_week_num"]
    baskets = grouped.select(*keys, "card_id", "transaction_fid").distinct()
    per_card = baskets.groupBy(*keys, "card_id").agg(F.count("*").alias("n"))
    # Baskets without a card are one group of their own, which is no card.
    return per_card.groupBy(*keys).agg(F.sum("n").alias("n_baskets"), F.count("card_id").alias("n_cards"))
