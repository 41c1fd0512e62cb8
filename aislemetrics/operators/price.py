"""Price response: daily price points and least-squares fits of units on price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.functions import stats
from aislemetrics.functions.calendar import Weeks
from aislemetrics.functions.columns import ratio, units
from aislemetrics.operators.items import as_list, in_formats, weeks_between
from aislemetrics.session import materialise

FORMATS = ("1", "2", "3", "4", "5")


def segment_cards(
    snapshots: DataFrame,
    seg_values: DataFrame,
    cards: DataFrame,
    snapshot_week: int,
    seg_type: str,
    values,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Cards of the persons in the segments, by the snapshot taken on the last date of a week.

    ``snapshots`` is (prsn_id, date_id, seg_value_id), ``seg_values`` (seg_value_id, seg_type_code,
    seg_value_code) and ``cards`` (card_id, prsn_id); a person may have several cards.  Weeks are ISO
    weeks unless ``dates`` (date_id, fis_week_id) holds a calendar of one's own: the date is then its
    latest of that week, found at run time.
    """
    wanted = seg_values.filter(
        (F.col("seg_type_code") == seg_type) & F.col("seg_value_code").isin(as_list(values))
    ).select("seg_value_id")
    if dates is None:
        taken = snapshots.filter(F.col("date_id") == F.lit(Weeks().days(snapshot_week, snapshot_week)[1]))
    else:
        last = dates.filter(F.col("fis_week_id") == snapshot_week).agg(F.max("date_id").alias("date_id"))
        taken = snapshots.join(last, "date_id", "left_semi")
    persons = taken.join(wanted, "seg_value_id", "left_semi")
    return cards.join(persons, "prsn_id", "left_semi").select("card_id").distinct()


def in_commercial_divisions(products: DataFrame, divisions) -> DataFrame:
    return products.filter(F.col("prod_comml_l30_code").isin(as_list(divisions)))


def price_points(
    items: DataFrame,
    products: DataFrame,
    cards: DataFrame,
    *,
    period: tuple[int, int] | None = None,
    weeks: Weeks | None = None,
    stores: DataFrame | None = None,
    formats=FORMATS,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., date_id, units, sales, ppu): daily units, sales and price per unit of the shoppers.

    ``by`` names product columns to keep apart.  The shoppers are a semi join before the aggregate,
    which Spark moves below the fact's own join, to the basket headers: other customers' lines are
    never shuffled by day, and a hot card is a matter of its baskets alone.
    """
    sold = items.filter((F.col("net_spend_amt") > 0) & F.col("card_id").isNotNull())
    sold = sold.join(cards.select("card_id"), "card_id", "left_semi")
    if period is not None:
        sold = weeks_between(sold, *period, weeks)
    if stores is not None:
        sold = in_formats(sold, stores, formats)
    if by:
        sold = sold.join(products.select(*dict.fromkeys(["prod_code", *by])).distinct(), "prod_code")
    else:
        sold = sold.join(products.select("prod_code"), "prod_code", "left_semi")
    daily = sold.groupBy(*by, "date_id").agg(
        F.sum(units()).alias("units"), F.sum("net_spend_amt").cast("double").alias("sales")
    )
    return daily.withColumn("ppu", F.round(ratio(F.col("sales"), F.col("units")), 2))


def exact_quantiles(values: DataFrame, keys: Sequence[str], wanted: dict[str, float], value: str = "value") -> DataFrame:
    """(keys..., one column for each of ``wanted``): exact linear quantiles by selecting ranks.

    Equal values are counted first.  The counted values are dealt over tasks by range, every task's total
    gives the ranks at which the next one starts, and running counts inside the tasks then tell which
    values stand at the ranks sought: no task holds all values of a group.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "quantile-values")  # parts stay as they were dealt, whatever is computed again
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("m"))
    starts = totals.select(
        *[F.col(c).alias(f"_{c}") for c in (*keys, "part")],
        F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"),
        (F.sum("m").over(group) - 1).alias("last"),
    )
    running = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "part")]
    placed = dealt.withColumn("upto", running).join(starts, same).withColumn("upto", F.col("upto") + F.col("start"))

    def at(rank: F.Column) -> F.Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col(value)))

    found = []
    for name, share in wanted.items():
        place = F.col("last") * share
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return placed.groupBy(*keys).agg(*found)


def describe(points: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, count, mean, std, min, q25, q50, q75, max), quartiles exact and linear."""
    keys = [*by, "column"]
    long = points.unpivot(list(by), list(columns), "column", "value")
    plain = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, keys, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    quartiles = quartiles.withColumnsRenamed({c: f"_{c}" for c in keys})
    joined = plain.join(quartiles, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left")
    return joined.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def fit_price(
    points: DataFrame, degree: int, by: Sequence[str] = (), x: str = "ppu", y: str = "units"
) -> DataFrame:
    """(by..., n, coef_0.., mse, r2, min_x, max_x): one fit per group, all groups in one aggregate.

    ``coef_0`` is the intercept, ``mse`` divides by n.
    """
    whole = points.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL")
    aggs = [e.alias(name) for name, e in stats.moment_columns(x, y).items()]
    aggs += [F.min(x).alias("min_x"), F.max(x).alias("max_x")]
    fits = stats.add_coefficients(whole.groupBy(*by).agg(*aggs), degree)
    return fits.select(*by, "n", *_coefs(degree), "mse", "r2", "min_x", "max_x")


def _coefs(degree: int) -> list[str]:
    return [f"coef_{i}" for i in range(degree + 1)]


def _predicted(degree: int, x: str) -> F.Column:
    curve = f" + coef_2 * {x} * {x}" if degree == 2 else ""
    return F.expr(f"coef_0 + coef_1 * {x}{curve}")


def _residual_sums(points: DataFrame, degree: int, by: Sequence[str], x: str, y: str, order_by: str) -> DataFrame:
    """Per group the moment columns, and sums over the residuals in the order of ``order_by``.

    Points are daily totals, so a group's window holds one row per day.  Fit, residuals and sums
    share one shuffle by group.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))
    moments = {name: e.over(group) for name, e in stats.moment_columns(x, y).items()}
    whole = points.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").withColumns(moments)
    error = F.col(y) - _predicted(degree, x)
    errors = stats.add_coefficients(whole, degree).select(*by, order_by, *stats.MOMENTS, error.alias("e"))
    errors = errors.withColumn("step", F.col("e") - F.lag("e").over(group.orderBy(order_by)))
    return errors.groupBy(*by).agg(
        *[F.first(name).alias(name) for name in stats.MOMENTS],
        F.expr("skewness(e) AS skew"),
        F.expr("kurtosis(e) + 3 AS kurtosis"),
        F.expr("try_divide(sum(step * step), sum(e * e)) AS durbin_watson"),
    )


def fit_summary(
    points: DataFrame,
    degree: int,
    by: Sequence[str] = (),
    x: str = "ppu",
    y: str = "units",
    order_by: str = "date_id",
) -> DataFrame:
    """One row per group: the fit, its standard errors, and the usual residual statistics.

    Durbin-Watson takes the residuals in the order of ``order_by``.
    """
    fits = stats.add_coefficients(_residual_sums(points, degree, by, x, y, order_by), degree)
    fits = stats.add_quality(stats.add_uncertainty(fits, degree), degree)
    terms = [f"{part}_{i}" for part in ("coef", "std_err", "t") for i in range(degree + 1)]
    whole = ["mse", "r2", "adj_r2", "f_value", "log_likelihood", "aic", "bic", "durbin_watson", "skew", "kurtosis"]
    normality = ["jarque_bera", "prob_jb", "omnibus", "prob_omnibus"]
    return stats.add_normality(fits).select(*by, "n", "dof", *terms, *whole, *normality, "cond_no")


def coefficient_tests(summary: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """(by..., term, coef, std_err, t, p_value, low, high, prob_f), one row per coefficient."""
    k = sum(c.startswith("coef_") for c in summary.columns)
    terms = ", ".join(f"struct({i} AS term, coef_{i} AS coef, std_err_{i} AS std_err, t_{i} AS t)" for i in range(k))
    # The margin is the same for a group's coefficients: once a group, before they become rows.
    wide = summary.withColumn("width", stats.t_margin(F.col("dof"), alpha))
    rows = wide.selectExpr(*by, "cast(dof as double) AS dof", "f_value", "width", f"inline(array({terms}))")
    # With one slope, F is the square of its t; F(2, d) has a closed tail.
    dof = F.col("dof")
    prob_f = stats.t_p_value(F.sqrt("f_value"), dof) if k == 2 else F.expr(stats.F_TAIL_TWO)
    tested = rows.withColumns(
        {
            "p_value": stats.t_p_value(F.col("t"), dof),
            "margin": F.col("width") * F.col("std_err"),
            "prob_f": prob_f,
        }
    )
    low_high = ["coef - margin AS low", "coef + margin AS high"]
    return tested.selectExpr(*by, "term", "coef", "std_err", "t", "p_value", *low_high, "prob_f")


def predict_grid(fits: DataFrame, degree: int, by: Sequence[str] = (), step: float = 0.01) -> DataFrame:
    """(by..., ppu, predicted): the fitted curve from the lowest price up to, not including, the highest.

    Counts whole steps, so the grid carries no rounding drift.
    """
    grid = fits.selectExpr("*", f"cast(ceil(round((max_x - min_x) / {step}D, 6)) as bigint) AS _steps")
    grid = grid.filter("_steps > 0").selectExpr("*", "explode(sequence(0L, _steps - 1)) AS _i")
    grid = grid.withColumn("ppu", F.expr(f"round(min_x + _i * {step}D, 6)"))
    return grid.select(*by, "ppu", _predicted(degree, "ppu").alias("predicted"))
