"""Factors of need states by the principal-component method: loadings, members and customer scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.functions.columns import ratio, strip_prefix
from aislemetrics.operators.components import principal_components, project


def factor_loadings(
    matrix: DataFrame, features: Sequence[str], n_factor: int = 11, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., feature, factor, loading, uniqueness) of the features' correlation.

    A loading is a feature's correlation with a component; factors are ordered by what they explain,
    and the largest loading of each is positive.  They are not rotated.  A constant feature is kept,
    with null loadings.
    """
    found = principal_components(matrix, features, n_factor, "corr", by)
    loading = F.col("weight") * F.sqrt(F.greatest(F.col("eigenvalue"), F.lit(0.0)))
    loaded = found.select(*by, "feature", F.col("component").alias("factor"), loading.alias("loading"))
    shared = F.sum(F.col("loading") * F.col("loading")).over(Window.partitionBy(*by, "feature"))
    return loaded.withColumn("uniqueness", 1 - shared)


def factor_members(
    loadings: DataFrame, products: DataFrame, factor: int, min_abs: float = 0.3, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., prod_hier_l10_code, prod_hier_l10_desc, loading): the subclasses that load on a factor."""
    shown = loadings.filter((F.col("factor") == factor) & (F.abs("loading") >= min_abs))
    shown = shown.select(*by, strip_prefix(F.col("feature")).alias("prod_hier_l10_code"), "loading")
    names = products.select("prod_hier_l10_code", "prod_hier_l10_desc").distinct()
    return shown.join(names, "prod_hier_l10_code").select(*by, "prod_hier_l10_code", "prod_hier_l10_desc", "loading")


def factor_scores(
    need: DataFrame, loadings: DataFrame, stats: DataFrame, n_factor: int, by: Sequence[str] = (), key: str = "card_id"
) -> DataFrame:
    """(by..., key, factor_1..n): every customer's standardised features weighted by the loadings.

    ``stats`` is (by..., feature, mean, std).  A feature that a customer lacks counts as 0 before it
    is standardised, so the sum over the features present is shifted by one constant per factor.
    """
    scaled = loadings.join(stats.select(*by, "feature", "mean", "std"), [*by, "feature"])
    scaled = scaled.select(*by, "feature", "factor", "mean", ratio(F.col("loading"), F.col("std")).alias("weight"))
    shift = [
        F.coalesce(F.sum(F.when(F.col("factor") == i, F.col("mean") * F.col("weight"))), F.lit(0.0)).alias(f"shift_{i}")
        for i in range(1, n_factor + 1)
    ]
    shifts = scaled.groupBy(*by).agg(*shift)
    sums = project(need, scaled, "factor", "weight", n_factor, by, key, prefix="factor")
    sums = sums.join(shifts, list(by)) if by else sums.join(F.broadcast(shifts))
    return sums.select(
        *by, key, *[(F.col(f"factor_{i}") - F.col(f"shift_{i}")).alias(f"factor_{i}") for i in range(1, n_factor + 1)]
    )
