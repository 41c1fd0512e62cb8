"""Covariance, scatter and correlation of customer features, in long form (by..., i, j, value).

Input is the long feature table (by..., key, feature, value); a feature a key lacks counts as 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetrics.functions.columns import ratio
from aislemetrics.session import materialise

# Rows of partial sums a task hands on at a time.
CHUNK = 100_000
# Scatter of a constant column, relative to its squares: what rounding leaves.
FLAT = 1e-26

_PARTIAL = ("n", "mi", "mj", "cii", "cjj", "cij")


def pair_sums(matrix: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., i, j, n, mi, mj, sii, sjj, sij) for i <= j, from a wide zero-filled matrix.

    ``mi`` and ``mj`` are the means, ``sij`` the cross products about them: nothing cancels where a
    mean is many times the spread.  Each task multiplies its rows' matrix with itself, one segment
    after the other, so it holds the sums of one segment; what is shuffled is one row per task,
    segment and pair - never a pair of features per customer.  Nulls and NaN are refused.
    """
    features = list(features)
    keys = list(by)
    k = len(features)

    def flush(group: tuple, n: int, mean: np.ndarray, cross: np.ndarray) -> Iterator[pd.DataFrame]:
        own = dict(zip(keys, group))
        rows = max(1, CHUNK // max(k, 1))
        for low in range(0, k, rows):
            i, j = np.triu_indices(min(low + rows, k) - low, low, k)
            i = i + low
            sums = {"n": n, "mi": mean[i], "mj": mean[j], "cii": cross[i, i], "cjj": cross[j, j], "cij": cross[i, j]}
            yield pd.DataFrame({**own, "i": i, "j": j, **sums})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]
            for group, rows in groups:
                x = rows[features].to_numpy(dtype=float)
                if np.isnan(x).any():
                    raise ValueError("a feature is null or NaN: fill the matrix first")
                mean = x.mean(axis=0)
                centred = x - mean
                block = (len(x), mean, centred.T @ centred)
                if held is not None and held[0] == group:
                    held = (group, *_merged(held[1:], block))
                else:
                    if held is not None:
                        yield from flush(*held)
                    held = (group, *block)
        if held is not None:
            yield from flush(*held)

    schema = T.StructType([matrix.schema[c] for c in keys])
    schema = schema.add("i", T.IntegerType()).add("j", T.IntegerType()).add("n", T.LongType())
    for name in _PARTIAL[1:]:
        schema = schema.add(name, T.DoubleType())
    source = matrix.select(*keys, *[F.col(f"`{f}`") for f in features])
    partial = (source.sortWithinPartitions(*keys) if keys else source).mapInPandas(add_up, schema)
    return _total(partial, features, keys)


def _merged(one: tuple, two: tuple) -> tuple:
    """Count, means and centred cross products of two blocks together."""
    (n1, m1, c1), (n2, m2, c2) = one, two
    step = m2 - m1
    return n1 + n2, m1 + step * (n2 / (n1 + n2)), c1 + c2 + np.outer(step, step) * (n1 * n2 / (n1 + n2))


def _total(partial: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Merge the tasks' sums about the overall means: one shuffle, of a row per task and pair."""
    pair = Window.partitionBy(*keys, "i", "j")
    rows = F.sum("n").over(pair)
    means = {f"all_{m}": F.sum(F.col("n") * F.col(m)).over(pair) / rows for m in ("mi", "mj")}
    off = {m: F.col(m) - F.col(f"all_{m}") for m in ("mi", "mj")}

    def about_mean(cross: str, first: str, second: str) -> F.Column:
        return F.sum(F.col(cross) + F.col("n") * off[first] * off[second])

    summed = partial.withColumns(means).groupBy(*keys, "i", "j").agg(
        F.sum("n").alias("n"),
        F.first("all_mi").alias("mi"),
        F.first("all_mj").alias("mj"),
        about_mean("cii", "mi", "mi").alias("sii"),
        about_mean("cjj", "mj", "mj").alias("sjj"),
        about_mean("cij", "mi", "mj").alias("sij"),
    )
    names = F.split(F.lit("\x01".join(features)), "\x01")
    named = {c: F.element_at(names, F.col(c) + 1) for c in ("i", "j")}
    return summed.withColumns(named).select(*keys, "i", "j", "n", "mi", "mj", "sii", "sjj", "sij")


def sparse_vectors(
    need: DataFrame, by: Sequence[str] = (), key: str = "card_id", feature: str = "subcl", value: str = "pct_visits"
) -> DataFrame:
    """(by..., key, features, values): one sparse vector a customer, its features in order.

    ``need`` has a row a customer and feature; its rows are spread by both before they meet in a vector.
    """
    cells = F.sort_array(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).cast("double").alias("v"))))
    held = need.groupBy(*by, key).agg(cells.alias("_c"))
    return held.select(*by, key, F.col("_c.f").alias("features"), F.col("_c.v").alias("values"))


def sparse_pair_sums(vectors: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``pair_sums`` of sparse vectors (by..., features, values): what a vector lacks counts as 0.

    A task multiplies the entries that a vector has with each other, and sums them by pair of features
    before it hands them on, so its work and memory follow the entries and not the square of the
    features; the means are put in when the tasks' sums have met.  No pivot, and no dense row.  Features
    outside ``features`` are left out; nulls and NaN are refused.  What rounding leaves of a constant
    feature's scatter is taken as 0.
    """
    features, keys = list(features), list(by)
    place, k = {f: n for n, f in enumerate(features)}, len(features)

    def summed(codes: list, x: list, xy: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds, at = np.unique(np.concatenate(codes), return_inverse=True)
        return kinds, np.bincount(at, np.concatenate(x), len(kinds)), np.bincount(at, np.concatenate(xy), len(kinds))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            for group, (n, *parts) in held.items():
                codes, x, xy = summed(*parts)
                rows = {"i": codes // k, "j": codes % k, "n": 0, "x": x, "xy": xy}
                yield pd.DataFrame({**dict(zip(keys, group)), **rows})
                yield pd.DataFrame({**dict(zip(keys, group)), "i": [-1], "j": [-1], "n": [n], "x": [0.0], "xy": [0.0]})
            held.clear()

        for batch in batches:
            for row in batch.itertuples(index=False):
                own = held.setdefault(tuple(row[: len(keys)]), [0, [], [], []])
                own[0] += 1
                v = np.asarray(row[-1], float)
                if np.isnan(v).any():
                    raise ValueError("a feature is null or NaN: fill the matrix first")
                index = np.array([place.get(f, -1) for f in row[-2]], np.int64)
                index, v = index[index >= 0], v[index >= 0]
                order = np.argsort(index)
                index, v = index[order], v[order]
                first, second = np.triu_indices(len(index))
                own[1].append(index[first] * k + index[second])
                own[2].append(np.where(first == second, v[first], 0.0))
                own[3].append(v[first] * v[second])
                size += len(first)
                if size > 10 * CHUNK:  # sum what is held; hand it on where it does not shrink
                    for part in held.values():
                        part[1:] = [[x] for x in summed(*part[1:])]
                    size = sum(len(x) for part in held.values() for x in part[1])
                    if size > 5 * CHUNK:
                        yield from flush()
                        size = 0
        yield from flush()

    schema = T.StructType([vectors.schema[c] for c in keys]).add("i", T.IntegerType()).add("j", T.IntegerType())
    schema = schema.add("n", T.LongType()).add("x", T.DoubleType()).add("xy", T.DoubleType())
    tasks = vectors.select(*keys, "features", "values").mapInPandas(add_up, schema)
    cells = tasks.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xy").alias("xy"))
    cells = materialise(cells, "sparse-cells")
    rows = cells.filter("i = -1").select(*keys, "n")
    one = rows.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")) if k else rows.withColumn("i", F.lit(0)).limit(0)
    own = cells.filter("i = j").select(*keys, "i", "x", "xy")
    mean, square = F.coalesce("x", F.lit(0.0)) / F.col("n"), F.coalesce("xy", F.lit(0.0))
    scatter = square - F.col("n") * mean * mean
    scatter = F.when(scatter <= square * 1e-12, F.lit(0.0)).otherwise(scatter)
    one = one.join(own, [*keys, "i"], "left").select(*keys, "n", "i", mean.alias("mi"), scatter.alias("sii"))
    other = one.select(*keys, F.col("i").alias("j"), F.col("mi").alias("mj"), F.col("sii").alias("sjj"))
    pairs = one.withColumn("j", F.explode(F.sequence("i", F.lit(k - 1)))).join(other, [*keys, "j"])
    cross = F.coalesce("xy", F.lit(0.0)) - F.col("n") * F.col("mi") * F.col("mj")
    cross = F.when(F.col("i") == F.col("j"), F.col("sii")).otherwise(cross)
    pairs = pairs.join(cells.select(*keys, "i", "j", "xy"), [*keys, "i", "j"], "left")
    names = F.split(F.lit("\x01".join(features)), "\x01")
    named = {c: F.get(names, F.col(c)) for c in ("i", "j")}
    return pairs.withColumn("sij", cross).withColumns(named).select(*keys, "i", "j", "n", "mi", "mj", "sii", "sjj", "sij")


def _mirrored(sums: DataFrame, by: Sequence[str], value: F.Column, name: str) -> DataFrame:
    """Fill the lower triangle from the upper one."""
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    sides = F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)
    valued = sums.select(*by, F.explode(sides).alias("_p"), value.alias(name))
    return valued.select(*by, "_p.i", "_p.j", name)


def scatter_of(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., i, j, s): cross products of the centred columns."""
    return _mirrored(sums, by, F.col("sij"), "s")


def _per_degree(column: str) -> F.Column:
    return ratio(F.col(column), (F.col("n") - 1).cast("double"))


def covariance_of(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., i, j, cov): sample covariance, divided by n - 1."""
    return _mirrored(sums, by, _per_degree("sij"), "cov")


def _flat(s: str, m: str) -> F.Column:
    """What a constant column leaves after centring is rounding noise."""
    return F.col(s) <= F.col("n") * F.col(m) * F.col(m) * FLAT


def correlation_of(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., i, j, r): Pearson correlation.

    A constant column has 1 on the diagonal and null off it.
    """
    r = ratio(F.col("sij"), F.sqrt("sii") * F.sqrt("sjj"))
    moving = ~_flat("sii", "mi") & ~_flat("sjj", "mj")
    value = F.when(F.col("i") == F.col("j"), F.lit(1.0)).when(moving, r)
    return _mirrored(sums, by, value, "r")


def feature_stats_of(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, n, mean, std): sample statistics, from the diagonal of the sums.

    ``std`` is 0 for a constant feature.
    """
    diagonal = sums.filter(F.col("i") == F.col("j"))
    std = F.when(_flat("sii", "mi"), F.lit(0.0)).otherwise(F.sqrt(_per_degree("sii")))
    return diagonal.select(*by, F.col("i").alias("feature"), "n", F.col("mi").alias("mean"), std.alias("std"))


# The same in one go; who needs several of them takes the sums once.


def scatter(matrix: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return scatter_of(pair_sums(matrix, features, by), by)


def covariance(matrix: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return covariance_of(pair_sums(matrix, features, by), by)


def correlation(matrix: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return correlation_of(pair_sums(matrix, features, by), by)


def feature_stats(matrix: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return feature_stats_of(pair_sums(matrix, features, by), by)


def wide(long: DataFrame, features: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Long matrix as a table: one row per i, one column per j."""
    return long.groupBy(*by, "i").pivot("j", list(features)).agg(F.first(value))


def long_rows(table: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Labelled wide table to (label, feature, value)."""
    return table.unpivot([label], list(features), "feature", "value")


def explained(values: DataFrame, by: Sequence[str] = (), cut: float = 0.8) -> DataFrame:
    """(by..., component, eigenvalue, share, cum_share, gain, below_cut) of an eigenvalue table.

    ``gain`` is the step of the cumulative share, null for the first component; ``below_cut``
    counts the components whose cumulative share stays below the cut.  Windows hold k rows.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))
    in_order = group.orderBy("component")
    share = ratio(F.col("eigenvalue"), F.sum("eigenvalue").over(group))
    shared = values.select(*by, "component", "eigenvalue").distinct().withColumn("share", share)
    running = F.sum("share").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    shared = shared.withColumn("cum_share", running)
    return shared.withColumns(
        {
            "gain": F.col("cum_share") - F.lag("cum_share").over(in_order),
            "below_cut": F.count(F.when(F.col("cum_share") < cut, F.lit(1))).over(group),
        }
    )
