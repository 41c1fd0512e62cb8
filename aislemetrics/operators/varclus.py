"""Variable clustering: group features so that each is close to its own cluster's component.

Sums over the correlation table are DataFrame operators; components are taken in the tasks, each from
the correlations within one cluster.  The divisive search splits all open clusters of a depth together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetrics.functions.columns import ratio
from aislemetrics.operators import moments
from aislemetrics.operators.components import project, stacked
from aislemetrics.session import materialise


def cluster_weights(corr: DataFrame, assignment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., cluster, feature, weight) of each cluster's centroid, weights of length 1.

    ``assignment`` holds (by..., feature, cluster).  A feature without a correlation to any other
    one, since it is constant, is no part of its cluster: its weight is null.
    """
    keys = [*by, "cluster"]
    others = corr.filter((F.col("i") != F.col("j")) & F.col("r").isNotNull())
    moving = others.select(*by, F.col("i").alias("feature"), F.lit(1).alias("moves")).distinct()
    marked = assignment.join(moving, [*by, "feature"], "left")
    # A matrix of one feature has no other ones.
    lone = F.count("*").over(Window.partitionBy(*by)) if by else F.count("*").over(Window.partitionBy(F.lit(0)))
    marked = marked.withColumn("moves", F.when(lone == 1, F.lit(1)).otherwise(F.col("moves")))
    size = F.count("moves").over(Window.partitionBy(*keys))
    return marked.select(*keys, "feature", F.when(F.col("moves") == 1, 1 / F.sqrt(size)).alias("weight"))


def component_weights(
    matrix: DataFrame, features: Sequence[str], assignment: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """The same with each cluster's first principal component, from the customers' matrix.

    All clusters of all segments are decomposed in one job, a task taking one cluster's correlations at a time.
    """
    keys = [*by, "cluster"]
    sums = moments.pair_sums(matrix, features, by)
    corr = _inside(moments.correlation_of(sums, by), assignment, by)
    moving = moments.feature_stats_of(sums, by).select(*by, "feature", (F.col("std") > 0).alias("moves"))
    schema = T.StructType([corr.schema[c] for c in keys]).add("feature", T.StringType()).add("weight", T.DoubleType())

    def leading(pairs: pd.DataFrame) -> pd.DataFrame:
        names, table = _table(pairs)
        weights = np.linalg.eigh(table)[1][:, -1]
        weights = weights * (-1.0 if weights[np.round(np.abs(weights), 10).argmax()] < 0 else 1.0)
        return pd.DataFrame({**{c: pairs[c].iloc[0] for c in keys}, "feature": names, "weight": weights})

    weights = corr.groupBy(*keys).applyInPandas(leading, schema)
    members = assignment.select(*keys, "feature").join(weights, [*keys, "feature"], "left").join(moving, [*by, "feature"])
    return members.select(*keys, "feature", F.when(F.col("moves"), F.col("weight")).alias("weight"))


def _inside(corr: DataFrame, assignment: DataFrame, by: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(by..., cluster, i, j, r): the correlations within each cluster of (by..., feature, cluster); constant features fall out."""
    left = assignment.select(*by, F.col("feature").alias("i"), cluster)
    right = assignment.select(*by, F.col("feature").alias("j"), cluster)
    pairs = corr.join(left, [*by, "i"]).join(right, [*by, "j", cluster])
    return pairs.filter("r IS NOT NULL").select(*by, cluster, "i", "j", "r")


def _table(pairs: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Sorted feature names and the square table of one cluster's correlations, zero where there is none."""
    wide = pairs.pivot(index="i", columns="j", values="r").sort_index().sort_index(axis=1).fillna(0.0)
    return list(wide.index), wide.to_numpy(float)


def _nearness(corr: DataFrame, weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., feature, cluster, is_own, r, variance).

    One join and one sum over the correlation table; the diagonal carries each feature's weight
    in its own cluster.  Windows hold a row per feature.  A constant feature has null ``r``.
    """
    right = weights.withColumnRenamed("feature", "j")
    near = corr.join(right, [*by, "j"]).groupBy(*by, F.col("i").alias("feature"), "cluster")
    near = near.agg(
        F.expr("sum(r * weight) AS cov"),
        F.expr("max(CASE WHEN i = j THEN weight END) AS own"),
        F.expr("max(CASE WHEN i = j THEN 1 END) IS NOT NULL AS is_own"),
    )
    explained = F.sum(F.col("cov") * F.col("own")).over(Window.partitionBy(*by, "cluster"))
    return near.withColumn("variance", explained).select(
        *by, "feature", "cluster", "is_own", ratio(F.col("cov"), F.sqrt("variance")).alias("r"), "variance"
    )


def cluster_correlation(
    corr: DataFrame, assignment: DataFrame, weights: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., feature, cluster, r, variance): each feature against each cluster's component.

    ``variance`` is what the component explains.  Components are centroids unless ``weights`` has
    others.  A constant feature is kept, with null ``r``.
    """
    weights = cluster_weights(corr, assignment, by) if weights is None else weights
    return _nearness(corr, weights, by).drop("is_own")


def reassign(corr: DataFrame, assignment: DataFrame, max_iter: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, cluster, stable): move each feature to the centroid it correlates with most.

    Repeats ``max_iter`` times; ``stable`` tells whether the last round moved nothing.  Ties go to the
    first cluster; r^2 is compared to 12 digits, so that sums taken in another order do not break
    ties.  A constant feature stays where it is.  Lazy: a round adds one join with the correlation
    table to the plan.
    """
    moved = assignment.select(*by, "feature", "cluster", F.lit(False).alias("moved"))
    for _ in range(max_iter):
        near = _nearness(corr, cluster_weights(corr, moved.drop("moved"), by), by).groupBy(*by, "feature")
        best = "min_by(cluster, struct(CASE WHEN r IS NULL THEN 0 ELSE -round(r * r, 12) END, cluster))"
        moved = near.agg(
            F.expr(f"CASE WHEN max(r) IS NULL THEN max(CASE WHEN is_own THEN cluster END) ELSE {best} END AS cluster"),
            F.expr("max(CASE WHEN is_own THEN cluster END) AS last"),
        ).select(*by, "feature", "cluster", (F.col("cluster") != F.col("last")).alias("moved"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    return moved.select(*by, "feature", "cluster", (~F.max("moved").over(whole)).alias("stable"))


def r2_ratio(corr: DataFrame, assignment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, cluster, r2_own, r2_next, ratio), worst-fitting feature first.

    ``ratio`` is (1 - own) / (1 - next): above 1 the feature sits better in another cluster.
    """
    split = _nearness(corr, cluster_weights(corr, assignment, by), by).groupBy(*by, "feature")
    split = split.agg(
        F.expr("max(CASE WHEN is_own THEN cluster END) AS cluster"),
        F.expr("max(CASE WHEN is_own THEN r * r END) AS r2_own"),
        F.expr("max(CASE WHEN NOT is_own THEN r * r END) AS r2_next"),
    )
    rated = split.withColumn("ratio", F.expr("try_divide(1 - r2_own, 1 - r2_next)"))
    return rated.orderBy(*by, F.desc_nulls_last("ratio"), "feature")


# --- divisive search ------------------------------------------------------------------------------


def _quartimax_angle(pairs: list[tuple[float, float]]) -> float:
    """Turn of two columns that makes the sum of fourth powers largest; it has a closed form."""
    u, v = [a * a - b * b for a, b in pairs], [2 * a * b for a, b in pairs]
    return math.atan2(2 * sum(x * y for x, y in zip(u, v)), sum(x * x - y * y for x, y in zip(u, v))) / 4


def _two_sides(weights: dict[str, tuple[float, float]], values: tuple[float, float]) -> dict[str, int]:
    """Side 1 or 2 of each feature: the one of two turned components that it correlates with more.

    ``weights`` are the features' in the two leading components, ``values`` those components' eigenvalues.
    """
    angle = _quartimax_angle(list(weights.values()))
    turn, lift = math.cos(angle), math.sin(angle)
    first, second = values

    def pull(a: float, b: float, x: float, y: float) -> float:
        """Squared correlation of a feature with weights a, b with the component x, y."""
        explained = first * x * x + second * y * y
        return (first * x * a + second * y * b) ** 2 / explained if explained > 0 else 0.0

    return {
        f: 1 if pull(a, b, turn, lift) >= pull(a, b, -lift, turn) - 1e-12 else 2 for f, (a, b) in weights.items()
    }


def _split(corr: DataFrame, frontier: DataFrame, by: Sequence[str], max_iter: int) -> DataFrame:
    """(by..., path, feature, side, second): every cluster of ``frontier`` (by..., feature, path) in two sides.

    The sides come from the cluster's two leading components, whose second eigenvalue is ``second``;
    then every feature settles at the nearer centroid, unless that leaves one side empty.
    """
    keys = [*by, "path"]
    inside = materialise(_inside(corr, frontier, by, "path"), "clusters-inside")
    schema = T.StructType([inside.schema[c] for c in keys]).add("feature", T.StringType())
    schema = schema.add("start", T.IntegerType()).add("second", T.DoubleType())

    def sides(pairs: pd.DataFrame) -> pd.DataFrame:
        names, table = _table(pairs)
        values, vectors = np.linalg.eigh(table)
        weights = {f: (vectors[n, -1], vectors[n, -2]) for n, f in enumerate(names)}
        start = _two_sides(weights, (values[-1], values[-2]))
        own = {c: pairs[c].iloc[0] for c in keys}
        return pd.DataFrame({**own, "feature": names, "start": [start[f] for f in names], "second": values[-2]})

    start = materialise(inside.groupBy(*keys).applyInPandas(sides, schema), "clusters-start")
    settled = reassign(inside, start.withColumnRenamed("start", "cluster"), max_iter, keys)
    whole = Window.partitionBy(*keys)
    both = F.min("cluster").over(whole) < F.max("cluster").over(whole)
    joined = start.join(settled.select(*keys, "feature", "cluster"), [*keys, "feature"])
    return joined.select(*keys, "feature", F.when(both, F.col("cluster")).otherwise(F.col("start")).alias("side"), "second")


def _chosen(splits: pd.DataFrame, order: dict[str, int], max_clusters: int) -> list[list[str]]:
    """Clusters of one segment, from all splits of its tree: the one whose second component explains most is split next."""
    tree: dict[str, dict] = {}
    for path, node in splits.groupby("path", sort=False):
        members = sorted(zip(node["feature"], node["side"], strict=True), key=lambda m: order[m[0]])
        tree[path] = {"members": members, "second": node["second"].iloc[0]}
    clusters = [("", [f for f, _ in tree[""]["members"]])]
    done: set[str] = set()
    while len(clusters) < max_clusters:
        open_ = [c for c in clusters if c[0] in tree and len(c[1]) > 2 and c[0] not in done]
        if not open_:
            break
        worst = max(open_, key=lambda c: tree[c[0]]["second"])
        halves = [(f"{worst[0]}{side}", [f for f, s in tree[worst[0]]["members"] if s == side]) for side in (1, 2)]
        if all(members for _, members in halves):
            clusters = [c for c in clusters if c is not worst] + halves
        else:
            done.add(worst[0])
    return [members for _, members in clusters]


def variable_clusters(
    matrix: DataFrame, features: Sequence[str], max_clusters: int, max_iter: int = 3, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., cluster_num, feature_name): disjoint clusters of the features, split one by one.

    The cluster whose second component explains most is split next; clusters of two or fewer stay
    together.  A constant feature is kept, with a null cluster.

    A cluster's split does not hang on the other clusters', so the open clusters of one depth are split
    together, those of all segments in the same jobs; which splits count is decided in the end, segment
    by segment.  The number of jobs grows with the depth alone, at most ``max_clusters`` - 1.
    """
    by, order = list(by), {f: n for n, f in enumerate(features)}
    sums = materialise(moments.pair_sums(matrix, features, by), "sums")
    corr = materialise(moments.correlation_of(sums, by), "corr")
    stats = moments.feature_stats_of(sums, by).select(*by, "feature", (F.col("std") > 0).alias("moves"))
    root = stats.filter("moves").select(*by, "feature", F.lit("").alias("path"))
    # A tree of one node has no split; its features are one cluster.
    levels = [root.select(*by, "path", "feature", F.lit(1).alias("side"), F.lit(0.0).alias("second"))]
    frontier = root
    for depth in range(max_clusters - 1):
        size = F.count("*").over(Window.partitionBy(*by, "path"))
        frontier = frontier.withColumn("size", size).filter("size > 2").drop("size")
        level = materialise(_split(corr, frontier, by, max_iter), "clusters-level")
        if level.isEmpty():
            break
        levels.append(level)
        cut = F.min("side").over(Window.partitionBy(*by, "path")) < F.max("side").over(Window.partitionBy(*by, "path"))
        frontier = level.withColumn("cut", cut).filter("cut").select(*by, "feature", F.concat("path", F.col("side").cast("string")).alias("path"))
    splits = levels[0]
    for level in levels[1:]:
        splits = splits.unionByName(level)
    schema = T.StructType([matrix.schema[c] for c in by]).add("cluster_num", T.IntegerType()).add("feature_name", T.StringType())

    def chosen(tree: pd.DataFrame) -> pd.DataFrame:
        # The split of the root stands after the rows that stand for a tree without one.
        roots = tree[tree["path"] == ""]
        split = roots[roots["second"] > 0]
        tree = pd.concat([split if len(split) else roots, tree[tree["path"] != ""]])
        found = [(n, f) for n, members in enumerate(_chosen(tree, order, max_clusters), 1) for f in members]
        own = {c: tree[c].iloc[0] for c in by}
        return pd.DataFrame({**own, "cluster_num": [n for n, _ in found], "feature_name": [f for _, f in found]})

    grouped = splits.groupBy(*by) if by else splits.groupBy(F.lit(0).alias("_all"))
    clusters = grouped.applyInPandas(chosen, schema)
    constant = stats.filter("NOT moves").select(*by, F.lit(None).cast("int").alias("cluster_num"), F.col("feature").alias("feature_name"))
    return materialise(clusters.unionByName(constant), "clusters")


def cluster_scores(
    need: DataFrame,
    clusters: DataFrame,
    stats: DataFrame,
    max_clusters: int,
    by: Sequence[str] = (),
    key: str = "card_id",
) -> DataFrame:
    """(by..., key, cluster_num, score): sum of standardised features over the root of their number.

    ``stats`` is (by..., feature, mean, std).  Absent features count as 0, so a customer's sum over
    the features present is shifted by one constant per cluster.
    """
    size = F.count("*").over(Window.partitionBy(*by, "cluster_num"))
    members = clusters.select(*by, "cluster_num", F.col("feature_name").alias("feature"), F.sqrt(size).alias("root"))
    weights = members.join(stats, [*by, "feature"]).select(
        *by, "cluster_num", "feature", "mean", ratio(F.lit(1.0), F.col("std") * F.col("root")).alias("weight")
    )
    shift = weights.groupBy(*by, "cluster_num").agg(F.sum(F.col("mean") * F.col("weight")).alias("shift"))
    sums = project(need, weights, "cluster_num", "weight", max_clusters, by, key)
    scores = stacked(sums, "cluster_num", max_clusters, [*by, key]).join(shift, [*by, "cluster_num"])
    return scores.select(*by, key, "cluster_num", (F.col("score") - F.col("shift")).alias("score"))
