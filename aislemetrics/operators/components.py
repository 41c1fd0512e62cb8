"""Principal components, singular values and projections of customer feature tables.

The decomposition of a whole table is Spark ML's: its jobs sum up the rows, and the model comes back
as one small matrix of features by components.  Those of its segments are taken in the tasks, each
from one segment's sums, so that the number of jobs does not grow with that of the segments.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetrics.functions.columns import ratio
from aislemetrics.operators import moments

COMPONENTS = T.StructType(
    [
        T.StructField("component", T.IntegerType()),
        T.StructField("eigenvalue", T.DoubleType()),
        T.StructField("share", T.DoubleType()),
        T.StructField("feature", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)


def assembled(matrix: DataFrame, features: Sequence[str], column: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=column).transform(matrix)


def standardised(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """``features`` as a vector of columns with mean 0 and deviation 1; a constant column is all 0."""
    raw = assembled(matrix, features, "_raw")
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(raw).transform(raw)


def _decomposed(vectors: DataFrame, features: list[str], k: int, constant: set[str]) -> list[tuple]:
    """Rows of ``COMPONENTS`` for one table of vectors; the largest weight of a component is positive.

    A constant feature has no part in any component: its weights are null.
    """
    k = min(k, len(features) - len(constant))
    if k < 1:
        return [(1, None, None, feature, None) for feature in features]
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(vectors)
    spread = sum(vectors.select(Summarizer.variance(F.col("features"))).first()[0])
    weights, shares = model.pc.toArray(), model.explainedVariance.toArray()
    rows = []
    for c in range(k):
        peak = max(range(len(features)), key=lambda f: (round(abs(weights[f, c]), 10), -f))
        sign = -1.0 if weights[peak, c] < 0 else 1.0
        for f, feature in enumerate(features):
            weight = None if feature in constant else float(sign * weights[f, c])
            rows.append((c + 1, float(shares[c] * spread), float(shares[c]), feature, weight))
    return rows


def _by_segment(
    matrix: DataFrame, features: list[str], k: int, on: str, by: Sequence[str]
) -> DataFrame:
    """``principal_components`` of every segment: one shuffle of the segments' sums, however many there are.

    A task takes one segment's table of features by features at a time.
    """
    by, place = list(by), {f: n for n, f in enumerate(features)}
    schema = T.StructType([matrix.schema[c] for c in by] + list(COMPONENTS))

    def decomposed(sums: pd.DataFrame) -> pd.DataFrame:
        products, n = np.zeros((len(features), len(features))), int(sums["n"].iloc[0])
        i, j = sums["i"].map(place).to_numpy(), sums["j"].map(place).to_numpy()
        products[i, j] = products[j, i] = sums["sij"]
        means = np.zeros(len(features))
        means[i] = sums["mi"]
        spread = np.diagonal(products)
        flat = spread <= n * means**2 * moments.FLAT
        moving = np.flatnonzero(~flat)
        own = {c: sums[c].iloc[0] for c in by}
        if not len(moving):
            return pd.DataFrame({**own, "component": 1, "eigenvalue": None, "share": None, "feature": features, "weight": None})
        table = products[np.ix_(moving, moving)] / max(1, n - 1)
        if on != "rows":
            deviation = np.sqrt(np.diagonal(table))
            table = table / np.outer(deviation, deviation)
        if on == "corr_rows":
            table = np.cov(table.T) if len(moving) > 1 else np.zeros((1, 1))
        values, vectors = np.linalg.eigh(table)
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        rows = []
        for c in range(min(k, len(moving))):
            peak = np.round(np.abs(vectors[:, c]), 10).argmax()
            weights = np.full(len(features), np.nan)
            weights[moving] = vectors[:, c] * (-1.0 if vectors[peak, c] < 0 else 1.0)
            share = values[c] / values.sum() if values.sum() else None
            rows.append(pd.DataFrame({**own, "component": c + 1, "eigenvalue": values[c], "share": share, "feature": features, "weight": weights}))
        found = pd.concat(rows)
        found["weight"] = found["weight"].astype(object).where(found["weight"].notna(), None)
        return found

    sums = moments.pair_sums(matrix, features, by)
    return sums.groupBy(*by).applyInPandas(decomposed, schema)


def principal_components(
    matrix: DataFrame, features: Sequence[str], k: int, on: str = "rows", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., component, eigenvalue, share, feature, weight), largest component first.

    Components of the customers' covariance (``rows``), their correlation (``corr``), or of the
    correlation table with its rows taken as observations (``corr_rows``).  A constant feature is
    kept, with null weights.  All segments are taken in one job; without segments the decomposition
    is Spark ML's.
    """
    if on not in ("rows", "corr", "corr_rows"):
        raise ValueError(f"on must be 'rows', 'corr' or 'corr_rows', not {on!r}")
    spark, features = matrix.sparkSession, list(features)
    if by:
        return _by_segment(matrix, features, k, on, by)
    stats = moments.feature_stats_of(moments.pair_sums(matrix, features).filter("i = j"))
    constant = {row.feature for row in stats.filter(F.col("std") == 0).collect()}
    moving = [f for f in features if f not in constant]
    if not moving:
        found = _decomposed(matrix, features, k, constant)
    elif on == "corr_rows":
        table = moments.wide(moments.correlation(matrix, moving), moving, "r")
        found = _decomposed(assembled(table, moving), moving, k, set())
        found += [(c, value, share, f, None) for f in sorted(constant) for c, value, share in _values(found)]
    else:
        vectors = standardised(matrix, features) if on == "corr" else assembled(matrix, features)
        found = _decomposed(vectors, features, k, constant)
    return spark.createDataFrame(found, COMPONENTS)


def _values(rows: list[tuple]) -> list[tuple]:
    return list(dict.fromkeys(row[:3] for row in rows))


def svd(matrix: DataFrame, features: Sequence[str], k: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., component, singular_value, feature, weight) of the centred rows.

    Singular values are the roots of n - 1 times the components' eigenvalues; ``weight`` holds the
    right vectors.  The left ones come from ``left_vectors``.
    """
    found = principal_components(matrix, features, k or len(features), by=by)
    size = matrix.groupBy(*by).agg((F.count("*") - 1).alias("dof"))
    if by:
        found = found.join(size, list(by))
    else:
        found = found.withColumn("dof", size.scalar())
    root = F.sqrt(F.greatest(F.col("eigenvalue") * F.col("dof"), F.lit(0.0)))
    return found.select(*by, "component", root.alias("singular_value"), "feature", "weight")


def wide_weights(weights: DataFrame, index: str, value: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, w_1..w_n): one column per component, factor or cluster."""
    columns = [F.max(F.when(F.col(index) == i, F.col(value))).alias(f"w_{i}") for i in range(1, n + 1)]
    return weights.groupBy(*by, "feature").agg(*columns)


def project(
    need: DataFrame,
    weights: DataFrame,
    index: str,
    value: str,
    n: int,
    by: Sequence[str] = (),
    key: str = "card_id",
    feature: str = "subcl",
    amount: str = "pct_visits",
    prefix: str = "score",
) -> DataFrame:
    """(by..., key, <prefix>_1..n): weighted sums of each customer's features.

    Works on the long table, so absent features cost nothing; one sum per component instead of
    one row per customer, feature and component.
    """
    table = wide_weights(weights, index, value, n, by)
    joined = need.withColumnRenamed(feature, "feature").join(table, [*by, "feature"], "left")
    sums = [
        F.coalesce(F.sum(F.col(amount) * F.col(f"w_{i}")), F.lit(0.0)).alias(f"{prefix}_{i}") for i in range(1, n + 1)
    ]
    return joined.groupBy(*by, key).agg(*sums)


def weighted_means(weights: DataFrame, stats: DataFrame, index: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., index, offset): what the column means score."""
    return (
        weights.join(stats.select(*by, "feature", "mean"), [*by, "feature"])
        .groupBy(*by, index)
        .agg(F.sum(F.col(value) * F.col("mean")).alias("offset"))
    )


def stacked(scores: DataFrame, index: str, n: int, keys: Sequence[str], prefix: str = "score") -> DataFrame:
    """Wide scores to (keys..., index, score)."""
    cells = [F.struct(F.lit(i).alias(index), F.col(f"{prefix}_{i}").alias("score")) for i in range(1, n + 1)]
    return scores.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def left_vectors(
    need: DataFrame, stats: DataFrame, right: DataFrame, n: int, by: Sequence[str] = (), key: str = "card_id"
) -> DataFrame:
    """(by..., key, component, u): left singular vectors, U = centred rows x V / S."""
    scores = stacked(project(need, right, "component", "weight", n, by, key), "component", n, [*by, key])
    offsets = weighted_means(right, stats, "component", "weight", by)
    singular = right.select(*by, "component", "singular_value").distinct()
    scored = scores.join(offsets, [*by, "component"]).join(singular, [*by, "component"])
    return scored.select(
        *by, key, "component", ratio(F.col("score") - F.col("offset"), F.col("singular_value")).alias("u")
    )


def q_mode_scores(matrix: DataFrame, features: Sequence[str], component: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, score): correlation rows projected on one singular vector, over its value.

    The default is the second component.  A constant feature has no score.
    """
    found = principal_components(matrix, features, component, "corr", by).filter(F.col("component") == component)
    vector = found.select(*by, F.col("feature").alias("j"), "weight", "eigenvalue")
    products = moments.correlation(matrix, features, by).join(vector, [*by, "j"])
    score = ratio(F.sum(F.col("r") * F.col("weight")), F.first("eigenvalue"))
    scored = products.groupBy(*by, F.col("i").alias("feature")).agg(score.alias("score"))
    known = vector.select(*by, F.col("j").alias("feature"), F.col("weight").isNotNull().alias("moves"))
    return scored.join(known, [*by, "feature"]).select(*by, "feature", F.when(F.col("moves"), F.col("score")).alias("score"))


# --- the same, as a saved model -----------------------------------------------------------------


def fit_pca_model(matrix: DataFrame, features: Sequence[str], k: int = 4) -> PCAModel:
    vectors = assembled(matrix, features).select("features")
    return PCA(k=min(k, len(features)), inputCol="features", outputCol="pca_features").fit(vectors)


def pca_model_scores(model: PCAModel, matrix: DataFrame, features: Sequence[str], key: str = "card_id") -> DataFrame:
    """(key, pca_1..pca_k): ``PCAModel.transform`` on every customer, in plain columns."""
    scored = model.transform(assembled(matrix, features)).select(key, vector_to_array("pca_features").alias("p"))
    return scored.select(key, *[F.col("p")[i].alias(f"pca_{i + 1}") for i in range(model.getK())])
