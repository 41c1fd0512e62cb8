import numpy as np
import pandas as pd
import pytest
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from aislemetrics.operators import components, factors, moments, needstate, varclus
from aislemetrics.sources import sinks

FEATURES = [f"s{i}" for i in range(6)]


def _data(seed, n=200):
    """Two tight groups of features, sparse like need states."""
    rng = np.random.default_rng(seed)
    a, b = rng.gamma(2, 1, (2, n, 1))
    x = np.hstack([a + 0.4 * rng.normal(size=(n, 3)), b + 0.4 * rng.normal(size=(n, 3))])
    return np.where(x > 0.8, np.round(x, 3), 0.0)


@pytest.fixture(scope="module")
def segments():
    return {"u": _data(1), "v": _data(2)}


@pytest.fixture(scope="module")
def need(spark, segments):
    rows = [
        (seg, i + 1000 * (seg == "v"), FEATURES[j], float(x[i, j]))
        for seg, x in segments.items()
        for i in range(len(x))
        for j in range(6)
        if x[i, j] or j == 0
    ]
    return spark.createDataFrame(rows, "seg string, card_id long, subcl string, pct_visits double").cache()


@pytest.fixture(scope="module")
def matrix(need):
    return needstate.need_matrix(need, FEATURES, keys=["seg", "card_id"]).cache()


def _square(long, value, names=FEATURES):
    table = {(r.i, r.j): r[value] for r in long.collect()}
    assert len(table) == len(names) ** 2
    return np.array([[table[i, j] for j in names] for i in names], dtype=float)


@pytest.fixture(scope="module")
def corr(matrix):
    return moments.correlation(matrix, FEATURES, ["seg"]).cache()


def test_moments_equal_numpy(matrix, corr, segments):
    for seg, x in segments.items():
        own = matrix.filter(F.col("seg") == seg)
        assert _square(corr.filter(F.col("seg") == seg), "r") == pytest.approx(np.corrcoef(x.T))
        assert _square(moments.covariance(own, FEATURES), "cov") == pytest.approx(np.cov(x.T))
        centred = x - x.mean(axis=0)
        assert _square(moments.scatter(own, FEATURES), "s") == pytest.approx(centred.T @ centred)
    stats = {r.feature: r for r in moments.feature_stats(matrix.filter("seg = 'u'"), FEATURES).collect()}
    assert [stats[f].std for f in FEATURES] == pytest.approx(segments["u"].std(axis=0, ddof=1))


def test_correlation_equals_ml(matrix, corr):
    vectors = components.assembled(matrix.filter("seg = 'u'"), FEATURES)
    theirs = Correlation.corr(vectors, "features").first()[0].toArray()
    assert _square(corr.filter("seg = 'u'"), "r") == pytest.approx(theirs)


def test_wide_matrix_keeps_sums(matrix, corr):
    table = moments.wide(corr, FEATURES, "r", ["seg"])
    assert table.columns == ["seg", "i", *FEATURES] and table.count() == 12
    long = moments.long_rows(table.filter("seg = 'u'"), "i", FEATURES)
    assert long.count() == 36


def test_constant_feature(spark):
    rows = [(i, float(i % 3), float(i % 3 + i % 2), 0.7) for i in range(12)]
    flat = spark.createDataFrame(rows, "card_id long, a double, b double, c double")
    corr = moments.correlation(flat, ["a", "b", "c"]).cache()
    table = {(r.i, r.j): r.r for r in corr.collect()}
    assert table["c", "c"] == 1.0 and table["a", "c"] is None and table["c", "b"] is None
    # Every analysis keeps it, without a value.
    for on in ("rows", "corr", "corr_rows"):
        found = components.principal_components(flat, ["a", "b", "c"], 2, on)
        weights = {(r.component, r.feature): r.weight for r in found.collect()}
        assert set(weights) == {(k, f) for k in (1, 2) for f in "abc"}
        assert weights[1, "c"] is None and weights[1, "a"] is not None
    loadings = {r.feature: r.loading for r in factors.factor_loadings(flat, ["a", "b", "c"], 1).collect()}
    assert set(loadings) == {"a", "b", "c"} and loadings["c"] is None
    clusters = {r.feature_name: r.cluster_num for r in varclus.variable_clusters(flat, ["a", "b", "c"], 2).collect()}
    assert clusters == {"a": 1, "b": 1, "c": None}
    assert {r.feature: r.score is None for r in components.q_mode_scores(flat, ["a", "b", "c"]).collect()}["c"]
    # A constant member does not count in its cluster's centroid.
    start = spark.createDataFrame([("a", 1), ("c", 1), ("b", 2)], "feature string, cluster int")
    near = {(r.feature, r.cluster): r.r for r in varclus.cluster_correlation(corr, start).collect()}
    assert near["a", 1] == pytest.approx(1) and near["c", 1] is None and near["c", 2] is None
    moved = {r.feature: r.cluster for r in varclus.reassign(corr, start, 2).collect()}
    assert moved["c"] == 1


def test_high_means_keep_their_digits(spark):
    rows = [(i, 1e9 + i % 4, 1e9 + (i % 4) ** 2) for i in range(4000)]
    corr = moments.correlation(spark.createDataFrame(rows, "k long, a double, b double").repartition(7), ["a", "b"])
    exact = np.corrcoef([i % 4 for i in range(4000)], [(i % 4) ** 2 for i in range(4000)])[0, 1]
    assert {(r.i, r.j): r.r for r in corr.collect()}["a", "b"] == pytest.approx(exact, abs=1e-9)


def test_many_features_and_many_segments(spark):
    names = [f"f{i}" for i in range(1_500)]
    x = np.random.default_rng(0).normal(size=(40, 1_500))
    wide = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3)
    sums = moments.pair_sums(wide, names)
    assert sums.count() == 1_500 * 1_501 // 2
    row = sums.filter("i = 'f3' AND j = 'f1499'").first()
    assert row.sij == pytest.approx(np.cov(x[:, 3], x[:, 1499])[0, 1] * 39)
    many = spark.range(150_000).selectExpr("id % 50000 AS g", "cast(id as double) AS a", "cast(id * id % 7 as double) AS b")
    assert moments.pair_sums(many, ["a", "b"], ["g"]).filter("n = 3").count() == 150_000


def test_sparse_sums_equal_dense_ones(spark, need, matrix):
    sparse = need.filter("pct_visits <> 0 OR subcl = 's0'")
    ours = moments.sparse_pair_sums(moments.sparse_vectors(sparse, ["seg"]), FEATURES, ["seg"])
    dense = {(r.seg, r.i, r.j): r for r in moments.pair_sums(matrix, FEATURES, ["seg"]).collect()}
    rows = ours.collect()
    assert len(rows) == len(dense)
    for r in rows:
        assert tuple(r)[3:] == pytest.approx(tuple(dense[r.seg, r.i, r.j])[3:], abs=1e-9)
    flat = spark.range(30).selectExpr("id AS card_id", "explode(array('a', 'b')) AS subcl")
    flat = flat.selectExpr("*", "CASE WHEN subcl = 'a' THEN 0.7D ELSE card_id / 7D END AS pct_visits")
    corr = moments.correlation_of(moments.sparse_pair_sums(moments.sparse_vectors(flat), ["a", "b", "c"])).collect()
    table = {(r.i, r.j): r.r for r in corr}
    assert table["a", "b"] is None and table["b", "c"] is None and table["b", "b"] == 1.0


def test_sparse_sums_of_twenty_thousand_features(spark):
    names = [f"f{i}" for i in range(20_000)]
    need = spark.range(3_000).selectExpr("id AS card_id", "explode(sequence(0, 3)) AS s")
    need = need.selectExpr("card_id", "concat('f', (card_id * 7 + s * s * 31) % 20000) AS subcl", "1D + s AS pct_visits")
    sums = moments.sparse_pair_sums(moments.sparse_vectors(need), names).filter("i = 'f0'")
    rows = {r.j: r for r in sums.filter("j IN ('f0', 'f31', 'f5')").collect()}
    # Card 0 has f0, f31, f124 and f279 as 1, 2, 3 and 4.
    held = {}
    for r in need.filter("subcl IN ('f0', 'f31', 'f5')").collect():
        held.setdefault(r.subcl, {})[r.card_id] = r.pct_visits
    x = np.zeros((3, 3_000))
    for n, f in enumerate(("f0", "f31", "f5")):
        x[n, list(held.get(f, {}))] = list(held.get(f, {}).values())
    wanted = np.cov(x) * 2_999
    assert [rows[f].sij for f in ("f0", "f31", "f5")] == pytest.approx(wanted[0].tolist())


def test_missing_values_are_refused(spark):
    holes = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with pytest.raises(Exception, match="null or NaN"):
        moments.pair_sums(holes, ["a", "b"]).collect()


def _vectors(long, k, names=FEATURES):
    table = {(r.component, r.feature): r.weight for r in long.collect()}
    return np.array([[table[c, f] for f in names] for c in range(1, k + 1)])


def test_components_are_eigenvectors(matrix, segments):
    found = components.principal_components(matrix, FEATURES, 3, by=["seg"]).cache()
    for seg, x in segments.items():
        own = found.filter(F.col("seg") == seg)
        weights = _vectors(own, 3)
        values = {r.component: (r.eigenvalue, r.share) for r in own.collect()}
        for c, w in enumerate(weights, 1):
            assert np.cov(x.T) @ w == pytest.approx(values[c][0] * w, abs=1e-9)
            assert w[np.abs(w).argmax()] > 0
            assert values[c][1] == pytest.approx(values[c][0] / np.trace(np.cov(x.T)))
        assert values[1][0] >= values[2][0] >= values[3][0]


def test_components_equal_ml_model(matrix, tmp_path):
    own = matrix.filter("seg = 'u'")
    weights = _vectors(components.principal_components(own, FEATURES, 2), 2)
    sinks.save_pca_model(components.fit_pca_model(own, FEATURES, 2), str(tmp_path / "model"))
    model = sinks.load_pca_model(str(tmp_path / "model"))
    theirs = model.pc.toArray().T
    assert np.abs((weights * theirs).sum(axis=1)) == pytest.approx([1, 1])
    scores = components.pca_model_scores(model, own, FEATURES)
    assert scores.columns == ["card_id", "pca_1", "pca_2"] and scores.count() == own.count()


def test_components_of_correlation_rows(matrix, segments):
    found = components.principal_components(matrix.filter("seg = 'u'"), FEATURES, 2, on="corr_rows")
    values = sorted({r.eigenvalue for r in found.collect()}, reverse=True)
    table = np.corrcoef(segments["u"].T)
    assert values == pytest.approx(np.linalg.eigvalsh(np.cov(table.T))[::-1][:2])
    with pytest.raises(ValueError):
        components.principal_components(matrix, FEATURES, 2, on="columns")


def test_svd_rebuilds_the_centred_rows(matrix, need, segments):
    own, x = matrix.filter("seg = 'u'"), segments["u"]
    right = components.svd(own, FEATURES).cache()
    values = {r.component: r.singular_value for r in right.collect()}
    singular = np.array([values[c] for c in range(1, 7)])
    centred = x - x.mean(axis=0)
    assert singular == pytest.approx(np.linalg.svd(centred)[1])
    stats = moments.feature_stats(own, FEATURES)
    left = components.left_vectors(need.filter("seg = 'u'"), stats, right, 6)
    table = {(r.card_id, r.component): r.u for r in left.collect()}
    u = np.array([[table[i, c] for c in range(1, 7)] for i in range(len(x))])
    assert u * singular @ _vectors(right, 6) == pytest.approx(centred, abs=1e-8)


def test_explained_share(matrix):
    found = components.principal_components(matrix, FEATURES, 6, on="corr", by=["seg"])
    rows = moments.explained(found, ["seg"]).filter("seg = 'u'").orderBy("component").collect()
    assert rows[-1].cum_share == pytest.approx(1) and rows[0].gain is None
    assert rows[2].gain == pytest.approx(rows[2].share)
    assert rows[0].below_cut == sum(r.cum_share < 0.8 for r in rows)


def test_q_mode_scores_are_the_vector(matrix):
    own = matrix.filter("seg = 'u'")
    scores = {r.feature: r.score for r in components.q_mode_scores(own, FEATURES).collect()}
    second = _vectors(components.principal_components(own, FEATURES, 2, "corr"), 2)[1]
    assert [scores[f] for f in FEATURES] == pytest.approx(second)


def test_loadings_are_correlations_with_components(matrix, segments):
    found = factors.factor_loadings(matrix, FEATURES, 2, ["seg"]).collect()
    for seg, x in segments.items():
        rows = {(r.feature, r.factor): r for r in found if r.seg == seg}
        loadings = np.array([[rows[f, k].loading for k in (1, 2)] for f in FEATURES])
        values, vectors = np.linalg.eigh(np.corrcoef(x.T))
        wanted = vectors[:, [-1, -2]] * np.sqrt(values[[-1, -2]])
        assert np.abs(loadings) == pytest.approx(np.abs(wanted))
        uniqueness = [rows[f, 1].uniqueness for f in FEATURES]
        assert uniqueness == pytest.approx(1 - (loadings**2).sum(axis=1))


def test_factor_members_and_scores(spark, need):
    loadings = spark.createDataFrame(
        [("s0", 1, 0.5, 0.1), ("s1", 1, -0.3, 0.1), ("s2", 1, 0.29, 0.1), ("s0", 2, 0.2, 0.1)],
        "feature string, factor int, loading double, uniqueness double",
    )
    products = spark.createDataFrame(
        [("0", "zero"), ("0", "zero"), ("1", "one"), ("2", "two")], "prod_hier_l10_code string, prod_hier_l10_desc string"
    )
    members = factors.factor_members(loadings, products, 1).collect()
    assert {(m.prod_hier_l10_code, m.prod_hier_l10_desc, m.loading) for m in members} == {("0", "zero", 0.5), ("1", "one", -0.3)}
    x = _data(1)
    stats = [(f, float(x[:, i].mean()), float(x[:, i].std(ddof=1))) for i, f in enumerate(FEATURES)]
    known = spark.createDataFrame(stats, "feature string, mean double, std double")
    scores = {r.card_id: r for r in factors.factor_scores(need.filter("seg = 'u'"), loadings, known, 2).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert [scores[i].factor_1 for i in range(200)] == pytest.approx(0.5 * z[:, 0] - 0.3 * z[:, 1] + 0.29 * z[:, 2])
    assert [scores[i].factor_2 for i in range(200)] == pytest.approx(0.2 * z[:, 0])


@pytest.fixture(scope="module")
def assignment(spark):
    rows = [(seg, f, 1 if f in ("s0", "s1", "s4") else 2) for seg in ("u", "v") for f in FEATURES]
    return spark.createDataFrame(rows, "seg string, feature string, cluster int").cache()


def _cluster_r(corr, groups, method):
    columns = []
    for members in groups:
        inside = corr[np.ix_(members, members)]
        w = np.ones(len(members)) if method == "Centroid" else np.linalg.eigh(inside)[1][:, -1]
        columns.append(corr[:, members] @ w / np.sqrt(w @ inside @ w))
    return np.array(columns).T


@pytest.mark.parametrize("method", ["Centroid", "PCA"])
def test_cluster_correlation_equals_vectors(matrix, corr, assignment, segments, method):
    weights = varclus.component_weights(matrix, FEATURES, assignment, ["seg"]) if method == "PCA" else None
    found = varclus.cluster_correlation(corr, assignment, weights, ["seg"]).collect()
    ratios = {(r.seg, r.feature): r for r in varclus.r2_ratio(corr, assignment, ["seg"]).collect()}
    for seg, x in segments.items():
        wanted = _cluster_r(np.corrcoef(x.T), [[0, 1, 4], [2, 3, 5]], method)
        table = {(r.feature, r.cluster): r.r for r in found if r.seg == seg}
        ours = np.array([[table[f, c] for c in (1, 2)] for f in FEATURES])
        assert np.abs(ours) == pytest.approx(np.abs(wanted))
        if method == "Centroid":
            r2 = wanted**2
            assert ratios[seg, "s4"].ratio == pytest.approx((1 - r2[4, 0]) / (1 - r2[4, 1]))
            assert ratios[seg, "s4"].cluster == 1


def test_reassign_finds_the_pairs(corr, assignment):
    moved = varclus.reassign(corr, assignment, 4, ["seg"]).collect()
    for seg in ("u", "v"):
        clusters = {r.feature: r.cluster for r in moved if r.seg == seg}
        assert len({clusters[f] for f in FEATURES[:3]}) == 1
        assert len({clusters[f] for f in FEATURES[3:]}) == 1
        assert clusters["s0"] != clusters["s3"]
        assert all(r.stable for r in moved)
    assert not any(r.stable for r in varclus.reassign(corr, assignment, 1, ["seg"]).collect())


def test_variable_clusters(matrix):
    found = varclus.variable_clusters(matrix, FEATURES, 2, by=["seg"]).collect()
    for seg in ("u", "v"):
        groups = {}
        for r in found:
            if r.seg == seg:
                groups.setdefault(r.cluster_num, set()).add(r.feature_name)
        assert sorted(map(sorted, groups.values())) == [FEATURES[:3], FEATURES[3:]]


def test_clusters_are_a_partition_and_small_ones_stay(matrix):
    found = varclus.variable_clusters(matrix.filter("seg = 'u'"), FEATURES, 6).collect()
    assert sorted(r.feature_name for r in found) == FEATURES
    sizes = [sum(r.cluster_num == c for r in found) for c in {r.cluster_num for r in found}]
    # Splitting stops at two features.
    assert max(sizes) <= 2 and len(sizes) >= 3


def test_quartimax_turn_is_the_best_angle():
    rng = np.random.default_rng(4)

    def fourth_powers(pairs, angle):
        turned = pairs @ np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        return (turned**4).sum()

    for _ in range(20):
        pairs = rng.normal(size=(7, 2))
        best = max(fourth_powers(pairs, t) for t in np.linspace(0, np.pi / 2, 5_001))
        ours = varclus._quartimax_angle([tuple(p) for p in pairs.tolist()])
        assert fourth_powers(pairs, ours) == pytest.approx(best, rel=1e-5)


def test_cluster_scores_equal_numpy(spark, need, matrix, segments):
    x = segments["u"]
    clusters = spark.createDataFrame([(1, "s0"), (1, "s1"), (2, "s4")], "cluster_num int, feature_name string")
    stats = moments.feature_stats(matrix.filter("seg = 'u'"), FEATURES)
    scores = varclus.cluster_scores(need.filter("seg = 'u'"), clusters, stats, 3)
    table = {(r.card_id, r.cluster_num): r.score for r in scores.collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert len(table) == 2 * len(x)
    assert [table[i, 1] for i in range(len(x))] == pytest.approx((z[:, 0] + z[:, 1]) / np.sqrt(2))
    assert [table[i, 2] for i in range(len(x))] == pytest.approx(z[:, 4])
