import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aislemetrics.functions import stats
from aislemetrics.operators import price

N = 60


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(3)
    out = {}
    for group in ("a", "b"):
        x = np.round(rng.uniform(25, 45, N), 2)
        y = 9000 - 350 * x + 4 * x * x + rng.gamma(2.0, 40.0, N)
        out[group] = (x, y)
    return out


@pytest.fixture(scope="module")
def points(spark, samples):
    start = dt.date(2020, 1, 1)
    rows = [
        (g, start + dt.timedelta(days=i), float(x[i]), float(y[i])) for g, (x, y) in samples.items() for i in range(N)
    ]
    return spark.createDataFrame(rows, "g string, date_id date, ppu double, units double").cache()


def _least_squares(x, y, degree):
    design = np.vander(x, degree + 1, increasing=True)
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    e = y - design @ coef
    cov = (e @ e) / (N - degree - 1) * np.linalg.inv(design.T @ design)
    return design, coef, e, np.sqrt(np.diag(cov))


@pytest.mark.parametrize("degree", [1, 2])
def test_summary_equals_numpy(points, samples, degree):
    for row in price.fit_summary(points, degree, ["g"]).collect():
        design, coef, e, errors = _least_squares(*samples[row.g], degree)
        y = samples[row.g][1]
        k = degree + 1
        assert [row[f"coef_{i}"] for i in range(k)] == pytest.approx(coef, rel=1e-6)
        assert [row[f"std_err_{i}"] for i in range(k)] == pytest.approx(errors, rel=1e-6)
        assert row.mse == pytest.approx(np.mean(e * e), rel=1e-7)
        r2 = 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))
        assert row.r2 == pytest.approx(r2)
        assert row.adj_r2 == pytest.approx(1 - (1 - r2) * (N - 1) / (N - k))
        assert row.f_value == pytest.approx(r2 / degree / ((1 - r2) / (N - k)), rel=1e-6)
        assert row.durbin_watson == pytest.approx(np.sum(np.diff(e) ** 2) / (e @ e), rel=1e-6)
        assert row.skew == pytest.approx(np.mean(e**3) / np.mean(e * e) ** 1.5, rel=1e-5)
        assert row.kurtosis == pytest.approx(np.mean(e**4) / np.mean(e * e) ** 2, rel=1e-5)
        assert row.cond_no == pytest.approx(np.linalg.cond(design), rel=1e-4)


def test_fit_equals_ml_regression(points):
    fits = {r.g: r for r in price.fit_price(points, 1, ["g"]).collect()}
    vectors = VectorAssembler(inputCols=["ppu"], outputCol="v").transform(points.filter("g = 'a'"))
    model = LinearRegression(featuresCol="v", labelCol="units", solver="normal").fit(vectors)
    assert fits["a"].coef_1 == pytest.approx(model.coefficients[0])
    assert fits["a"].coef_0 == pytest.approx(model.intercept)
    tests = price.coefficient_tests(price.fit_summary(points, 1, ["g"]), ["g"]).filter("g = 'a'").orderBy("term")
    intercept, slope = tests.collect()
    assert (slope.p_value, intercept.p_value) == pytest.approx(tuple(model.summary.pValues), abs=1e-9)
    assert slope.prob_f == pytest.approx(slope.p_value)


def test_ungrouped_fit_and_curve(points, samples):
    one = points.filter("g = 'a'")
    fit = price.fit_price(one, 2)
    x, y = samples["a"]
    assert [fit.first()[f"coef_{i}"] for i in range(3)] == pytest.approx(_least_squares(x, y, 2)[1], rel=1e-6)
    assert price.fit_summary(one, 2).first().r2 == pytest.approx(fit.first().r2)
    grid = [r.ppu for r in price.predict_grid(fit, 2).orderBy("ppu").collect()]
    # Lowest price included, highest not.
    assert grid[0] == x.min() and grid[-1] == pytest.approx(x.max() - 0.01)
    assert len(grid) == round((x.max() - x.min()) * 100)


def _row(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@pytest.mark.parametrize(
    "degree, mse, r2, likelihood, aic, bic",
    [(1, 55901341.65, 0.390, -2460.6, 4925, 4932), (2, 10891899.51, 0.881, -2265.9, 4538, 4548)],
)
def test_recorded_likelihoods(spark, degree, mse, r2, likelihood, aic, bic):
    given = {f"{p}_{i}": 1.0 for p in ("coef", "var") for i in range(degree + 1)}
    row = stats.add_quality(_row(spark, n=238, mse=mse, r2=r2, **given), degree).first()
    assert row.log_likelihood == pytest.approx(likelihood, abs=0.06)
    assert (round(row.aic), round(row.bic)) == (aic, bic)
    if degree == 1:
        assert round(row.adj_r2, 3) == 0.387


@pytest.mark.parametrize(
    "skew, kurt, jb, omnibus", [(5.230, 46.131, 19532.8, 293.28), (0.505, 17.397, 2065.6, 75.14)]
)
def test_recorded_normality(spark, skew, kurt, jb, omnibus):
    row = stats.add_normality(_row(spark, n=238, skew=skew, kurtosis=kurt)).first()
    assert row.jarque_bera == pytest.approx(jb, abs=0.1)
    assert row.omnibus == pytest.approx(omnibus, abs=0.02)
    assert stats.add_normality(_row(spark, n=5, skew=skew, kurtosis=kurt)).first().omnibus is None


def test_recorded_interval(spark):
    given = {"coef_0": 40317.23, "coef_1": -765.5744, "std_err_0": 2975.955, "std_err_1": 62.316}
    given |= {"t_0": 40317.23 / 2975.955, "t_1": -765.5744 / 62.316}
    summary = _row(spark, dof=236, f_value=(765.5744 / 62.316) ** 2, **given)
    row = price.coefficient_tests(summary).filter("term = 1").first()
    assert row.t == pytest.approx(-12.285, abs=5e-4)
    assert (row.low, row.high) == pytest.approx((-888.341, -642.808), abs=2e-3)
    assert row.prob_f == pytest.approx(3.80e-27, rel=0.02)


def test_student_t(spark):
    rows = spark.createDataFrame([(1,), (10,), (10_000,), (0,)], "dof long")
    found = [r[0] for r in rows.select(stats.t_margin(F.col("dof"), 0.05)).collect()]
    assert found[:3] == pytest.approx([12.7062047, 2.2281389, 1.9602012], abs=1e-6) and found[3] is None
    # One degree of freedom is the Cauchy distribution, two have a closed tail.
    t = [0.0, 0.5, 1.0, 30.0, 1e6]
    frame = spark.createDataFrame([(v,) for v in t], "t double")
    one, two = stats.t_p_value(F.col("t"), F.lit(1)), stats.t_p_value(F.col("t"), F.lit(2))
    values = frame.select("t", one.alias("one"), two.alias("two")).collect()
    for r in values:
        assert r.one == pytest.approx(2 / math.pi * math.atan2(1, r.t), rel=1e-9)
        assert r.two == pytest.approx(2 / (2 + r.t**2) / (1 + r.t / math.sqrt(2 + r.t**2)), rel=1e-9)


def test_degenerate_fits_are_null(spark):
    rows = [(dt.date(2020, 1, d), 5.0, float(d)) for d in (1, 2, 3)]
    flat = spark.createDataFrame(rows, "date_id date, ppu double, units double")
    assert price.fit_price(flat, 1).first().coef_1 is None
    assert price.fit_summary(flat, 2).first().coef_2 is None
    with pytest.raises(ValueError):
        price.fit_price(flat, 3)


def test_price_points_rules(spark):
    day = dt.date(2020, 1, 1)
    schema = (
        "card_id long, prod_code string, store_id long, date_id date, item_qty double, weight_uom_qty double,"
        " net_spend_amt decimal(18,4)"
    )
    from decimal import Decimal as D

    rows = [
        (1, "p", 1, day, 1000.0, None, D("40000")),
        (1, "p", 1, day, 9.0, 773.0, D("34466")),
        (1, "p", 1, day, 5.0, None, D("-10")),
        (2, "p", 1, day, 5.0, None, D("10")),
        (None, "p", 1, day, 5.0, None, D("10")),
        (1, "q", 1, day, 5.0, None, D("10")),
        (1, "p", 2, day, 5.0, None, D("10")),
    ]
    items = spark.createDataFrame(rows, schema)
    products = spark.createDataFrame([("p",)], "prod_code string")
    stores = spark.createDataFrame([(1, "1"), (2, "9")], "store_id long, format_code string")
    cards = spark.createDataFrame([(1,)], "card_id long")
    found = price.price_points(items, products, cards, stores=stores).collect()
    assert [tuple(r) for r in found] == [(day, 1773.0, 74466.0, 42.0)]
