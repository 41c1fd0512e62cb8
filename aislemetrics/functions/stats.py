"""Regression and test statistics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Moment columns of a fit of {y} on {x}.  All are Spark's mergeable central moments, so partial
# results combine on the map side without the cancellation of raw power sums.
_MOMENTS = {
    "n": "count({y})",
    "mx": "avg({x})",
    "my": "avg({y})",
    "vx": "var_pop({x})",
    "sk": "skewness({x})",
    "ku": "kurtosis({x})",
    "vy": "var_pop({y})",
    "cxy": "covar_pop({x}, {y})",
    "cqy": "covar_pop({x} * {x}, {y})",
}
MOMENTS = tuple(_MOMENTS)


def moment_columns(x: str, y: str) -> dict[str, Column]:
    return {name: F.expr(text.format(x=x, y=y)) for name, text in _MOMENTS.items()}


def _staged(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """Add columns stage by stage, so that a shared term is computed once, not inlined everywhere."""
    for stage in stages:
        df = df.selectExpr("*", *[f"{text} AS {name}" for name, text in stage.items()])
    return df


def add_coefficients(df: DataFrame, degree: int) -> DataFrame:
    """``coef_0..degree``, ``mse`` and ``r2`` beside the moment columns.

    Least squares in u = x - mean(x), expanded back to powers of x: the raw quadratic fit is badly
    conditioned.
    """
    if degree == 1:
        return _staged(
            df,
            {"coef_1": "try_divide(cxy, vx)"},
            {"coef_0": "my - coef_1 * mx", "mse": "greatest(vy - coef_1 * cxy, 0D)"},
            {"r2": "1 - try_divide(mse, vy)"},
        )
    if degree == 2:
        return _staged(
            df,
            {"_m3": "sk * vx * sqrt(vx)", "_m4": "(ku + 3) * vx * vx", "_quy": "cqy - 2 * mx * cxy"},
            {"_det": "vx * (_m4 - vx * vx) - _m3 * _m3"},
            {"coef_2": "try_divide(_quy * vx - cxy * _m3, _det)"},
            {"_b": "try_divide(cxy - coef_2 * _m3, vx)"},
            {
                "coef_0": "my - coef_2 * vx - _b * mx + coef_2 * mx * mx",
                "coef_1": "_b - 2 * coef_2 * mx",
                "mse": "greatest(vy - _b * cxy - coef_2 * _quy, 0D)",
            },
            {"r2": "1 - try_divide(mse, vy)"},
        )
    raise ValueError(f"degree must be 1 or 2, not {degree}")


def add_uncertainty(df: DataFrame, degree: int) -> DataFrame:
    """``var_0..degree`` of the coefficients and the condition number ``cond_no`` of X.

    For the quadratic, the largest eigenvalue of X'X / n comes from the trigonometric solution of
    the cubic; the two smaller ones from the determinant and the sum of the principal minors,
    which keeps the smallest one accurate.
    """
    noise = {"_s2": f"try_divide(mse, nullif(cast(n - {degree + 1} as double), 0D))"}
    if degree == 1:
        return _staged(
            df,
            {**noise, "_trace": "1 + vx + mx * mx"},
            {
                "var_0": "_s2 * (1 + try_divide(mx * mx, vx))",
                "var_1": "try_divide(_s2, vx)",
                "_top": "(_trace + sqrt(greatest(_trace * _trace - 4 * vx, 0D))) / 2",
            },
            {"cond_no": "sqrt(try_divide(_top * _top, vx))"},
        )
    return _staged(
        df,
        noise,
        {
            "_f": "try_divide(_s2, _det)",
            # Powers of x about the origin.
            "_x2": "vx + mx * mx",
            "_x3": "_m3 + 3 * mx * vx + mx * mx * mx",
            "_x4": "_m4 + 4 * mx * _m3 + 6 * mx * mx * vx + mx * mx * mx * mx",
            # Entries of the inverse normal matrix in (1, u, u^2), times its determinant.
            "_v00": "vx * _m4 - _m3 * _m3",
            "_v01": "vx * _m3",
            "_v02": "-vx * vx",
            "_v11": "_m4 - vx * vx",
            "_v12": "-_m3",
        },
        {
            "var_0": "_f * (_v00 + mx * mx * _v11 + mx * mx * mx * mx * vx"
            " - 2 * mx * _v01 + 2 * mx * mx * _v02 - 2 * mx * mx * mx * _v12)",
            "var_1": "_f * (_v11 - 4 * mx * _v12 + 4 * mx * mx * vx)",
            "var_2": "_f * vx",
            "_mid": "(1 + _x2 + _x4) / 3",
            "_minors": "vx + (_m4 - vx * vx + 4 * mx * _m3 + 4 * mx * mx * vx) + (_x2 * _x4 - _x3 * _x3)",
        },
        {
            "_p": "sqrt(((1 - _mid) * (1 - _mid) + (_x2 - _mid) * (_x2 - _mid) + (_x4 - _mid) * (_x4 - _mid)"
            " + 2 * (mx * mx + _x2 * _x2 + _x3 * _x3)) / 6)",
            "_shifted": "(1 - _mid) * ((_x2 - _mid) * (_x4 - _mid) - _x3 * _x3)"
            " - mx * (mx * (_x4 - _mid) - _x3 * _x2) + _x2 * (mx * _x3 - (_x2 - _mid) * _x2)",
        },
        {"_cos": "greatest(least(try_divide(_shifted, 2 * _p * _p * _p), 1D), -1D)"},
        {"_top": "_mid + 2 * _p * cos(acos(_cos) / 3)"},
        {"_product": "try_divide(_det, _top)"},
        {"_sum": "try_divide(_minors - _product, _top)"},
        {"_second": "(_sum + sqrt(greatest(_sum * _sum - 4 * _product, 0D))) / 2"},
        {"cond_no": "sqrt(try_divide(_top * _second, _product))"},
    )


def add_normality(df: DataFrame) -> DataFrame:
    """``jarque_bera``, ``omnibus`` and their tail probabilities, from n, skew and kurtosis.

    ``kurtosis`` is the plain one, 3 for a normal variable.  Omnibus is D'Agostino and Pearson's
    K^2, the sum of a squared skewness z and a squared kurtosis z; null below 8 rows.
    """
    return _staged(
        df,
        {"_n": "CASE WHEN n >= 8 THEN cast(n as double) END"},
        {
            "_beta": "3 * (_n * _n + 27 * _n - 70) * (_n + 1) * (_n + 3) / ((_n - 2) * (_n + 5) * (_n + 7) * (_n + 9))",
            "_y": "skew * sqrt((_n + 1) * (_n + 3) / (6 * (_n - 2)))",
            "_kx": "(kurtosis - 3 * (_n - 1) / (_n + 1))"
            " / sqrt(24 * _n * (_n - 2) * (_n - 3) / ((_n + 1) * (_n + 1) * (_n + 3) * (_n + 5)))",
            "_kb": "6 * (_n * _n - 5 * _n + 2) / ((_n + 7) * (_n + 9))"
            " * sqrt(6 * (_n + 3) * (_n + 5) / (_n * (_n - 2) * (_n - 3)))",
        },
        {"_w2": "sqrt(2 * (_beta - 1)) - 1", "_a": "6 + 8 / _kb * (2 / _kb + sqrt(1 + 4 / (_kb * _kb)))"},
        {"_low": "1 + _kx * sqrt(2 / (_a - 4))"},
        {
            "_z1": "asinh(_y / sqrt(2 / (_w2 - 1))) / sqrt(ln(_w2) / 2)",
            "_z2": "(1 - 2 / (9 * _a) - sign(_low) * cbrt(try_divide(1 - 2 / _a, abs(_low)))) / sqrt(2 / (9 * _a))",
        },
        {
            "jarque_bera": "n / 6 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4)",
            "omnibus": "_z1 * _z1 + _z2 * _z2",
        },
        # The upper tail of chi-square with 2 degrees of freedom.
        {"prob_jb": "exp(-jarque_bera / 2)", "prob_omnibus": "exp(-omnibus / 2)"},
    )


def add_quality(df: DataFrame, degree: int) -> DataFrame:
    """Standard errors, t, F, adjusted R^2, likelihood and information criteria."""
    k = degree + 1
    tests = {f"t_{i}": f"try_divide(coef_{i}, std_err_{i})" for i in range(k)}
    return _staged(
        df,
        {
            "dof": f"n - {k}",
            **{f"std_err_{i}": f"sqrt(greatest(var_{i}, 0D))" for i in range(k)},
            "log_likelihood": f"-n / 2 * (ln(mse * {2 * math.pi!r}D) + 1)",
        },
        {
            **tests,
            "adj_r2": "1 - try_divide((1 - r2) * (n - 1), cast(dof as double))",
            "f_value": f"try_divide(r2 / {degree}, try_divide(1 - r2, cast(dof as double)))",
            "aic": f"{2 * k} - 2 * log_likelihood",
            "bic": f"{k} * ln(n) - 2 * log_likelihood",
        },
    )


# Upper tail of F(2, dof) at f_value.
F_TAIL_TWO = "pow(1 + 2 * f_value / nullif(dof, 0D), -dof / 2)"


# --- Student's t ------------------------------------------------------------------------------


# Beyond this probability inside, the one outside is summed by itself.
_FAR = 0.999


def _t_sums(t: Column, dof: Column) -> tuple[Column, Column]:
    """P(|T| <= |t|), and P(|T| > |t|) to full relative accuracy where it is small.

    Both are parts of one series in powers of the squared cosine of atan(t / sqrt(dof)): its first
    ``dof // 2`` terms, and the rest of it, each term following from the one before.
    """
    angle = F.atan(F.abs(t) / F.sqrt(dof))
    square = F.cos(angle) * F.cos(angle)
    odd = dof % 2
    count = F.floor((dof - odd) / 2).cast("int")

    def add(acc: Column, k: Column) -> Column:
        following = acc["term"] * square * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), following.alias("term"))

    def terms(low: Column, high: Column) -> Column:
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    first = F.aggregate(terms(F.lit(1), count), start, add)
    front = F.when(odd == 1, F.lit(2 / math.pi) * F.sin(angle) * F.cos(angle)).otherwise(F.sin(angle))
    inside = F.when(odd == 1, F.lit(2 / math.pi) * angle).otherwise(F.lit(0.0)) + front * first["sum"]
    # As many terms as bring the rest below 1e-16 of it; a small multiple of dof this far out.
    more = F.when((inside > _FAR) & (square > 0), F.ceil(-37 / F.ln(square))).otherwise(F.lit(0)).cast("int")
    rest = F.struct(F.lit(0.0).alias("sum"), first["term"].alias("term"))
    return inside, front * F.aggregate(terms(count + 1, count + more), rest, add)["sum"]


def t_p_value(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) for a whole number of degrees of freedom, null below 1."""
    inside, outside = _t_sums(t, dof.cast("long"))
    found = F.when(inside > _FAR, outside).otherwise(1 - inside)
    return F.when((dof.cast("long") >= 1) & t.isNotNull(), found)


def t_margin(dof: Column, alpha: float) -> Column:
    """t with P(|T| > t) = alpha, by halving an interval that holds it 60 times; null below 1 degree of freedom.

    The highest such t, at one degree of freedom, is 1 / tan(pi * alpha / 2).
    """

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["low"] + acc["high"]) / 2
        below = F.array(_t_sums(mid, dof.cast("long"))[0] < 1 - alpha)  # an array of one, so that it is summed once
        halves = F.transform(
            below,
            lambda b: F.struct(
                F.when(b, mid).otherwise(acc["low"]).alias("low"), F.when(b, acc["high"]).otherwise(mid).alias("high")
            ),
        )
        return F.element_at(halves, 1)

    top = 1 / math.tan(math.pi * alpha / 2)
    start = F.struct(F.lit(0.0).alias("low"), F.lit(top + 1).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda acc: (acc["low"] + acc["high"]) / 2)
    return F.when(dof.cast("long") >= 1, found)
