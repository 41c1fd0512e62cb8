"""Registered queries: each takes (spark, folder) and runs one analysis over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.functions.calendar import week_at, with_calendar
from aislemetrics.functions.columns import all_padded, pad_code, units
from aislemetrics.operators import (
    components,
    cycle,
    factors,
    items,
    moments,
    needstate,
    overlap,
    price,
    promo,
    reach,
    seasonality,
    varclus,
)
from aislemetrics.plans import params as p
from aislemetrics.session import materialise, shared_path
from aislemetrics.sources import readers, sinks
from aislemetrics.sources.star import PRICE_SEGMENT, SNAPSHOT_WEEK, Star, load_star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(load_star(spark, folder))
    return build


def _plain(df: DataFrame, **digits: int | None) -> DataFrame:
    """Rounded doubles, free of negative zeros, for the named columns."""

    def text(name: str) -> str:
        value = f"cast({name} as double)"
        return value if digits[name] is None else f"round({value}, {digits[name]}) + 0D"

    return df.selectExpr(*[f"{text(c)} AS {c}" if c in digits else f"`{c}`" for c in df.columns])


# --- columns, calendar, slices ------------------------------------------------------------------


@query
def prod_code_pad(star: Star) -> DataFrame:
    # The name column shows that text longer than a code stays whole.
    return star.raw_product_codes.select(
        "prod_code",
        pad_code(F.col("prod_code")).alias("padded"),
        pad_code(F.col("p_name")).alias("padded_name"),
        F.length("prod_code").alias("n_chars"),
    )


@query
def prod_code_check(star: Star) -> DataFrame:
    raw = all_padded(star.raw_product_codes).withColumnRenamed("all_padded", "raw_ok")
    return raw.select("raw_ok", all_padded(star.products).scalar().alias("padded_ok"))


@query
def date_dim(star: Star) -> DataFrame:
    return with_calendar(star.baskets.groupBy("date_id").agg(F.count("*").alias("n_baskets")))


@query
def week_shift(star: Star) -> DataFrame:
    dated = with_calendar(star.baskets.select("date_id"))
    weekly = dated.groupBy("fis_week_id", "fis_week_of_epoch_num").agg(F.count("*").alias("n_baskets"))
    number = F.col("fis_week_of_epoch_num")
    return weekly.select(
        "fis_week_id",
        "n_baskets",
        week_at(number - p.SHIFT).alias("earlier_week_id"),
        week_at(number + p.SHIFT).alias("later_week_id"),
    )


@query
def item_slice(star: Star) -> DataFrame:
    tagged = star.lines.join(items.tag_customers(star.baskets, star.segments), "transaction_fid")
    sliced = items.item_slice(
        tagged, *p.SLICE_WEEKS, weeks=star.weeks, stores=star.stores, formats=p.SLICE_FORMATS
    )
    return _plain(sliced.drop("weight_uom_qty"), net_spend_amt=None)


@query
def end_customer_spend(star: Star) -> DataFrame:
    kept = star.lines.join(items.end_customer_baskets(star.baskets, star.segments), "transaction_fid")
    spent = kept.groupBy("kptr_seg", "seg_value_code").agg(
        F.count("*").alias("n_lines"), F.sum("net_spend_amt").alias("sales")
    )
    return _plain(spent, sales=None)


@query
def units_rule(star: Star) -> DataFrame:
    return star.items.groupBy("prod_code").agg(
        F.count("*").alias("n_lines"), F.sum("item_qty").alias("item_qty"), F.sum(units()).alias("units")
    )


@query
def like_for_like_stores(star: Star) -> DataFrame:
    sliced = items.item_slice(star.items, *p.SLICE_WEEKS, weeks=star.weeks)
    return items.like_for_like_stores(sliced)


# --- promotion ----------------------------------------------------------------------------------


def _promo_list(star: Star) -> DataFrame:
    return star.products.filter(F.col("prod_hier_l20_code") == p.PROMO_TYPE).select("prod_code")


@query
def promo_rollup_products(star: Star) -> DataFrame:
    return promo.promo_rollup(star.products, _promo_list(star), "subclass").products


@query
def promo_share(star: Star) -> DataFrame:
    return promo.promo_rollup(star.products, _promo_list(star), "subclass").share


@query
def promo_share_class(star: Star) -> DataFrame:
    # The list is a whole class, so its cell of other products is null.
    return promo.promo_rollup(star.products, _promo_list(star), "class").share


@query
def day_of_week_filter(star: Star) -> DataFrame:
    return _daily(items.filter_day_of_week(star.items, p.WEEKEND))


@query
def day_of_week_filter_by_dates(star: Star) -> DataFrame:
    """Weekends by the retailer's own date table, whose weeks begin on Sunday."""
    dates = star.baskets.select("date_id").distinct().withColumn("fis_day_of_week_num", F.dayofweek("date_id"))
    return _daily(items.filter_day_of_week(star.items, p.OWN_WEEKEND, dates))


def _daily(lines: DataFrame) -> DataFrame:
    daily = lines.groupBy("date_id", "fis_day_of_week_num").agg(
        F.count("*").alias("n_lines"), F.sum("net_spend_amt").alias("sales")
    )
    return _plain(daily, sales=None)


@query
def product_filter(star: Star) -> DataFrame:
    sold = items.filter_products(star.items, star.products, _promo_list(star))
    per_product = sold.groupBy("prod_code").agg(F.count("*").alias("n_lines"), F.sum("net_spend_amt").alias("sales"))
    return _plain(per_product, sales=None)


# --- customer overlap ---------------------------------------------------------------------------


@query
def customer_overlap(star: Star) -> DataFrame:
    control = overlap.level_table(star.products, p.SUBCLASS, p.OVERLAP_GROUPS)
    return overlap.customer_overlap(
        star.items, control, p.OVERLAP_GROUPS, period=p.OVERLAP_WEEKS, weeks=star.weeks
    )


@query
def customer_overlap_control(star: Star) -> DataFrame:
    """Groups told apart by format and by date as well."""
    listed = overlap.level_table(star.products, p.CLASS, p.CONTROL_CLASSES)
    first, second = (F.to_date(F.lit(d)) for d in p.CONTROL_DAYS)
    control = listed.withColumns(
        {
            "fmt": F.when(F.col("bit") == 0, F.lit("1")).when(F.col("bit") == 1, F.lit("2")),
            "date_id": F.when(F.col("bit") == 1, first).when(F.col("bit") == 2, second),
        }
    )
    names = list(p.CONTROL_NAMES)
    return overlap.customer_overlap(star.items, control, names, star.stores, p.OVERLAP_WEEKS, star.weeks)


@query
def control_file_overlap(star: Star) -> DataFrame:
    """The same from a control file: written, read, lower-cased, split, and kept to known products."""
    names = list(p.CONTROL_CLASSES)
    listed = star.products.filter(F.col(p.CLASS).isin(names)).groupBy(F.col(p.CLASS).alias("prod_gr"))
    listed = listed.agg(F.concat_ws(",", F.sort_array(F.collect_list("prod_code")), F.lit("unknown")).alias("prod_code"))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("prod_gr"))
    path = shared_path(star.spark, "control")
    day = F.when(place == 3, F.to_date(F.lit(p.CONTROL_DAYS[1])))
    fmt = F.when(place < 3, F.concat(F.lit("FORMAT "), place))
    day_no = F.lit(None).cast("int").alias("fis_day_of_week_num")
    sinks.write_csv(listed.select(fmt.alias("fmt"), "prod_code", "prod_gr", day.alias("date_id"), day_no), path)
    control = readers.control_products(readers.read_control_file(star.spark, path))
    control = control.join(star.products.select("prod_code"), "prod_code", "left_semi")
    control = control.select("prod_code", (place - 1).cast("int").alias("bit"), "fmt", "date_id")
    stores = star.stores.withColumn("format_code", F.concat(F.lit("format "), F.col("format_code")))
    return overlap.customer_overlap(star.items, control, names, stores, p.OVERLAP_WEEKS, star.weeks)


@query
def daily_group_kpi(star: Star) -> DataFrame:
    groups = star.products.filter(F.col(p.SUBCLASS).isin(list(p.KPI_GROUPS))).select(
        F.col(p.SUBCLASS).alias("prod_gr"),
        "prod_code",
        F.explode(F.array(*[F.lit(f) for f in p.KPI_FORMATS])).alias("format_code"),
    )
    groups = groups.withColumn("fis_day_of_week_num", F.explode(F.array(*[F.lit(d) for d in p.KPI_DAYS])))
    return overlap.daily_group_kpi(star.items, groups, star.stores, p.PERIODS, star.weeks)


# --- reach --------------------------------------------------------------------------------------


def _reach_scope(star: Star) -> tuple[DataFrame, DataFrame]:
    """End-customer lines of the stores in scope, and the products of the listed styles."""
    lines = star.lines.join(items.end_customer_baskets(star.baskets, star.segments), "transaction_fid")
    lines = items.in_formats(lines, star.stores, p.SLICE_FORMATS)
    styles = star.products.filter(F.col("prod_style_code").between(*p.STYLES)).select("prod_style_code").distinct()
    return lines, items.of_styles(items.in_divisions(star.products, p.DIVISIONS), styles)


@query
def token_sets(star: Star) -> DataFrame:
    tokens = reach.token_sets(*_reach_scope(star), "transaction_fid", p.SUBCLASS)
    return tokens.select(
        "transaction_fid", F.size("set_cat").alias("n_products"), F.array_join("set_cat", ",").alias("products")
    )


def _basket_tokens(star: Star) -> DataFrame:
    in_scope = items.in_divisions(star.products, p.DIVISIONS)
    return reach.token_sets(star.items, in_scope, "transaction_fid", p.SUBCLASS)


@query
def greedy_reach(star: Star) -> DataFrame:
    """Products that reach the most baskets of end customers."""
    tokens = reach.token_sets(*_reach_scope(star), "transaction_fid", "prod_code")
    return reach.greedy_reach(tokens, p.REACH_STEPS, merge=False)


@query
def greedy_candidates(star: Star) -> DataFrame:
    return reach.greedy_candidates(_basket_tokens(star), p.REACH_STEPS, p.TOP_K)


@query
def greedy_reach_cards(star: Star) -> DataFrame:
    """Products that reach the most end customers."""
    tokens = reach.token_sets(*_reach_scope(star), "card_id", "prod_code")
    return reach.greedy_reach(tokens, p.REACH_STEPS, merge=False)


# --- price --------------------------------------------------------------------------------------


def _shoppers(star: Star) -> DataFrame:
    return price.segment_cards(
        star.segment_snapshots, star.segment_values, star.card_persons, SNAPSHOT_WEEK, PRICE_SEGMENT, p.PRICE_SEGMENTS
    )


def _price_points(star: Star) -> DataFrame:
    scope = star.products.filter(F.col(p.CLASS) == p.PRICE_CLASS)
    return price.price_points(star.items, scope, _shoppers(star), stores=star.stores)


def _group_points(star: Star) -> DataFrame:
    return price.price_points(star.items, star.products, _shoppers(star), stores=star.stores, by=[p.SUBCLASS])


@query
def price_points(star: Star) -> DataFrame:
    return _plain(_price_points(star), units=2, sales=4, ppu=2)


@query
def price_points_period(star: Star) -> DataFrame:
    """Price points of some weeks, over the products of the commercial divisions in scope."""
    scope = price.in_commercial_divisions(star.products, p.DIVISIONS)
    points = price.price_points(
        star.items, scope, _shoppers(star), period=p.PRICE_WEEKS, weeks=star.weeks, stores=star.stores, by=[p.CLASS]
    )
    return _plain(points, units=2, sales=4, ppu=2)


@query
def price_describe(star: Star) -> DataFrame:
    described = price.describe(_price_points(star), ["units", "sales", "ppu"])
    # Quarters of 4-digit money end after 6 digits.
    quartiles = dict.fromkeys(["min", "q25", "q50", "q75", "max"], 6)
    return _plain(described, mean=4, std=4, **quartiles)


@query
def price_histogram(star: Star) -> DataFrame:
    return cycle.histogram(_price_points(star), "ppu")


@query
def price_linear(star: Star) -> DataFrame:
    fits = price.fit_price(_price_points(star), 1)
    return _plain(fits, coef_0=4, coef_1=6, mse=4, r2=6, min_x=2, max_x=2)


@query
def price_quadratic(star: Star) -> DataFrame:
    fits = price.fit_price(_price_points(star), 2)
    return _plain(fits, coef_0=4, coef_1=6, coef_2=8, mse=4, r2=6, min_x=2, max_x=2)


@query
def price_by_group(star: Star) -> DataFrame:
    fits = price.fit_price(_group_points(star), 2, by=[p.SUBCLASS])
    return _plain(fits, coef_0=4, coef_1=6, coef_2=8, mse=4, r2=6, min_x=2, max_x=2)


_STATS = {
    **{f"coef_{i}": 4 for i in range(3)},
    **{f"std_err_{i}": 4 for i in range(3)},
    **{f"t_{i}": 4 for i in range(3)},
    "mse": 4,
    "r2": 6,
    "adj_r2": 6,
    "f_value": 4,
    "log_likelihood": 4,
    "aic": 4,
    "bic": 4,
    "durbin_watson": 6,
    "skew": 6,
    "kurtosis": 6,
    "jarque_bera": 4,
    "prob_jb": 6,
    "omnibus": 4,
    "prob_omnibus": 6,
    "cond_no": 2,
}


def _summary(points: DataFrame, degree: int, by: tuple[str, ...] = ()) -> DataFrame:
    summary = price.fit_summary(points, degree, by)
    digits = {c: d for c, d in _STATS.items() if c in summary.columns}
    if degree == 2:
        digits["cond_no"] = -3  # about 10 digits before the point
    return _plain(summary, **digits)


@query
def price_stats(star: Star) -> DataFrame:
    return _summary(_price_points(star), 1)


@query
def price_stats_by_group(star: Star) -> DataFrame:
    return _summary(_group_points(star), 1, (p.SUBCLASS,))


@query
def price_stats_quadratic(star: Star) -> DataFrame:
    return _summary(_group_points(star), 2, (p.SUBCLASS,))


@query
def price_coefficient_tests(star: Star) -> DataFrame:
    by = [p.SUBCLASS]
    tested = price.coefficient_tests(price.fit_summary(_group_points(star), 2, by), by)
    return _plain(tested, coef=4, std_err=4, t=4, p_value=6, low=3, high=3, prob_f=6)


@query
def price_curve(star: Star) -> DataFrame:
    """The fitted curves in steps of a cent, with prices brought to a few dozen per unit."""
    scaled = _group_points(star).withColumn("ppu", F.round(F.col("ppu") / p.CURVE_PRICE_UNIT, 2))
    fits = price.fit_price(scaled, 2, by=[p.SUBCLASS])
    return _plain(price.predict_grid(fits, 2, by=[p.SUBCLASS], step=p.PRICE_STEP), ppu=2, predicted=1)


# --- seasonality --------------------------------------------------------------------------------


def _weekly(star: Star, level: str) -> DataFrame:
    return seasonality.weekly_kpi(
        star.items, star.products, star.weeks, level, *p.SEASON_WEEKS, divisions=p.DIVISIONS
    )


@query
def weekly_kpi(star: Star) -> DataFrame:
    # Few subclasses sell every week: the completeness rule drops the others.
    return _plain(_weekly(star, p.SUBCLASS), units=2, sales=4)


@query
def seasonality_index(star: Star) -> DataFrame:
    return seasonality.seasonality_index(_weekly(star, p.CLASS), ["units", "sales"], "fis_week_id", p.CLASS)


@query
def seasonality_short(star: Star) -> DataFrame:
    return seasonality.recent_seasonality(
        star.items, star.products, star.weeks, "prod_hier_l50_code", **p.SHORT_SEASON, divisions=p.DIVISIONS
    )


# --- shopping cycle -----------------------------------------------------------------------------


def _cycles(star: Star) -> DataFrame:
    scope = star.products.filter(F.col(p.SUBCLASS) == p.CYCLE_BRAND)
    return cycle.shopping_cycle(items.filter_products(star.items, star.products, scope))


@query
def shopping_cycle(star: Star) -> DataFrame:
    return _cycles(star)


@query
def shopping_cycle_overall(star: Star) -> DataFrame:
    return cycle.overall_cycle(cycle.shopping_cycle(star.items))


@query
def cycle_histogram(star: Star) -> DataFrame:
    return cycle.histogram(_cycles(star), "median_day_cycle")


@query
def cycle_cumulative(star: Star) -> DataFrame:
    return cycle.cumulative_cycles(_cycles(star))


# --- need states --------------------------------------------------------------------------------


@query
def card_metrics(star: Star) -> DataFrame:
    return _plain(needstate.card_metrics(star.lines, star.products, p.DIVISIONS, star.baskets), sales=None)


@query
def card_subclass_metrics(star: Star) -> DataFrame:
    metrics = needstate.card_subclass_metrics(star.lines, star.products, p.DIVISIONS, star.baskets)
    return _plain(metrics, subcl_sales=None)


def _need(star: Star) -> DataFrame:
    return needstate.need_state(star.lines, star.products, p.DIVISIONS, star.baskets)


@query
def need_state(star: Star) -> DataFrame:
    return _plain(_need(star), pct_visits=6, pct_sales=6)


def _features(star: Star) -> list[str]:
    return needstate.feature_values(star.products, p.DIVISIONS)


@query
def need_matrix(star: Star) -> DataFrame:
    features = _features(star)
    wide = needstate.need_matrix(_need(star), features)
    return wide.selectExpr("card_id", *[f"round(`{f}`, 6) + 0D AS `{f}`" for f in features])


def _segmented(star: Star, need: DataFrame) -> DataFrame:
    return need.join(star.segments.select("card_id", "seg_value_code"), "card_id")


SEGMENT = ("seg_value_code",)


def _matrix(star: Star, by: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    features = _features(star)
    need = _segmented(star, _need(star)) if by else _need(star)
    return needstate.need_matrix(need, features, keys=[*by, "card_id"]), features


def _stored_matrix(star: Star, by: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The matrix written once, for analyses that go over it in several jobs."""
    matrix, features = _matrix(star, by)
    return materialise(matrix, "matrix"), features


def _sums(star: Star, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the customers' sparse vectors."""
    need = _segmented(star, _need(star)) if by else _need(star)
    return moments.sparse_pair_sums(moments.sparse_vectors(need, by), _features(star), by)


def _corr(star: Star, by: tuple[str, ...] = ()) -> DataFrame:
    return moments.correlation_of(_sums(star, by), by)


@query
def feature_correlation(star: Star) -> DataFrame:
    return _plain(_corr(star), r=6)


@query
def segment_correlation(star: Star) -> DataFrame:
    return _plain(_corr(star, SEGMENT), r=6)


@query
def feature_covariance(star: Star) -> DataFrame:
    return _plain(moments.covariance_of(_sums(star)), cov=8)


@query
def scatter(star: Star) -> DataFrame:
    return _plain(moments.scatter_of(_sums(star)), s=6)


@query
def feature_stats(star: Star) -> DataFrame:
    return _plain(moments.feature_stats_of(_sums(star)), mean=6, std=6)


@query
def pca_rows(star: Star) -> DataFrame:
    return components.principal_components(*_stored_matrix(star), p.N_COMPONENTS)


@query
def pca_corr_rows(star: Star) -> DataFrame:
    return components.principal_components(*_stored_matrix(star), p.N_COMPONENTS, on="corr_rows")


@query
def pca_by_segment(star: Star) -> DataFrame:
    return components.principal_components(*_stored_matrix(star, SEGMENT), p.N_COMPONENTS, on="corr", by=SEGMENT)


@query
def pca_model_scores(star: Star) -> DataFrame:
    """Fit, save, load and apply Spark's own PCA model."""
    need = materialise(_need(star), "need")
    features = _features(star)
    matrix = needstate.need_matrix(need, features)
    path = shared_path(star.spark, "pca-model")
    sinks.save_pca_model(components.fit_pca_model(matrix, features, p.N_COMPONENTS), path)
    return components.pca_model_scores(sinks.load_pca_model(path), matrix, features)


@query
def svd_values(star: Star) -> DataFrame:
    return components.svd(*_stored_matrix(star))


@query
def svd_left_vectors(star: Star) -> DataFrame:
    need = materialise(_need(star), "need")
    features = _features(star)
    matrix = materialise(needstate.need_matrix(need, features), "matrix")
    sums = moments.pair_sums(matrix, features)
    right = components.svd(matrix, features, p.N_COMPONENTS)
    return components.left_vectors(need, moments.feature_stats_of(sums), right, p.N_COMPONENTS)


@query
def explained_share(star: Star) -> DataFrame:
    matrix, features = _stored_matrix(star)
    return moments.explained(components.principal_components(matrix, features, len(features), on="corr"))


@query
def q_mode_scores(star: Star) -> DataFrame:
    return components.q_mode_scores(*_stored_matrix(star))


@query
def factor_loadings(star: Star) -> DataFrame:
    return factors.factor_loadings(*_stored_matrix(star), p.N_FACTORS)


@query
def factor_loadings_by_segment(star: Star) -> DataFrame:
    return factors.factor_loadings(*_stored_matrix(star, SEGMENT), p.N_FACTORS, SEGMENT)


@query
def factor_members(star: Star) -> DataFrame:
    loadings = factors.factor_loadings(*_stored_matrix(star), p.N_FACTORS)
    return factors.factor_members(loadings, star.products, p.MEMBER_FACTOR)


@query
def factor_scores(star: Star) -> DataFrame:
    need = materialise(_need(star), "need")
    features = _features(star)
    matrix = materialise(needstate.need_matrix(need, features), "matrix")
    loadings = factors.factor_loadings(matrix, features, p.N_FACTORS)
    return factors.factor_scores(need, loadings, moments.feature_stats(matrix, features), p.N_FACTORS)


# --- variable clusters --------------------------------------------------------------------------


def _start_clusters(star: Star) -> DataFrame:
    """Start assignment of the subclasses, by brand number."""
    brand = F.col("prod_hier_l10_code")
    number = F.substring_index(brand, "#", -1).cast("int")
    cluster = sum((F.when(number >= low, F.lit(1)).otherwise(F.lit(0)) for low in p.CLUSTER_STARTS[1:]), F.lit(1))
    scope = items.in_divisions(star.products, p.DIVISIONS)
    return scope.select(F.concat(F.lit("s"), brand).alias("feature"), cluster.alias("cluster")).distinct()


@query
def cluster_correlation(star: Star) -> DataFrame:
    near = varclus.cluster_correlation(materialise(_corr(star), "corr"), _start_clusters(star))
    return _plain(near, r=6, variance=6)


@query
def cluster_correlation_pca(star: Star) -> DataFrame:
    matrix, features = _stored_matrix(star)
    start = _start_clusters(star)
    weights = varclus.component_weights(matrix, features, start)
    return varclus.cluster_correlation(moments.correlation(matrix, features), start, weights)


@query
def cluster_reassign(star: Star) -> DataFrame:
    return varclus.reassign(materialise(_corr(star), "corr"), _start_clusters(star), max_iter=3)


@query
def cluster_r2_ratio(star: Star) -> DataFrame:
    ratios = varclus.r2_ratio(materialise(_corr(star), "corr"), _start_clusters(star))
    return _plain(ratios, r2_own=6, r2_next=6, ratio=6)


@query
def variable_clusters(star: Star) -> DataFrame:
    return varclus.variable_clusters(*_stored_matrix(star), p.N_CLUSTERS)


@query
def variable_clusters_by_segment(star: Star) -> DataFrame:
    return varclus.variable_clusters(*_stored_matrix(star, SEGMENT), p.N_CLUSTERS, by=SEGMENT)


@query
def cluster_scores(star: Star) -> DataFrame:
    need = materialise(_need(star), "need")
    features = _features(star)
    matrix = materialise(needstate.need_matrix(need, features), "matrix")
    sums = materialise(moments.pair_sums(matrix, features), "sums")
    clusters = varclus.variable_clusters(matrix, features, p.N_CLUSTERS)
    return varclus.cluster_scores(need, clusters, moments.feature_stats_of(sums), p.N_CLUSTERS)


# --- sinks --------------------------------------------------------------------------------------


@query
def sink_roundtrip(star: Star) -> DataFrame:
    """Need states to parquet, products to CSV, both read back and joined."""
    need_path, product_path = shared_path(star.spark, "need"), shared_path(star.spark, "products")
    sinks.write_parquet(_need(star), need_path)
    columns = ["prod_code", "prod_hier_l10_code", "prod_hier_l50_code"]
    sinks.write_csv(star.products.select(*columns), product_path)
    listed = readers.read_text_csv(star.spark, product_path, columns)
    sizes = items.in_divisions(listed, p.DIVISIONS).groupBy("prod_hier_l10_code").agg(
        F.count("*").alias("n_products"), F.min("prod_code").alias("first_code")
    )
    need = readers.read_parquet(star.spark, need_path).groupBy("subcl")
    need = need.agg(F.count("*").alias("n_cards"), F.avg("pct_visits").alias("avg_visits"))
    joined = need.join(sizes, F.col("subcl") == F.concat(F.lit("s"), F.col("prod_hier_l10_code")))
    return _plain(joined.select("subcl", "n_cards", "avg_visits", "n_products", "first_code"), avg_visits=6)


@query
def table_roundtrip(star: Star) -> DataFrame:
    """Products to a managed table; counted from there, and looked up in the list of tables."""
    name = f"products_{uuid.uuid4().hex}"
    sinks.write_table(star.products.select("prod_code", "prod_hier_l10_code"), name, files=1)
    listed = name in readers.list_tables(star.spark)
    counted = readers.read_table(star.spark, name).groupBy("prod_hier_l10_code").agg(F.count("*").alias("n_products"))
    result = materialise(counted.withColumn("listed", F.lit(listed)), "table")
    star.spark.sql(f"DROP TABLE {name}")
    return result


@query
def growing_report(star: Star) -> DataFrame:
    """Lines per store of two years, one run each; the first run is written twice and stands once."""
    path = shared_path(star.spark, "report")
    for name in ("TY", "LY", "TY"):
        sold = items.weeks_between(star.items, *p.PERIODS[name], star.weeks)
        sinks.write_run(sold.groupBy("store_id").agg(F.count("*").alias("n_lines")), path, name)
    return readers.read_parquet(star.spark, path)


@query
def item_slice_by_week(star: Star) -> DataFrame:
    """A slice of the fact from folders by week."""
    path = shared_path(star.spark, "items-by-week")
    sinks.write_by_week(star.items, path, tasks_per_week=1)
    sliced = items.weeks_between(readers.read_parquet(star.spark, path), *p.SLICE_WEEKS)
    sliced = items.in_formats(sliced, star.stores, p.SLICE_FORMATS)
    return sliced.select("transaction_fid", "prod_code", "store_id", "fis_week_id", "item_qty")


@query
def shopping_cycle_bucketed(star: Star) -> DataFrame:
    """Cycles of all cards from a table dealt and sorted by card."""
    name = f"card_days_{uuid.uuid4().hex}"
    sinks.write_bucketed(star.items.select("card_id", "date_id"), name, ["card_id"], p.BUCKETS)
    result = materialise(cycle.shopping_cycle(readers.read_table(star.spark, name)), "cycles")
    star.spark.sql(f"DROP TABLE {name}")
    return result


@query
def segment_cards_by_dates(star: Star) -> DataFrame:
    """Cards by the snapshot on the last date of a week of the retailer's own, which ends on Saturday."""
    date, week = F.col("date_id"), F.floor(F.datediff("date_id", F.lit(p.OWN_WEEKS_FROM)) / 7).cast("int")
    dates = star.items.select("date_id").distinct().withColumn("fis_week_id", week)
    snapshots = star.segment_snapshots.withColumn("date_id", F.date_sub(date, 1))
    return price.segment_cards(
        snapshots, star.segment_values, star.card_persons, p.OWN_SNAPSHOT_WEEK, PRICE_SEGMENT, p.PRICE_SEGMENTS, dates
    )
