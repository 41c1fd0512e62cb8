"""SQL equivalents of the registered queries, for DuckDB over the same tables.

Queries that plain SQL cannot express (eigen-decompositions, factor and cluster searches, t
quantiles) have no entry; tests check them against brute force instead.
"""

from __future__ import annotations

from aislemetrics.plans import params as p

ORACLE_SQL: dict[str, str] = {}

# --- views as common table expressions ----------------------------------------------------------

_CODE = "CASE WHEN length(CAST({0} AS VARCHAR)) < 9 THEN lpad(CAST({0} AS VARCHAR), 9, '0') ELSE CAST({0} AS VARCHAR) END"
_WEEK = "CAST(isoyear({0}) * 100 + week({0}) AS INTEGER)"

_CTE = {
    "item": (
        (),
        f"""
        SELECT l_orderkey AS transaction_fid,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey END AS card_id,
               {_CODE.format("l_partkey")} AS prod_code,
               l_suppkey AS store_id,
               CAST(o_orderdate AS DATE) AS date_id,
               {_WEEK.format("o_orderdate")} AS fis_week_id,
               l_quantity AS item_qty,
               CASE l_returnflag WHEN 'A' THEN l_quantity * 0.5 WHEN 'N' THEN 0.0 END AS weight_uom_qty,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2))
                    * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))
                    * CAST(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -1 ELSE 1 END AS DECIMAL(1,0))
                    AS DECIMAL(18,4)) AS net_spend_amt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "prod": (
        (),
        f"""
        SELECT {_CODE.format("p_partkey")} AS prod_code,
               p_size AS prod_style_code,
               p_brand AS l10,
               p_type AS l20,
               CASE WHEN p_type IN ('PROMO', 'SMALL') THEN '99' ELSE '01' END AS l50
        FROM part""",
    ),
    "store": (
        (),
        """
        SELECT s_suppkey AS store_id, s_name AS store_code, CAST(n_regionkey + 1 AS VARCHAR) AS format_code
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "seg": (
        (),
        """
        SELECT c_custkey AS card_id,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Trader'
                    WHEN c_mktsegment <> 'FURNITURE' THEN 'Shopper' END AS kptr_seg,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'LA' WHEN 'MACHINERY' THEN 'MM' ELSE 'UM' END AS seg_value_code
        FROM customer""",
    ),
    # Two snapshots of the persons' segments; in the earlier one everybody sits one segment on.
    "snap": (
        (),
        """
        SELECT c_custkey + 1000000000 AS prsn_id, taken.date_id, (s.place + taken.move) % 3 AS seg_value
        FROM customer
        JOIN (VALUES ('BUILDING', 0), ('MACHINERY', 1), ('AUTOMOBILE', 2), ('FURNITURE', 2), ('HOUSEHOLD', 2))
             s(segment, place) ON c_mktsegment = s.segment
        CROSS JOIN (VALUES (DATE '2001-05-20', 0), (DATE '2001-05-17', 1)) taken(date_id, move)""",
    ),
    "shopper": (
        ("snap",),
        f"""
        SELECT c_custkey AS card_id FROM customer
        WHERE c_custkey + 1000000000 IN (
          SELECT prsn_id FROM snap JOIN (VALUES (0, 'LA'), (1, 'MM'), (2, 'UM')) v(seg_value, code) USING (seg_value)
          WHERE code IN {p.PRICE_SEGMENTS} AND date_id = (SELECT max(date_id) FROM snap))""",
    ),
    "sold": (
        ("item", "prod", "store", "shopper"),
        f"""
        SELECT prod.l10, prod.l20, prod.l50, item.date_id, item.fis_week_id, item.net_spend_amt,
               CASE WHEN weight_uom_qty > 0 THEN weight_uom_qty ELSE item_qty END AS units
        FROM item JOIN prod USING (prod_code)
        WHERE net_spend_amt > 0
          AND store_id IN (SELECT store_id FROM store WHERE format_code IN ('1','2','3','4','5'))
          AND card_id IN (SELECT card_id FROM shopper)""",
    ),
    "points": (
        ("sold",),
        f"""
        SELECT date_id, sum(units) AS units, CAST(sum(net_spend_amt) AS DOUBLE) AS sales,
               round(CAST(sum(net_spend_amt) AS DOUBLE) / sum(units), 2) AS ppu
        FROM sold WHERE l20 = '{p.PRICE_CLASS}' GROUP BY date_id""",
    ),
    "group_points": (
        ("sold",),
        """
        SELECT l10, date_id, sum(units) AS units, CAST(sum(net_spend_amt) AS DOUBLE) AS sales,
               round(CAST(sum(net_spend_amt) AS DOUBLE) / sum(units), 2) AS ppu
        FROM sold GROUP BY l10, date_id""",
    ),
    "scoped": (
        ("item", "prod"),
        f"""
        SELECT item.*, l10, l20, l50 FROM item JOIN prod USING (prod_code) WHERE l50 IN ('{p.DIVISIONS[0]}')""",
    ),
    "cardm": (
        ("scoped",),
        """
        SELECT card_id, count(DISTINCT transaction_fid) AS visits, sum(net_spend_amt) AS sales
        FROM scoped WHERE card_id IS NOT NULL GROUP BY card_id""",
    ),
    "subm": (
        ("scoped",),
        """
        SELECT card_id, l10, count(DISTINCT transaction_fid) AS subcl_visits, sum(net_spend_amt) AS subcl_sales
        FROM scoped WHERE card_id IS NOT NULL GROUP BY card_id, l10""",
    ),
    "need": (
        ("cardm", "subm"),
        """
        SELECT card_id, 's' || l10 AS subcl, subcl_visits / visits AS pct_visits,
               CAST(subcl_sales AS DOUBLE) / nullif(CAST(sales AS DOUBLE), 0) AS pct_sales
        FROM subm JOIN cardm USING (card_id)""",
    ),
    # Every card with every feature in scope, absent ones 0.
    "grid": (
        ("need", "prod"),
        f"""
        SELECT c.card_id, f.feature, coalesce(n.pct_visits, 0) AS x
        FROM (SELECT DISTINCT card_id FROM need) c
        CROSS JOIN (SELECT DISTINCT 's' || l10 AS feature FROM prod WHERE l50 IN ('{p.DIVISIONS[0]}')) f
        LEFT JOIN need n ON n.card_id = c.card_id AND n.subcl = f.feature""",
    ),
    "corr_long": (
        ("grid",),
        """
        SELECT a.feature AS i, b.feature AS j,
               CASE WHEN a.feature = b.feature THEN 1.0 ELSE corr(a.x, b.x) END AS r
        FROM grid a JOIN grid b USING (card_id) GROUP BY a.feature, b.feature""",
    ),
    "start": (
        ("prod",),
        f"""
        SELECT DISTINCT 's' || l10 AS feature,
               {" + ".join(["1"] + [f"CASE WHEN CAST(split_part(l10, '#', 2) AS INTEGER) >= {n} THEN 1 ELSE 0 END" for n in p.CLUSTER_STARTS[1:]])} AS cluster
        FROM prod WHERE l50 IN ('{p.DIVISIONS[0]}')""",
    ),
    "cycles": (
        ("item", "prod"),
        f"""
        SELECT card_id, median(gap) AS median_day_cycle FROM (
          SELECT card_id, lead(date_id) OVER (PARTITION BY card_id ORDER BY date_id) - date_id AS gap
          FROM (SELECT DISTINCT card_id, date_id FROM item JOIN prod USING (prod_code)
                WHERE card_id IS NOT NULL AND l10 = '{p.CYCLE_BRAND}'))
        WHERE gap IS NOT NULL GROUP BY card_id""",
    ),
    "tokens": (
        ("scoped",),
        "SELECT DISTINCT transaction_fid AS k, l10 AS product FROM scoped",
    ),
    "lines": (
        ("item", "seg", "store"),
        f"""
        SELECT item.* FROM item JOIN seg USING (card_id)
        WHERE kptr_seg NOT IN ('Trader', 'trader')
          AND store_id IN (SELECT store_id FROM store WHERE format_code IN {p.SLICE_FORMATS})""",
    ),
    "styled": (
        ("prod",),
        f"""
        SELECT * FROM prod
        WHERE l50 IN ('{p.DIVISIONS[0]}') AND prod_style_code BETWEEN {p.STYLES[0]} AND {p.STYLES[1]}""",
    ),
}


def _with(*names: str, extra: str = "") -> str:
    """WITH clause of the named expressions and what they need, each once."""
    order: list[str] = []

    def visit(name: str) -> None:
        needs, _ = _CTE[name]
        for need in needs:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({_CTE[name][1]})" for name in order]
    return "WITH " + ",\n".join(parts + ([extra] if extra else [])) + "\n"


def _round(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


# --- columns, calendar, slices ------------------------------------------------------------------

ORACLE_SQL["prod_code_pad"] = f"""
SELECT CAST(p_partkey AS VARCHAR) AS prod_code,
       {_CODE.format("p_partkey")} AS padded,
       {_CODE.format("p_name")} AS padded_name,
       CAST(length(CAST(p_partkey AS VARCHAR)) AS INTEGER) AS n_chars
FROM part"""

ORACLE_SQL["prod_code_check"] = f"""
SELECT bool_and(length(CAST(p_partkey AS VARCHAR)) = 9) AS raw_ok,
       bool_and(length({_CODE.format("p_partkey")}) = 9) AS padded_ok
FROM part"""

_EPOCH = "CAST(floor((CAST({0} AS DATE) - DATE '1969-12-29') / 7) AS INTEGER)"

ORACLE_SQL["date_dim"] = f"""
SELECT CAST(o_orderdate AS DATE) AS date_id, count(*) AS n_baskets,
       {_WEEK.format("o_orderdate")} AS fis_week_id,
       {_EPOCH.format("o_orderdate")} AS fis_week_of_epoch_num,
       CAST(isodow(o_orderdate) AS INTEGER) AS fis_day_of_week_num
FROM orders GROUP BY ALL"""

ORACLE_SQL["week_shift"] = f"""
SELECT {_WEEK.format("o_orderdate")} AS fis_week_id, count(*) AS n_baskets,
       {_WEEK.format(f"(o_orderdate - INTERVAL {7 * p.SHIFT} DAY)")} AS earlier_week_id,
       {_WEEK.format(f"(o_orderdate + INTERVAL {7 * p.SHIFT} DAY)")} AS later_week_id
FROM orders GROUP BY ALL"""

ORACLE_SQL["item_slice"] = (
    _with("item", "store", "seg")
    + f"""
SELECT transaction_fid, card_id, prod_code, store_id, date_id, fis_week_id, item_qty,
       CAST(net_spend_amt AS DOUBLE) AS net_spend_amt, kptr_seg, seg_value_code
FROM item LEFT JOIN seg USING (card_id)
WHERE fis_week_id BETWEEN {p.SLICE_WEEKS[0]} AND {p.SLICE_WEEKS[1]}
  AND store_id IN (SELECT store_id FROM store WHERE format_code IN {p.SLICE_FORMATS})"""
)

ORACLE_SQL["end_customer_spend"] = (
    _with("item", "seg")
    + """
SELECT kptr_seg, seg_value_code, count(*) AS n_lines, CAST(sum(net_spend_amt) AS DOUBLE) AS sales
FROM item JOIN seg USING (card_id) WHERE kptr_seg NOT IN ('Trader', 'trader')
GROUP BY kptr_seg, seg_value_code"""
)

ORACLE_SQL["units_rule"] = (
    _with("item")
    + """
SELECT prod_code, count(*) AS n_lines, sum(item_qty) AS item_qty,
       sum(CASE WHEN weight_uom_qty > 0 THEN weight_uom_qty ELSE item_qty END) AS units
FROM item GROUP BY prod_code"""
)

ORACLE_SQL["like_for_like_stores"] = (
    _with("item")
    + f"""
, sliced AS (SELECT * FROM item WHERE fis_week_id BETWEEN {p.SLICE_WEEKS[0]} AND {p.SLICE_WEEKS[1]})
SELECT store_id, count(DISTINCT fis_week_id) AS n_wk FROM sliced GROUP BY store_id
HAVING count(DISTINCT fis_week_id) = (SELECT count(DISTINCT fis_week_id) FROM sliced)"""
)

# --- promotion ----------------------------------------------------------------------------------

ORACLE_SQL["promo_rollup_products"] = (
    _with("prod")
    + f"""
SELECT prod_code FROM prod WHERE l10 IN (SELECT l10 FROM prod WHERE l20 = '{p.PROMO_TYPE}')"""
)


def _promo_share(level: str, prefix: str) -> str:
    return (
        _with("prod")
        + f"""
, cells AS (
  SELECT {level},
         nullif(count(*) FILTER (l20 = '{p.PROMO_TYPE}'), 0) AS n_listed,
         nullif(count(*) FILTER (l20 <> '{p.PROMO_TYPE}'), 0) AS n_other
  FROM prod WHERE {level} IN (SELECT {level} FROM prod WHERE l20 = '{p.PROMO_TYPE}') GROUP BY {level})
SELECT {level} AS {prefix}_code, {level} AS {prefix}_desc, n_listed, n_other,
       n_listed + n_other AS n_products,
       round(n_listed / (n_listed + n_other) * 100, 2) AS pct_listed
FROM cells"""
    )


ORACLE_SQL["promo_share"] = _promo_share("l10", "prod_hier_l10")
ORACLE_SQL["promo_share_class"] = _promo_share("l20", "prod_hier_l20")

ORACLE_SQL["day_of_week_filter"] = (
    _with("item")
    + f"""
SELECT date_id, CAST(isodow(date_id) AS INTEGER) AS fis_day_of_week_num, count(*) AS n_lines,
       CAST(sum(net_spend_amt) AS DOUBLE) AS sales
FROM item WHERE isodow(date_id) IN {p.WEEKEND} GROUP BY date_id"""
)

ORACLE_SQL["day_of_week_filter_by_dates"] = (
    _with("item")
    + f"""
SELECT date_id, CAST(dayofweek(date_id) + 1 AS INTEGER) AS fis_day_of_week_num, count(*) AS n_lines,
       CAST(sum(net_spend_amt) AS DOUBLE) AS sales
FROM item WHERE dayofweek(date_id) + 1 IN {p.OWN_WEEKEND} GROUP BY date_id"""
)

ORACLE_SQL["product_filter"] = (
    _with("item", "prod")
    + f"""
SELECT prod_code, count(*) AS n_lines, CAST(sum(net_spend_amt) AS DOUBLE) AS sales
FROM item WHERE prod_code IN (SELECT prod_code FROM prod WHERE l20 = '{p.PROMO_TYPE}') GROUP BY prod_code"""
)

# --- customer overlap ---------------------------------------------------------------------------


def _overlap(hits: str, names: tuple[str, ...]) -> str:
    """Every combination by set intersection: a card counts when it holds all groups of the list."""
    groups = ", ".join(f"({i}, '{name}')" for i, name in enumerate(names))
    held = " AND ".join(
        f"(c.comb & {1 << i} = 0 OR EXISTS (SELECT 1 FROM hits h WHERE h.card_id = k.card_id AND h.g = {i}))"
        for i in range(len(names))
    )
    return f"""
, hits AS MATERIALIZED ({hits})
, cards AS (SELECT DISTINCT card_id FROM hits)
, names(g, name) AS (VALUES {groups})
, combos AS (SELECT CAST(range AS INTEGER) AS comb FROM range(1, {1 << len(names)}))
, labels AS (
  SELECT comb, count(*) AS comb_size, string_agg(name, ' , ' ORDER BY g) AS comb_flag
  FROM combos JOIN names ON comb & (1 << g) <> 0 GROUP BY comb)
, counted AS (SELECT c.comb, count(*) AS n FROM combos c JOIN cards k ON {held} GROUP BY c.comb)
SELECT CAST(comb_size AS INTEGER) AS comb_size, comb_flag, coalesce(n, 0) AS n_custs
FROM labels LEFT JOIN counted USING (comb)"""


ORACLE_SQL["customer_overlap"] = _with("item", "prod") + _overlap(
    f"""SELECT DISTINCT card_id, list_position({list(p.OVERLAP_GROUPS)}, l10) - 1 AS g
    FROM item JOIN prod USING (prod_code)
    WHERE card_id IS NOT NULL AND l10 IN {p.OVERLAP_GROUPS}
      AND fis_week_id BETWEEN {p.OVERLAP_WEEKS[0]} AND {p.OVERLAP_WEEKS[1]}""",
    p.OVERLAP_GROUPS,
)

ORACLE_SQL["customer_overlap_control"] = _with("item", "prod", "store") + _overlap(
    f"""SELECT DISTINCT card_id, list_position({list(p.CONTROL_CLASSES)}, l20) - 1 AS g
    FROM item JOIN prod USING (prod_code) JOIN store USING (store_id)
    WHERE card_id IS NOT NULL AND fis_week_id BETWEEN {p.OVERLAP_WEEKS[0]} AND {p.OVERLAP_WEEKS[1]}
      AND ((l20 = '{p.CONTROL_CLASSES[0]}' AND format_code = '1')
        OR (l20 = '{p.CONTROL_CLASSES[1]}' AND format_code = '2' AND date_id = DATE '{p.CONTROL_DAYS[0]}')
        OR (l20 = '{p.CONTROL_CLASSES[2]}' AND date_id = DATE '{p.CONTROL_DAYS[1]}'))""",
    p.CONTROL_NAMES,
)

ORACLE_SQL["control_file_overlap"] = _with("item", "prod", "store") + _overlap(
    f"""SELECT DISTINCT card_id, list_position({list(p.CONTROL_CLASSES)}, l20) - 1 AS g
    FROM item JOIN prod USING (prod_code) JOIN store USING (store_id)
    WHERE card_id IS NOT NULL AND fis_week_id BETWEEN {p.OVERLAP_WEEKS[0]} AND {p.OVERLAP_WEEKS[1]}
      AND ((l20 = '{p.CONTROL_CLASSES[0]}' AND format_code = '1')
        OR (l20 = '{p.CONTROL_CLASSES[1]}' AND format_code = '2')
        OR (l20 = '{p.CONTROL_CLASSES[2]}' AND date_id = DATE '{p.CONTROL_DAYS[1]}'))""",
    p.CONTROL_CLASSES,
)

_TAG = " ".join(f"WHEN fis_week_id BETWEEN {a} AND {b} THEN '{name}'" for name, (a, b) in p.PERIODS.items())

ORACLE_SQL["daily_group_kpi"] = (
    _with("item", "prod", "store")
    + f"""
SELECT CASE {_TAG} END AS year, format_code, l10 AS prod_gr, date_id,
       CAST(isodow(date_id) AS INTEGER) AS fis_day_of_week_num,
       count(DISTINCT transaction_fid) AS n_baskets, count(DISTINCT card_id) AS n_cards
FROM item JOIN prod USING (prod_code) JOIN store USING (store_id)
WHERE CASE {_TAG} END IS NOT NULL AND l10 IN {p.KPI_GROUPS} AND format_code IN {p.KPI_FORMATS}
  AND isodow(date_id) IN {p.KPI_DAYS}
GROUP BY ALL"""
)

# --- reach --------------------------------------------------------------------------------------

ORACLE_SQL["token_sets"] = (
    _with("lines", "styled")
    + """
SELECT transaction_fid, CAST(count(DISTINCT l10) AS INTEGER) AS n_products,
       string_agg(DISTINCT l10, ',' ORDER BY l10) AS products
FROM lines JOIN styled USING (prod_code) GROUP BY transaction_fid"""
)


def _greedy(steps: int, top_k: int, select: str) -> str:
    """The rule, unrolled: per step count the keys of every candidate that no earlier pick covers."""
    parts = [
        """, products AS MATERIALIZED (SELECT DISTINCT product FROM tokens)
, open0 AS MATERIALIZED (SELECT k, product FROM tokens)
, pick0 AS (SELECT CAST(NULL AS VARCHAR) AS product)
, picked0 AS (SELECT product FROM pick0 WHERE false)"""
    ]
    for step in range(1, steps + 1):
        last = step - 1
        parts.append(
            f"""
, open{step} AS MATERIALIZED (
  SELECT * FROM open{last} ANTI JOIN (SELECT k FROM open{last} JOIN pick{last} USING (product)) USING (k))
, best{step} AS MATERIALIZED (
  SELECT {step} AS step, row_number() OVER (ORDER BY n DESC, product) AS rank, product, n AS count_key
  FROM (SELECT p.product, (SELECT count(DISTINCT k) FROM tokens) - (SELECT count(DISTINCT k) FROM open{step})
               + count(o.k) AS n
        FROM products p LEFT JOIN open{step} o USING (product)
        WHERE p.product NOT IN (SELECT product FROM picked{last}) GROUP BY p.product)
  QUALIFY rank <= {top_k})
, pick{step} AS MATERIALIZED (SELECT product FROM best{step} WHERE rank = 1)
, picked{step} AS MATERIALIZED (SELECT product FROM picked{last} UNION ALL SELECT product FROM pick{step})"""
        )
    return "".join(parts) + "\n" + " UNION ALL ".join(f"{select} FROM best{s}" for s in range(1, steps + 1))


_PICK = "SELECT CAST(step AS INTEGER) AS step, product, count_key"
_RANKED = "SELECT CAST(step AS INTEGER) AS step, CAST(rank AS INTEGER) AS rank, product, count_key"


def _product_tokens(key: str) -> str:
    found = f"SELECT DISTINCT {key} AS k, prod_code AS product FROM lines JOIN styled USING (prod_code)"
    return _with("lines", "styled", extra=f"tokens AS MATERIALIZED ({found})")


ORACLE_SQL["greedy_reach"] = _product_tokens("transaction_fid") + _greedy(p.REACH_STEPS, 1, _PICK)
ORACLE_SQL["greedy_candidates"] = _with("tokens") + _greedy(p.REACH_STEPS, p.TOP_K, _RANKED)
ORACLE_SQL["greedy_reach_cards"] = _product_tokens("card_id") + _greedy(p.REACH_STEPS, 1, _PICK)

# --- price --------------------------------------------------------------------------------------

ORACLE_SQL["price_points"] = (
    _with("points") + "SELECT date_id, round(units, 2) AS units, round(sales, 4) AS sales, ppu FROM points"
)

ORACLE_SQL["price_points_period"] = (
    _with("sold")
    + f"""
SELECT l20 AS prod_hier_l20_code, date_id, round(sum(units), 2) AS units,
       round(CAST(sum(net_spend_amt) AS DOUBLE), 4) AS sales,
       -- Halves are rounded up in decimals, as a price is.
       CAST(round(CAST(CAST(sum(net_spend_amt) AS DOUBLE) / sum(units) AS DECIMAL(18,6)), 2) AS DOUBLE) AS ppu
FROM sold WHERE l50 = '{p.DIVISIONS[0]}' AND fis_week_id BETWEEN {p.PRICE_WEEKS[0]} AND {p.PRICE_WEEKS[1]}
GROUP BY l20, date_id"""
)

_DESCRIBE = """
SELECT '{0}' AS "column", count({0}) AS count, avg({0}) AS mean, stddev_samp({0}) AS std, min({0}) AS min,
       quantile_cont({0}, 0.25) AS q25, quantile_cont({0}, 0.5) AS q50, quantile_cont({0}, 0.75) AS q75,
       max({0}) AS max FROM points"""

ORACLE_SQL["price_describe"] = (
    _with("points", extra="d AS (" + " UNION ALL ".join(_DESCRIBE.format(c) for c in ("units", "sales", "ppu")) + ")")
    + f"""SELECT "column", count, {_round(4, "mean", "std")}, {_round(6, "min", "q25", "q50", "q75", "max")} FROM d"""
)


def _histogram(source: str, column: str) -> str:
    return f"""
, b AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source})
SELECT CAST(CASE WHEN lo = hi THEN 1 ELSE least(floor(({column} - lo) / (hi - lo) * 20) + 1, 20) END AS INTEGER) AS bin,
       count(*) AS n
FROM {source}, b GROUP BY 1"""


ORACLE_SQL["price_histogram"] = _with("points") + _histogram("points", "ppu")

_LINEAR = """
, fits AS (
  SELECT {by} count(*) AS n, regr_intercept(units, ppu) AS coef_0, regr_slope(units, ppu) AS coef_1,
         (1 - regr_r2(units, ppu)) * var_pop(units) AS mse, regr_r2(units, ppu) AS r2,
         min(ppu) AS min_x, max(ppu) AS max_x
  FROM {source} {group})"""

ORACLE_SQL["price_linear"] = (
    _with("points")
    + _LINEAR.format(by="", source="points", group="")
    + f"""
SELECT n, {_round(4, "coef_0", "mse")}, {_round(6, "coef_1", "r2")}, {_round(2, "min_x", "max_x")} FROM fits"""
)


def _quadratic(source: str, by: str) -> str:
    """Normal equations in the centred price, by Cramer's rule."""
    keys = f"{by}," if by else ""
    match = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    own = "m.*" if by else "m.*"
    return f"""
, means AS (SELECT {keys} avg(ppu) AS mx, avg(units) AS my FROM {source} {group})
, u AS (SELECT s.*, mx, my, ppu - mx AS u, units - my AS v FROM {source} s JOIN means {match})
, m AS (SELECT {keys} count(*) AS n, any_value(mx) AS mx, any_value(my) AS my,
          avg(u * u) AS m2, avg(u * u * u) AS m3, avg(u * u * u * u) AS m4,
          avg(u * v) AS c1, avg(u * u * v) AS c2, min(ppu) AS min_x, max(ppu) AS max_x FROM u {group})
, solved AS (
  SELECT {own}, (c2 * m2 - c1 * m3) / nullif(m2 * (m4 - m2 * m2) - m3 * m3, 0) AS c FROM m)
, sloped AS (SELECT *, (c1 - c * m3) / m2 AS b FROM solved)
, coefs AS (
  SELECT *, my - c * m2 - b * mx + c * mx * mx AS coef_0, b - 2 * c * mx AS coef_1, c AS coef_2 FROM sloped)
, errors AS (
  SELECT {keys} avg((v - (b * u + c * (u * u - m2))) ** 2) AS mse, avg(v * v) AS vy
  FROM u JOIN (SELECT {keys} b, c, m2 FROM coefs) {match} {group})
"""


def _quadratic_fits(source: str, by: str) -> str:
    return (
        _quadratic(source, by)
        + f"""SELECT {f"{by} AS prod_hier_{by}_code," if by else ""} n, {_round(4, "coef_0", "mse")},
       {_round(6, "coef_1")}, {_round(8, "coef_2")},
       round(1 - mse / vy, 6) + 0.0 AS r2, {_round(2, "min_x", "max_x")}
FROM coefs JOIN errors {f"USING ({by})" if by else "ON true"}"""
    )


ORACLE_SQL["price_quadratic"] = _with("points") + _quadratic_fits("points", "")
ORACLE_SQL["price_by_group"] = _with("group_points") + _quadratic_fits("group_points", "l10")
ORACLE_SQL["price_curve"] = (
    _with(
        "group_points",
        extra=f"scaled AS MATERIALIZED (SELECT * REPLACE (round(ppu / {p.CURVE_PRICE_UNIT}, 2) AS ppu) FROM group_points)",
    )
    + _quadratic("scaled", "l10")
    + f"""
, grid AS (
  SELECT *, round(min_x + i * {p.PRICE_STEP}, 6) AS ppu
  FROM (SELECT *, unnest(range(CAST(ceil(round((max_x - min_x) / {p.PRICE_STEP}, 6)) AS BIGINT))) AS i FROM coefs))
SELECT l10 AS prod_hier_l10_code, round(ppu, 2) + 0.0 AS ppu,
       round(coef_0 + coef_1 * ppu + coef_2 * ppu * ppu, 1) + 0.0 AS predicted
FROM grid"""
)


def _stats(source: str, by: str) -> str:
    """Linear fit summary from sums over the residuals."""
    keys = f"{by}," if by else ""
    match = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    four = _round(
        4, "coef_0", "coef_1", "std_err_0", "std_err_1", "t_0", "t_1", "mse", "f_value", "log_likelihood",
        "aic", "bic", "jarque_bera", "omnibus",
    )
    six = _round(6, "r2", "adj_r2", "durbin_watson", "skew", "kurtosis", "prob_jb", "prob_omnibus")
    return f"""
, fits AS (
  SELECT {keys} count(*) AS n, regr_intercept(units, ppu) AS coef_0, regr_slope(units, ppu) AS coef_1,
         regr_r2(units, ppu) AS r2, avg(ppu) AS mx, var_pop(ppu) AS m2, sum(ppu * ppu) AS sxx, sum(ppu) AS sx
  FROM {source} {group})
, res AS (SELECT p.*, f.* EXCLUDE ({by or "n"}), units - coef_0 - coef_1 * ppu AS e
          FROM {source} p JOIN fits f {match})
, steps AS (SELECT *, e - lag(e) OVER ({part} ORDER BY date_id) AS d FROM res)
, sums AS (
  SELECT {keys} avg(e * e) AS mse, sum(d * d) / sum(e * e) AS durbin_watson,
         avg(e * e * e) / avg(e * e) ** 1.5 AS skew, avg(e * e * e * e) / avg(e * e) ** 2 AS kurtosis
  FROM steps {group})
, base AS (
  SELECT *, n - 2 AS dof, mse * n / (n - 2) AS s2, CAST(n AS DOUBLE) AS m,
         -n / 2 * (ln(2 * pi() * mse) + 1) AS log_likelihood,
         n / 6 * (skew * skew + (kurtosis - 3) ** 2 / 4) AS jarque_bera,
         n + sxx AS tr, n * sxx - sx * sx AS det
  FROM fits JOIN sums {match})
, errs AS (
  SELECT *, sqrt(s2 * (1 / m + mx * mx / (m * m2))) AS std_err_0, sqrt(s2 / (m * m2)) AS std_err_1,
         sqrt((tr + sqrt(tr * tr - 4 * det)) / 2 / (det / ((tr + sqrt(tr * tr - 4 * det)) / 2))) AS cond_no,
         3 * (m*m + 27*m - 70) * (m+1) * (m+3) / ((m-2) * (m+5) * (m+7) * (m+9)) AS sb,
         skew * sqrt((m+1) * (m+3) / (6 * (m-2))) AS sy,
         (kurtosis - 3 * (m-1) / (m+1))
           / sqrt(24*m * (m-2) * (m-3) / ((m+1) * (m+1) * (m+3) * (m+5))) AS kx,
         6 * (m*m - 5*m + 2) / ((m+7) * (m+9)) * sqrt(6 * (m+3) * (m+5) / (m * (m-2) * (m-3))) AS kb
  FROM base)
, zs AS (
  SELECT *, sqrt(2 * (sb - 1)) - 1 AS w2, 6 + 8 / kb * (2 / kb + sqrt(1 + 4 / (kb * kb))) AS ka FROM errs)
, zz AS (
  SELECT *, ln(sy / sqrt(2 / (w2 - 1)) + sqrt(sy * sy / (2 / (w2 - 1)) + 1)) / sqrt(0.5 * ln(w2)) AS z1,
         ((1 - 2 / (9 * ka)) - sign(1 + kx * sqrt(2 / (ka - 4)))
             * cbrt((1 - 2 / ka) / abs(1 + kx * sqrt(2 / (ka - 4))))) / sqrt(2 / (9 * ka)) AS z2
  FROM zs)
, done AS (
  SELECT *, coef_0 / std_err_0 AS t_0, coef_1 / std_err_1 AS t_1, r2 / ((1 - r2) / dof) AS f_value,
         1 - (1 - r2) * (n - 1) / dof AS adj_r2, 4 - 2 * log_likelihood AS aic,
         2 * ln(n) - 2 * log_likelihood AS bic, exp(-jarque_bera / 2) AS prob_jb,
         z1 * z1 + z2 * z2 AS omnibus, exp(-(z1 * z1 + z2 * z2) / 2) AS prob_omnibus
  FROM zz)
SELECT {f"{by} AS prod_hier_{by}_code," if by else ""} n, dof, {four}, {six},
       {_round(2, "cond_no")} FROM done"""


ORACLE_SQL["price_stats"] = _with("points") + _stats("points", "")
ORACLE_SQL["price_stats_by_group"] = _with("group_points") + _stats("group_points", "l10")


def _quadratic_errors(source: str, by: str) -> str:
    """Residual sums and standard errors of the quadratic fit, from the inverse of the normal matrix.

    Centred terms 1, u, u^2 turn into 1, x, x^2 by (1, -m, m^2), (0, 1, -2m), (0, 0, 1).
    """
    return (
        _quadratic(source, by)
        + f"""
, res AS (SELECT u.{by}, date_id, ppu, c.n, v - (b * u + c * (u * u - m2)) AS e FROM u JOIN coefs c USING ({by}))
, steps AS (SELECT *, e - lag(e) OVER (PARTITION BY {by} ORDER BY date_id) AS d FROM res)
, sums AS (
  SELECT {by}, sum(d * d) / sum(e * e) AS durbin_watson, avg(e * e * e) / avg(e * e) ** 1.5 AS skew,
         avg(e * e * e * e) / avg(e * e) ** 2 AS kurtosis, CAST(any_value(n) AS DOUBLE) AS m,
         sum(ppu) AS s1, sum(ppu ** 2) AS s2, sum(ppu ** 3) AS s3, sum(ppu ** 4) AS s4
  FROM steps GROUP BY {by})
, inverse AS (
  SELECT *, 1 - mse / vy AS r2, mse * n / (n - 3) AS noise, n * (m2 * m4 - m3 * m3 - m2 * m2 * m2) AS det,
         m2 * m4 - m3 * m3 AS g00, m2 * m3 AS g01, -m2 * m2 AS g02, m4 - m2 * m2 AS g11, -m3 AS g12, m2 AS g22
  FROM coefs JOIN errors USING ({by}) JOIN sums USING ({by}))
, errs AS (
  SELECT *, n - 3 AS dof,
         sqrt(noise / det * (g00 + mx ** 2 * g11 + mx ** 4 * g22 - 2 * mx * g01 + 2 * mx ** 2 * g02 - 2 * mx ** 3 * g12))
           AS std_err_0,
         sqrt(noise / det * (g11 + 4 * mx ** 2 * g22 - 4 * mx * g12)) AS std_err_1,
         sqrt(noise / det * g22) AS std_err_2
  FROM inverse)
"""
    )


# Largest eigenvalues of the normal matrix and of its inverse, by steps of the power method.
_CONDITION = """
, forward AS (
  SELECT l10, 0 AS k, 1e0 AS x0, 1e0 AS x1, 1e0 AS x2, 0e0 AS top FROM errs
  UNION ALL
  SELECT f.l10, k + 1, y0 / s, y1 / s, y2 / s, s
  FROM (SELECT f.l10, k, m * x0 + s1 * x1 + s2 * x2 AS y0, s1 * x0 + s2 * x1 + s3 * x2 AS y1,
               s2 * x0 + s3 * x1 + s4 * x2 AS y2,
               sqrt((m * x0 + s1 * x1 + s2 * x2) ** 2 + (s1 * x0 + s2 * x1 + s3 * x2) ** 2
                    + (s2 * x0 + s3 * x1 + s4 * x2) ** 2) AS s
        FROM forward f JOIN errs USING (l10) WHERE k < 60) f)
, turned AS (
  SELECT l10, (g00 + mx ** 2 * g11 + mx ** 4 * g22 - 2 * mx * g01 + 2 * mx ** 2 * g02 - 2 * mx ** 3 * g12) / det AS h00,
         (g01 - mx * g11 - 2 * mx * g02 + 3 * mx ** 2 * g12 - 2 * mx ** 3 * g22) / det AS h01,
         (g02 - mx * g12 + mx ** 2 * g22) / det AS h02,
         (g11 + 4 * mx ** 2 * g22 - 4 * mx * g12) / det AS h11, (g12 - 2 * mx * g22) / det AS h12, g22 / det AS h22
  FROM errs)
, inward AS (
  SELECT l10, 0 AS k, 1e0 AS x0, 1e0 AS x1, 1e0 AS x2, 0e0 AS top FROM errs
  UNION ALL
  SELECT f.l10, k + 1, y0 / s, y1 / s, y2 / s, s
  FROM (SELECT f.l10, k, h00 * x0 + h01 * x1 + h02 * x2 AS y0, h01 * x0 + h11 * x1 + h12 * x2 AS y1,
               h02 * x0 + h12 * x1 + h22 * x2 AS y2,
               sqrt((h00 * x0 + h01 * x1 + h02 * x2) ** 2 + (h01 * x0 + h11 * x1 + h12 * x2) ** 2
                    + (h02 * x0 + h12 * x1 + h22 * x2) ** 2) AS s
        FROM inward f JOIN turned USING (l10) WHERE k < 60) f)
, condition AS (
  SELECT l10, sqrt(f.top * i.top) AS cond_no
  FROM (SELECT l10, top FROM forward WHERE k = 60) f JOIN (SELECT l10, top FROM inward WHERE k = 60) i USING (l10))
"""
_NORMALITY = """
, base AS (
  SELECT *, n / 6 * (skew * skew + (kurtosis - 3) ** 2 / 4) AS jarque_bera,
         -n / 2 * (ln(2 * pi() * mse) + 1) AS log_likelihood,
         3 * (m*m + 27*m - 70) * (m+1) * (m+3) / ((m-2) * (m+5) * (m+7) * (m+9)) AS sb,
         skew * sqrt((m+1) * (m+3) / (6 * (m-2))) AS sy,
         (kurtosis - 3 * (m-1) / (m+1)) / sqrt(24*m * (m-2) * (m-3) / ((m+1) * (m+1) * (m+3) * (m+5))) AS kx,
         6 * (m*m - 5*m + 2) / ((m+7) * (m+9)) * sqrt(6 * (m+3) * (m+5) / (m * (m-2) * (m-3))) AS kb
  FROM errs)
, zs AS (
  SELECT *, sqrt(2 * (sb - 1)) - 1 AS w2, 6 + 8 / kb * (2 / kb + sqrt(1 + 4 / (kb * kb))) AS ka FROM base)
, zz AS (
  SELECT *, ln(sy / sqrt(2 / (w2 - 1)) + sqrt(sy * sy / (2 / (w2 - 1)) + 1)) / sqrt(0.5 * ln(w2)) AS z1,
         ((1 - 2 / (9 * ka)) - sign(1 + kx * sqrt(2 / (ka - 4)))
             * cbrt((1 - 2 / ka) / abs(1 + kx * sqrt(2 / (ka - 4))))) / sqrt(2 / (9 * ka)) AS z2
  FROM zs)
, done AS (
  SELECT *, coef_0 / std_err_0 AS t_0, coef_1 / std_err_1 AS t_1, coef_2 / std_err_2 AS t_2,
         r2 / 2 / ((1 - r2) / dof) AS f_value, 1 - (1 - r2) * (n - 1) / dof AS adj_r2, 6 - 2 * log_likelihood AS aic,
         3 * ln(n) - 2 * log_likelihood AS bic, exp(-jarque_bera / 2) AS prob_jb,
         z1 * z1 + z2 * z2 AS omnibus, exp(-(z1 * z1 + z2 * z2) / 2) AS prob_omnibus
  FROM zz)
"""
_RECURSIVE = _with("group_points").replace("WITH ", "WITH RECURSIVE ", 1)
_FOUR = [f"{part}_{i}" for part in ("coef", "std_err", "t") for i in range(3)]
_FOUR += ["mse", "f_value", "log_likelihood", "aic", "bic", "jarque_bera", "omnibus"]
_SIX = ["r2", "adj_r2", "durbin_watson", "skew", "kurtosis", "prob_jb", "prob_omnibus"]
ORACLE_SQL["price_stats_quadratic"] = (
    _RECURSIVE
    + _quadratic_errors("group_points", "l10")
    + _CONDITION
    + _NORMALITY
    + f"""SELECT l10 AS prod_hier_l10_code, n, dof, {_round(4, *_FOUR)}, {_round(6, *_SIX)}, {_round(-3, "cond_no")}
FROM done JOIN condition USING (l10)"""
)


def _t_tail(t: str) -> str:
    """P(|T| > |t|) at ``dof``, by the same sum with each term from gamma functions."""
    angle = f"atan(abs({t}) / sqrt(dof))"
    even = f"list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5) + 2 * k * ln(cos({angle}))) FOR k IN range(dof // 2)])"
    odd = f"""list_sum([exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + 2 * k * ln(cos({angle})))
                       FOR k IN range((dof - 1) // 2)])"""
    return f"""(1 - CASE WHEN dof % 2 = 0 THEN sin({angle}) * {even}
                    ELSE 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {odd}) END)"""


ORACLE_SQL["price_coefficient_tests"] = (
    _RECURSIVE
    + _quadratic_errors("group_points", "l10")
    + f"""
, fitted AS (SELECT *, r2 / 2 / ((1 - r2) / dof) AS f_value FROM errs)
, margin AS (
  SELECT dof, 0 AS k, 0e0 AS low, 100e0 AS high FROM (SELECT DISTINCT dof FROM fitted)
  UNION ALL
  SELECT dof, k + 1, CASE WHEN tail > 0.05 THEN mid ELSE low END, CASE WHEN tail > 0.05 THEN high ELSE mid END
  FROM (SELECT dof, k, low, high, (low + high) / 2 AS mid, {_t_tail("((low + high) / 2)")} AS tail FROM margin WHERE k < 60))
, term AS (
  SELECT l10, dof, f_value, unnest([0, 1, 2]) AS term, unnest([coef_0, coef_1, coef_2]) AS coef,
         unnest([std_err_0, std_err_1, std_err_2]) AS std_err FROM fitted)
, tested AS (
  SELECT *, coef / std_err AS t, pow(1 + 2 * f_value / dof, -dof / 2) AS prob_f
  FROM term JOIN (SELECT dof, (low + high) / 2 AS width FROM margin WHERE k = 60) USING (dof))
SELECT l10 AS prod_hier_l10_code, CAST(term AS INTEGER) AS term, {_round(4, "coef", "std_err", "t")},
       round({_t_tail("t")}, 6) + 0.0 AS p_value, round(coef - width * std_err, 3) + 0.0 AS low,
       round(coef + width * std_err, 3) + 0.0 AS high, {_round(6, "prob_f")}
FROM tested"""
)

# --- seasonality --------------------------------------------------------------------------------


def _kpi(level: str, first: int, last: int, n_weeks: int) -> str:
    return f"""
, kpi AS (
  SELECT {level}, fis_week_id, sum(CASE WHEN weight_uom_qty > 0 THEN weight_uom_qty ELSE item_qty END) AS units,
         CAST(sum(net_spend_amt) AS DOUBLE) AS sales
  FROM scoped WHERE net_spend_amt > 0 AND fis_week_id BETWEEN {first} AND {last}
  GROUP BY {level}, fis_week_id
  QUALIFY count(*) OVER (PARTITION BY {level}) >= {n_weeks})"""


# Weeks 199640 - 26 and 199739 + 25 + 1 (1996 and 1997 have 52 weeks).
_SEASON = (199614, 199813, 104)


def _index(level: str, before: int, after: int) -> str:
    frame = f"OVER (PARTITION BY {level} ORDER BY fis_week_id ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"""
, ranked AS (
  SELECT *, units / avg(units) {frame} AS idx_units, sales / avg(sales) {frame} AS idx_sales,
         row_number() OVER (PARTITION BY {level} ORDER BY fis_week_id) AS rank,
         count(*) OVER (PARTITION BY {level}) AS n_rank
  FROM kpi)
, idx AS (
  SELECT {level}, substring(CAST(fis_week_id AS VARCHAR), 5, 2) AS period_no,
         round(median(idx_units), 2) AS med_idx_units, round(median(idx_sales), 2) AS med_idx_sales
  FROM ranked WHERE rank > {before} AND rank <= n_rank - {after} GROUP BY 1, 2)"""


ORACLE_SQL["weekly_kpi"] = (
    _with("scoped")
    + _kpi("l10", *_SEASON)
    + "SELECT l10 AS prod_hier_l10_code, fis_week_id, round(units, 2) AS units, round(sales, 4) AS sales FROM kpi"
)

ORACLE_SQL["seasonality_index"] = (
    _with("scoped")
    + _kpi("l20", *_SEASON)
    + _index("l20", 26, 25)
    + "SELECT l20 AS prod_hier_l20_code, period_no, med_idx_units, med_idx_sales FROM idx"
)

# The 104 weeks to 199852: 52 weeks each in 1997 and 1998.
ORACLE_SQL["seasonality_short"] = (
    _with("scoped")
    + _kpi("l50", 199701, p.SHORT_SEASON["data_week_end"], 104)
    + _index("l50", 2, 1)
    + f"""SELECT l50 AS prod_hier_l50_code, period_no, med_idx_units FROM idx
WHERE period_no BETWEEN '{str(p.SHORT_SEASON["start_week"])[4:]}' AND '{str(p.SHORT_SEASON["end_week"])[4:]}'"""
)

# --- shopping cycle -----------------------------------------------------------------------------

ORACLE_SQL["shopping_cycle"] = _with("cycles") + "SELECT card_id, median_day_cycle FROM cycles"

ORACLE_SQL["shopping_cycle_overall"] = (
    _with("item")
    + """
SELECT median(c) AS overall_cycle, count(*) AS n_card FROM (
  SELECT card_id, median(gap) AS c FROM (
    SELECT card_id, lead(date_id) OVER (PARTITION BY card_id ORDER BY date_id) - date_id AS gap
    FROM (SELECT DISTINCT card_id, date_id FROM item WHERE card_id IS NOT NULL))
  WHERE gap IS NOT NULL GROUP BY card_id)"""
)

ORACLE_SQL["cycle_histogram"] = _with("cycles") + _histogram("cycles", "median_day_cycle")

ORACLE_SQL["cycle_cumulative"] = (
    _with("cycles")
    + """
SELECT median_day_cycle, count(*) AS n_card,
       CAST(sum(count(*)) OVER (ORDER BY median_day_cycle) AS BIGINT) AS accu_n_card
FROM cycles GROUP BY median_day_cycle"""
)

# --- need states --------------------------------------------------------------------------------

ORACLE_SQL["card_metrics"] = _with("cardm") + "SELECT card_id, visits, CAST(sales AS DOUBLE) AS sales FROM cardm"

ORACLE_SQL["card_subclass_metrics"] = (
    _with("subm")
    + """SELECT card_id, l10 AS prod_hier_l10_code, subcl_visits, CAST(subcl_sales AS DOUBLE) AS subcl_sales
FROM subm"""
)

ORACLE_SQL["need_state"] = (
    _with("need") + f"SELECT card_id, subcl, {_round(6, 'pct_visits', 'pct_sales')} FROM need"
)

# The 25 subclasses of the test tables.
_FEATURES = [f"sBrand#{n}" for n in range(1, 26)]
_CELLS = ", ".join(
    f"""round(coalesce(max(pct_visits) FILTER (subcl = '{f}'), 0), 6) + 0.0 AS "{f}" """ for f in _FEATURES
)

ORACLE_SQL["need_matrix"] = _with("need") + f"SELECT card_id, {_CELLS} FROM need GROUP BY card_id"

ORACLE_SQL["feature_correlation"] = _with("corr_long") + f"SELECT i, j, {_round(6, 'r')} FROM corr_long"

ORACLE_SQL["segment_correlation"] = (
    _with("grid", "seg")
    + """
SELECT seg_value_code, a.feature AS i, b.feature AS j,
       round(CASE WHEN a.feature = b.feature THEN 1.0 ELSE corr(a.x, b.x) END, 6) + 0.0 AS r
FROM grid a JOIN grid b USING (card_id) JOIN seg USING (card_id) GROUP BY seg_value_code, a.feature, b.feature"""
)

ORACLE_SQL["feature_covariance"] = (
    _with("grid")
    + """
SELECT a.feature AS i, b.feature AS j, round(covar_samp(a.x, b.x), 8) + 0.0 AS cov
FROM grid a JOIN grid b USING (card_id) GROUP BY a.feature, b.feature"""
)

ORACLE_SQL["scatter"] = (
    _with("grid")
    + """
SELECT a.feature AS i, b.feature AS j, round(covar_pop(a.x, b.x) * count(*), 6) + 0.0 AS s
FROM grid a JOIN grid b USING (card_id) GROUP BY a.feature, b.feature"""
)

ORACLE_SQL["feature_stats"] = (
    _with("grid")
    + """
SELECT feature, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS std
FROM grid GROUP BY feature"""
)

# --- variable clusters --------------------------------------------------------------------------


def _near(assignment: str, name: str) -> str:
    """Centroid correlations of all features with the clusters of an assignment."""
    return f"""
, var_{name} AS MATERIALIZED (
  SELECT a.cluster, sum(r) AS total, count(DISTINCT a.feature) AS size
  FROM corr_long JOIN {assignment} a ON i = a.feature JOIN {assignment} b ON j = b.feature AND b.cluster = a.cluster
  GROUP BY a.cluster)
, near_{name} AS MATERIALIZED (
  SELECT i AS feature, a.cluster, sum(r) / sqrt(any_value(total)) AS r, any_value(total / size) AS variance
  FROM corr_long JOIN {assignment} a ON j = a.feature JOIN var_{name} v ON v.cluster = a.cluster
  GROUP BY i, a.cluster)"""


_INT_CLUSTER = "CAST(cluster AS INTEGER) AS cluster"

ORACLE_SQL["cluster_correlation"] = (
    _with("corr_long", "start")
    + _near("start", "a")
    + f"SELECT feature, {_INT_CLUSTER}, {_round(6, 'r', 'variance')} FROM near_a"
)

_ROUNDS = ""
_last = "start"
for _name in "abc":
    _ROUNDS += _near(_last, _name) + f"""
, next_{_name} AS MATERIALIZED (
  SELECT feature, cluster FROM near_{_name}
  QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(r * r, 12) DESC, cluster) = 1)"""
    _last = f"next_{_name}"

ORACLE_SQL["cluster_reassign"] = (
    _with("corr_long", "start")
    + _ROUNDS
    + f"""
SELECT feature, {_INT_CLUSTER},
       (SELECT bool_and(c.cluster = b.cluster) FROM next_c c JOIN next_b b USING (feature)) AS stable FROM {_last}"""
)

ORACLE_SQL["cluster_r2_ratio"] = (
    _with("corr_long", "start")
    + _near("start", "a")
    + f"""
, split AS (
  SELECT feature, s.cluster, max(r * r) FILTER (n.cluster = s.cluster) AS r2_own,
         max(r * r) FILTER (n.cluster <> s.cluster) AS r2_next
  FROM near_a n JOIN start s USING (feature) GROUP BY feature, s.cluster)
SELECT feature, {_INT_CLUSTER}, {_round(6, "r2_own", "r2_next")},
       round((1 - r2_own) / (1 - r2_next), 6) + 0.0 AS ratio
FROM split"""
)

ORACLE_SQL["table_roundtrip"] = _with("prod") + "SELECT l10 AS prod_hier_l10_code, count(*) AS n_products, true AS listed FROM prod GROUP BY l10"

# Score of a customer on a cluster needs the cluster search, so only its inputs are in SQL.

ORACLE_SQL["sink_roundtrip"] = (
    _with("need", "prod")
    + f"""
SELECT subcl, n_cards, round(avg_visits, 6) + 0.0 AS avg_visits, n_products, first_code
FROM (SELECT subcl, count(*) AS n_cards, avg(pct_visits) AS avg_visits FROM need GROUP BY subcl)
JOIN (SELECT 's' || l10 AS subcl, count(*) AS n_products, min(prod_code) AS first_code
      FROM prod WHERE l50 IN ('{p.DIVISIONS[0]}') GROUP BY l10) USING (subcl)"""
)


def _run(name: str) -> str:
    weeks = p.PERIODS[name]
    return f"""SELECT store_id, count(*) AS n_lines, '{name}' AS run FROM item
               WHERE fis_week_id BETWEEN {weeks[0]} AND {weeks[1]} GROUP BY store_id"""


ORACLE_SQL["growing_report"] = _with("item") + f"{_run('TY')} UNION ALL {_run('LY')}"

ORACLE_SQL["item_slice_by_week"] = (
    _with("item", "store")
    + f"""
SELECT transaction_fid, prod_code, store_id, fis_week_id, item_qty FROM item
WHERE fis_week_id BETWEEN {p.SLICE_WEEKS[0]} AND {p.SLICE_WEEKS[1]}
  AND store_id IN (SELECT store_id FROM store WHERE format_code IN {p.SLICE_FORMATS})"""
)

ORACLE_SQL["shopping_cycle_bucketed"] = (
    _with("item")
    + """
SELECT card_id, median(gap) AS median_day_cycle FROM (
  SELECT card_id, lead(date_id) OVER (PARTITION BY card_id ORDER BY date_id) - date_id AS gap
  FROM (SELECT DISTINCT card_id, date_id FROM item WHERE card_id IS NOT NULL))
WHERE gap IS NOT NULL GROUP BY card_id"""
)

# Weeks from Sunday to Saturday; the snapshots are those of the other queries, a day earlier.
ORACLE_SQL["segment_cards_by_dates"] = (
    _with("item", "snap")
    + f"""
, last AS (
  SELECT max(date_id) AS day FROM item
  WHERE floor((date_id - DATE '{p.OWN_WEEKS_FROM}') / 7) = {p.OWN_SNAPSHOT_WEEK})
SELECT c_custkey AS card_id FROM customer
WHERE c_custkey + 1000000000 IN (
  SELECT prsn_id FROM snap, last WHERE date_id - 1 = day AND seg_value IN (0, 1))"""
)
