"""The retail star schema, as views over the driver's parquet tables (see FIXTURES.md)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetrics.functions import calendar
from aislemetrics.session import configure

DIVISIONS = ["01"]

_LONG, _INT, _DOUBLE, _TEXT, _TIME = (
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.StringType(),
    T.TimestampNTZType(),
)

SCHEMAS = {
    "lineitem": {
        "l_orderkey": _LONG,
        "l_partkey": _LONG,
        "l_suppkey": _LONG,
        "l_linenumber": _INT,
        "l_quantity": _DOUBLE,
        "l_extendedprice": _DOUBLE,
        "l_discount": _DOUBLE,
        "l_tax": _DOUBLE,
        "l_returnflag": _TEXT,
        "l_linestatus": _TEXT,
        "l_shipdate": _TIME,
    },
    "orders": {
        "o_orderkey": _LONG,
        "o_custkey": _LONG,
        "o_orderstatus": _TEXT,
        "o_totalprice": _DOUBLE,
        "o_orderdate": _TIME,
        "o_orderpriority": _TEXT,
    },
    "customer": {
        "c_custkey": _LONG,
        "c_name": _TEXT,
        "c_nationkey": _INT,
        "c_acctbal": _DOUBLE,
        "c_mktsegment": _TEXT,
    },
    "part": {
        "p_partkey": _LONG,
        "p_name": _TEXT,
        "p_brand": _TEXT,
        "p_type": _TEXT,
        "p_size": _INT,
        "p_retailprice": _DOUBLE,
    },
    "supplier": {"s_suppkey": _LONG, "s_name": _TEXT, "s_nationkey": _INT, "s_acctbal": _DOUBLE},
    "nation": {"n_nationkey": _INT, "n_name": _TEXT, "n_regionkey": _INT},
}


# Money is exact: decimals are multiplied, never doubles.
_SPEND = """cast(cast(l_extendedprice as decimal(12,2)) * (cast(1 as decimal(3,2)) - cast(l_discount as decimal(3,2)))
    * cast(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -1 ELSE 1 END as decimal(1,0)) as decimal(18,4))"""
_DIVISION = "CASE WHEN p_type IN ('PROMO', 'SMALL') THEN '99' ELSE '01' END"


def _padded(key: str) -> str:
    return f"CASE WHEN {key} < 100000000 THEN lpad(cast({key} as string), 9, '0') ELSE cast({key} as string) END"


@dataclass(frozen=True)
class Star:
    """Lazy fact and dimension frames over one folder of tables."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        schema = T.StructType([T.StructField(c, t) for c, t in SCHEMAS[name].items()])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        """Item-grain fact: one row per basket line, with the basket's header.

        What lies above the join is a plain column list: Spark then moves semi joins on products,
        stores or cards below it.
        """
        return self.lines.join(self.baskets, "transaction_fid")

    @cached_property
    def lines(self) -> DataFrame:
        """Basket lines without their headers."""
        return self._table("lineitem").selectExpr(
            "l_orderkey AS transaction_fid",
            f"{_padded('l_partkey')} AS prod_code",
            "l_suppkey AS store_id",
            "l_quantity AS item_qty",
            "CASE l_returnflag WHEN 'A' THEN l_quantity * 0.5D WHEN 'N' THEN 0D END AS weight_uom_qty",
            f"{_SPEND} AS net_spend_amt",
        )

    @cached_property
    def baskets(self) -> DataFrame:
        """Basket headers: card, date and week, one row per basket."""
        return self._table("orders").selectExpr(
            "o_orderkey AS transaction_fid",
            "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey END AS card_id",
            "cast(o_orderdate as date) AS date_id",
            "cast(extract(YEAROFWEEK FROM o_orderdate) * 100 + weekofyear(o_orderdate) as int) AS fis_week_id",
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._table("part").selectExpr(
            f"{_padded('p_partkey')} AS prod_code",
            "p_size AS prod_style_code",
            "p_name AS prod_alt_desc",
            "p_brand AS prod_hier_l10_code",
            "p_brand AS prod_hier_l10_desc",
            "p_type AS prod_hier_l20_code",
            "p_type AS prod_hier_l20_desc",
            f"{_DIVISION} AS prod_hier_l50_code",
            f"{_DIVISION} AS prod_comml_l30_code",
        )

    @cached_property
    def raw_product_codes(self) -> DataFrame:
        """Product keys as an unpadded file would hold them."""
        return self._table("part").selectExpr("cast(p_partkey as string) AS prod_code", "p_name")

    @cached_property
    def stores(self) -> DataFrame:
        suppliers, nations = self._table("supplier"), self._table("nation")
        return suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).selectExpr(
            "s_suppkey AS store_id", "s_name AS store_code", "cast(n_regionkey + 1 as string) AS format_code"
        )

    @cached_property
    def weeks(self) -> calendar.Weeks:
        return calendar.Weeks()

    @cached_property
    def segments(self) -> DataFrame:
        """Customer tags, one row per card."""
        return self._table("customer").selectExpr(
            "c_custkey AS card_id",
            "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Trader' WHEN 'FURNITURE' THEN NULL ELSE 'Shopper' END AS kptr_seg",
            "CASE c_mktsegment WHEN 'BUILDING' THEN 'LA' WHEN 'MACHINERY' THEN 'MM' ELSE 'UM' END AS seg_value_code",
        )

    @cached_property
    def card_persons(self) -> DataFrame:
        """(card_id, prsn_id): who holds a card."""
        return self._table("customer").selectExpr("c_custkey AS card_id", "c_custkey + 1000000000L AS prsn_id")

    @cached_property
    def segment_values(self) -> DataFrame:
        """(seg_value_id, seg_type_code, seg_value_code), with a second type under the same codes."""
        rows = [
            (10 * t + i, kind, value)
            for t, kind in enumerate((PRICE_SEGMENT, "loyalty"), 1)
            for i, value in enumerate(SEGMENT_CODES)
        ]
        return self.spark.createDataFrame(rows, "seg_value_id int, seg_type_code string, seg_value_code string")

    @cached_property
    def segment_snapshots(self) -> DataFrame:
        """(prsn_id, date_id, seg_value_id): two snapshots; in the earlier one everybody sits one segment on."""
        place = "CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END"
        late, early = SNAPSHOT_DATE.isoformat(), EARLIER_SNAPSHOT_DATE.isoformat()
        return self._table("customer").selectExpr(
            "c_custkey + 1000000000L AS prsn_id",
            f"stack(2, DATE '{late}', 10 + {place}, DATE '{early}', 10 + ({place} + 1) % 3) AS (date_id, seg_value_id)",
        )


PRICE_SEGMENT = "price_sense"
SEGMENT_CODES = ("LA", "MM", "UM")
# Sunday that ends the snapshot week, and the snapshot before.
SNAPSHOT_WEEK = 200120
SNAPSHOT_DATE = dt.date(2001, 5, 20)
EARLIER_SNAPSHOT_DATE = dt.date(2001, 5, 17)


def load_star(spark: SparkSession, folder: str) -> Star:
    return Star(configure(spark), folder.rstrip("/"))
