"""Readers for the files and tables the analyses take as input.  Schemas are always explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetrics.functions.columns import split_codes
from aislemetrics.operators.overlap import ProductGroup


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] = ("prod_code",)) -> DataFrame:
    """CSV with header, every column text, so leading zeros stay."""
    return spark.read.csv(path, schema=text_schema(columns), header=True, enforceSchema=False)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def read_labelled_csv(spark: SparkSession, path: str, columns: Sequence[str], label: str = "label") -> DataFrame:
    """CSV whose first column is a row label (its header may be empty); the rest are numbers."""
    schema = T.StructType([T.StructField(label, T.StringType())] + [T.StructField(c, T.DoubleType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True)


CONTROL_SCHEMA = "fmt string, prod_code string, prod_gr string, date_id date, fis_day_of_week_num int"


def read_control_file(spark: SparkSession, path: str, schema: str = CONTROL_SCHEMA) -> DataFrame:
    """Group control file: one row per group, ``prod_code`` a comma list, format in lower case."""
    return read_csv(spark, path, schema).withColumn("fmt", F.lower("fmt"))


def control_products(control: DataFrame) -> DataFrame:
    """Control file with one row per product."""
    return control.withColumn("prod_code", F.explode(split_codes(F.col("prod_code"))))


def control_groups(control: DataFrame) -> list[ProductGroup]:
    """The control file as plan parameters; it has one row per group of a report."""
    rows = control.select("fmt", "prod_code", "prod_gr", "date_id").collect()
    return [
        ProductGroup(r.prod_gr, r.prod_code.split(","), r.fmt, [r.date_id] if r.date_id else []) for r in rows
    ]


def read_style_list(spark: SparkSession, path: str, column: str = "prod_style_code") -> DataFrame:
    """Distinct style codes from a CSV or parquet list (Spark has no spreadsheet source)."""
    if path.endswith(".csv"):
        listed = read_csv(spark, path, f"{column} int")
    else:
        listed = spark.read.parquet(path)
    return listed.select(column).distinct()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def read_query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """SQL over the given frames; ``{name}`` in the text stands for a frame."""
    return spark.sql(sql, **views)


def read_database(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition: tuple[str, object, object, int] | None = None,
    **options: str,
) -> DataFrame:
    """JDBC table or query.

    ``partition`` is (column, low, high, parts); a whole table is then read by that many tasks.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if query is not None and partition is None:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table or f"({query}) q")
    if partition is not None:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("numPartitions", parts)
        reader = reader.option("lowerBound", str(low)).option("upperBound", str(high))
    return reader.load()


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
