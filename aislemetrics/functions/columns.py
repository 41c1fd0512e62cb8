"""Column expressions shared by the analyses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_WIDTH = 9


def pad_code(code: Column, width: int = CODE_WIDTH) -> Column:
    """Left-pad with zeros; longer codes stay whole (a bare ``lpad`` would cut them)."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def all_padded(df: DataFrame, column: str = "prod_code", width: int = CODE_WIDTH) -> DataFrame:
    """One row: does every code of the column have the full width?"""
    return df.agg(F.bool_and(F.length(column) == width).alias("all_padded"))


def units(weight: str = "weight_uom_qty", quantity: str = "item_qty") -> Column:
    """Weight where it is positive, else the item count."""
    return F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.col(quantity))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0 (a bare ``/`` raises in ANSI mode)."""
    return F.try_divide(numerator, denominator)


def row_sum(columns: Sequence[Column], zero_fill: bool = False) -> Column:
    """Sum across columns; null if any part is null unless ``zero_fill``."""
    parts = [F.coalesce(c, F.lit(0)) for c in columns] if zero_fill else list(columns)
    return reduce(lambda a, b: a + b, parts)


def split_codes(codes: Column) -> Column:
    """Comma list to array, without trimming."""
    return F.split(codes, ",")


def feature_name(code: Column, prefix: str = "s") -> Column:
    return F.concat(F.lit(prefix), code)


def strip_prefix(name: Column, length: int = 1) -> Column:
    return F.substr(name, F.lit(length + 1))


def holds_any(tokens: str, products: Sequence) -> Column:
    """Does the array column hold at least one of the products?"""
    return F.arrays_overlap(F.col(tokens), F.array(*[F.lit(p) for p in products]))
