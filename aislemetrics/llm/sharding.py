"""Placement of documents by a permutation-filled lookup table, in DataFrame operations only.

Every shard's name gives a start and a step, and these an order of preference over all slots of a table of prime size.  The
shards take turns, each claiming the free slot it likes best, until no slot is free; each then holds as many slots as any
other, give or take one, and a shard that comes or goes moves few others' slots.  The table (``size`` rows, a documented
bound) is broadcast, and a document's place is the entry of its key's hash.

Defined cases: a null key is placed like an empty one, so rows without a key share a slot; equal keys share a slot; the names
are taken once each, nulls left out, and none at all is refused; an empty table gives an empty result.  Columns other than
the key are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.session import materialise

# Slots; a prime, at least a hundred times the number of shards for shares within one per cent.
SIZE = 4_099
MOST_SIZE = 65_537
# Tasks among which the rows of one slot may be dealt when shards are written.
SPREAD = 64


def text_hash(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _power(base: Column, exponent: int, modulus: int) -> Column:
    """base ** exponent % modulus, by squaring along the bits of the exponent."""
    bits = F.array(*(F.lit(bit == "1") for bit in f"{exponent:b}"))
    return F.aggregate(bits, F.lit(1).cast("long"), lambda acc, bit: acc * acc % modulus * F.when(bit, base).otherwise(1) % modulus)


def lookup_table(names: DataFrame, size: int = SIZE) -> DataFrame:
    """(slot, shard) of every slot 0 .. ``size`` - 1 for the shards in the column ``name``; ``size`` must be a prime."""
    if not 2 < size <= MOST_SIZE or any(size % n == 0 for n in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table's size must be a prime of at most {MOST_SIZE}")
    start = text_hash(F.concat(F.lit("start:"), F.col("name"))) % size
    step = text_hash(F.concat(F.lit("step:"), F.col("name"))) % (size - 1) + 1
    # A slot's place in a shard's order is (slot - start) / step modulo the size, so the step's inverse is kept.
    shard = F.struct("name", start.alias("start"), _power(step, size - 2, size).alias("inverse"))
    shards = names.select("name").where("name is not null").distinct().agg(F.array_sort(F.collect_set(shard)).alias("shards"))
    shards = shards.where(F.size("shards").between(1, size))

    def claim(state: Column, turn: Column) -> Column:
        owner = F.element_at("shards", (turn % F.size("shards") + 1).cast("int"))
        rank = F.transform(
            state["free"], lambda slot: (slot - owner["start"] + size) % size * owner["inverse"] % size * size + slot
        )
        best = F.array(F.array_min(rank) % size)  # places are distinct, so the slot rides along
        return F.element_at(
            F.transform(
                best,
                lambda slot: F.struct(
                    F.filter(state["free"], lambda other: other != slot).alias("free"),
                    F.concat(state["taken"], F.array(F.struct(slot.alias("slot"), owner["name"].alias("shard")))).alias("taken"),
                ),
            ),
            1,
        )

    slots = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    nothing = F.array().cast("array<struct<slot: bigint, shard: string>>")
    filled = F.aggregate(slots, F.struct(slots.alias("free"), nothing.alias("taken")), claim, lambda state: state["taken"])
    return shards.select(F.inline(filled))


def place(docs: DataFrame, table: DataFrame, size: int = SIZE, key: str = "doc_id") -> DataFrame:
    """(``key``, slot, shard) of every row of ``docs``; ``table`` comes from ``lookup_table`` and has ``size`` rows."""
    keyed = docs.select(key, (text_hash(F.col(key).cast("string")) % size).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key, "slot", "shard")


def shard_names(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(count).select(F.format_string("shard-%03d", "id").alias("name"))


def placed(docs: DataFrame, count: int, size: int = SIZE, key: str = "doc_id") -> DataFrame:
    """``place`` over ``count`` numbered shards; the table is filled once and kept in the shared folder."""
    return place(docs, materialise(lookup_table(shard_names(docs.sparkSession, count), size), "shard-table"), size, key)


def write_shards(docs: DataFrame, table: DataFrame, path: str, size: int = SIZE, key: str = "doc_id") -> None:
    """Write ``docs``, all columns, as one Parquet folder ``shard=...`` a shard.

    Rows are dealt by shard, slot and the part of ``docs`` that they come from, so that a shard is written by many tasks, and
    so is a slot that a null or often repeated key fills.
    """
    origin = F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("origin")
    slot = (text_hash(F.col(key).cast("string")) % size).alias("slot")
    packed = docs.select(slot, origin, F.struct(*docs.columns).alias("row")).join(F.broadcast(table), "slot")
    packed.repartition("shard", "slot", "origin").select("shard", "row").write.partitionBy("shard").parquet(path)
