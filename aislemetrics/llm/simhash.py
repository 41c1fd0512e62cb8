"""Near-duplicates by 64-bit fingerprints and pigeonhole blocks.

A fingerprint has four blocks of 16 bits.  Two fingerprints that differ in at most two bits agree in at least two blocks,
so they meet in one of the six joins on a pair of blocks, where the exact distance is then tested.  Equal fingerprints are
one row before any join.  Where very many fingerprints share a pair of blocks, the bucket is divided further, and exactly:
each fingerprint takes its own value and those one bit away as keys; two fingerprints at distance one or two share a key,
at most 33 fingerprints of a bucket share any key, and all that do are linked to the least of them.

Defined cases: a text without words, null or empty, has fingerprint zero and is linked like any other; repeated rows come
back as often as they stand; a null ``doc_id`` has a fingerprint and takes the component of its group, null if no document
of the group has an id; an empty table gives an empty result.  Columns other than the named ones are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.llm.common import map_rows, stored
from aislemetrics.llm.components import component_roots
from aislemetrics.session import materialise

SHINGLE, DISTANCE, SEED = 3, 2, 42
BLOCKS, BLOCK_BITS = 4, 16
# Fingerprints in one bucket beyond which the bucket is divided; changes the plan, not the result.
DIVIDE = 64
# Shingles hashed together; bounds the memory of one long text.
_RUN = 50_000


def fingerprint(data: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of the XXH64 of all shingles of ``size`` words; zero for a text without words."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    total = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _RUN):
        part = words[at : at + _RUN + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size))))
        hashes = np.array([xxh64_intdigest(shingle, seed) for shingle in shingles], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, sig, fp) of every row, both long: sig is a hash of the whole text, fp the fingerprint."""

    def start():
        return lambda texts: [[fingerprint((text or "").encode(), size) for text in texts]]

    source = docs.select("doc_id", F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    return map_rows(source, "fp long", ["text"], start, ("doc_id", "sig"))


def _kept_bits(pair: tuple[int, ...]) -> int:
    mask = sum(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * block) for block in pair)
    return mask - (1 << 64) if mask >> 63 else mask


# The bits of each pair of blocks.
_MASKS = [_kept_bits(pair) for pair in combinations(range(BLOCKS), BLOCKS - DISTANCE)]


def _flips(mask: int) -> Column:
    """The fingerprint itself and with each one of the bits outside ``mask`` turned."""
    rest = [1 << bit if bit < 63 else -(1 << 63) for bit in range(64) if not mask >> bit & 1]
    return F.array(*(F.col("fp").bitwiseXOR(F.lit(bit).cast("long")) for bit in [0, *rest]))


def close_links(distinct: DataFrame, divide: int = DIVIDE) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that join exactly those at ``DISTANCE`` bits or fewer.

    In a divided bucket a fingerprint is linked to the least one under each key, which leaves the components as they are.
    """
    parts = enumerate(_MASKS)
    cells = F.array(
        *(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in parts)
    )
    size = len(_MASKS) * distinct.count()
    rows = stored(distinct.select("fp", F.inline(cells)), "simhash-blocks", size)
    crowded = rows.groupBy("part", "key").count().where(F.col("count") > divide).select("part", "key")
    crowded = stored(crowded, "simhash-crowded", size)
    sparse = rows.join(crowded, ["part", "key"], "left_anti")
    a, b = (sparse.select("part", "key", F.col("fp").alias(x)) for x in "ab")
    links = a.join(b, ["part", "key"]).where("a < b and bit_count(a ^ b) <= " + str(DISTANCE)).select("a", "b")
    dense = rows.join(crowded, ["part", "key"], "left_semi")
    by_part = F.element_at(F.array(*map(_flips, _MASKS)), F.col("part") + 1)
    least = F.min("fp").over(Window.partitionBy("part", "flip"))
    spread = dense.select("part", "fp", F.explode(by_part).alias("flip")).select("fp", least.alias("a"))
    divided = spread.where("a < fp and bit_count(a ^ fp) <= " + str(DISTANCE)).select("a", F.col("fp").alias("b"))
    return links.unionByName(divided).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, divide: int = DIVIDE) -> DataFrame:
    """(doc_id, sig, fp, root, component_id) of every row.

    root names the group; component_id is the smallest doc_id reachable over links, the row's own included.
    """
    marked = materialise(fingerprints(docs, text_col, size), "simhash-fingerprints")
    size = marked.count()
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct", size)
    links = stored(close_links(distinct, divide), "simhash-links", len(_MASKS) * size)
    roots = stored(component_roots(links), "simhash-roots", size)
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(grouped.join(smallest, "root").select("fp", "root", "component_id"), "simhash-classes", size)
    return marked.join(classes, "fp").select("doc_id", "sig", "fp", "root", "component_id")


def first_of_each(docs: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row of ``docs``, with all its columns, for each group: that of the smallest doc_id.

    Of different texts with that doc_id the one of least hash stays, of equal rows one; rows without an id come last.
    The texts are shuffled once: the choice of rows and the dropping of equal ones are by the same plain keys.
    """
    groups = near_duplicates(docs, text_col, size)
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "sig")).alias("one"))
    chosen = stored(chosen.select("one.doc_id", "one.sig").distinct(), "simhash-chosen", docs.count())
    keys = {"late": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "sig": F.col("sig")}
    keys = [value.alias(name) for name, value in keys.items()]
    left = docs.select("doc_id", F.xxhash64(text_col).alias("sig"), F.struct(*docs.columns).alias("row")).select(*keys, "row")
    met = left.join(chosen.select(*keys), ["late", "id", "sig"], "left_semi")
    return met.dropDuplicates(["late", "id", "sig"]).select("row.*")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
