"""Best product list by reach: which products together touch the most baskets or customers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetrics.session import materialise, shared_path

KEYS = ("transaction_fid", "card_id")
# Candidates of a round: bits of a long.  Those that never have more than MOST_MASKS combinations.
MOST_CANDIDATES, SAFE_CANDIDATES = 62, 16
MOST_MASKS = 100_000
# Bounds held at a time.
BUFFER = 4_096
# The index has a folder for so many pairs of a set and a product.
PAIRS_PER_FOLDER, MAX_FOLDERS = 4_000_000, 1_024


def reach_pairs(items: DataFrame, products: DataFrame, key: str, level: str) -> DataFrame:
    """Distinct (key, product): the long form of the token sets."""
    if key not in KEYS:
        raise ValueError(f"key must be one of {KEYS}, not {key!r}")
    if key == "card_id":
        items = items.filter(F.col("card_id").isNotNull())
    if level != "prod_code":
        items = items.join(products.select("prod_code", level).distinct(), "prod_code")
    else:
        items = items.join(products.select("prod_code"), "prod_code", "left_semi")
    return items.select(key, F.col(level).alias("product")).distinct()


def token_sets(items: DataFrame, products: DataFrame, key: str, level: str) -> DataFrame:
    """(key, set_cat): the set of products per key, sorted.

    The distinct spreads a hot key over its products, so the list gathered per key is never
    longer than the product list.
    """
    pairs = reach_pairs(items, products, key, level)
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list("product")).alias("set_cat"))


def weighted_sets(tokens: DataFrame, merge: bool = True) -> DataFrame:
    """(set_cat, n): keys with equal sets are interchangeable, so they are counted once.

    At a fine level hardly any two sets are equal; ``merge`` off then saves the shuffle by set.
    """
    if not merge:
        return tokens.select("set_cat", F.lit(1).cast("long").alias("n"))
    return tokens.groupBy("set_cat").agg(F.count("*").alias("n"))


REPORT = T.StructType(
    [
        T.StructField("step", T.IntegerType(), False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("product", T.StringType(), False),
        T.StructField("count_key", T.LongType(), False),
    ]
)


class _Postings:
    """The inverted index: (set_id, product, n) of the open sets, in folders by a hash of the product.

    A round reads the folders of its candidates and of the picks since the index was written.
    """

    def __init__(self, postings: DataFrame, listed: DataFrame | None = None):
        spark = postings.sparkSession
        postings = materialise(postings, "reach-pairs")
        gains = postings.groupBy("product").agg(F.sum("n").alias("gain"), F.count("*").alias("pairs"))
        if listed is not None:  # a product whose sets are all covered stays, with nothing to gain
            gains = listed.join(gains, "product", "left").fillna(0)
        self.gains = materialise(gains, "reach-gains")
        total = self.gains.agg(F.sum("pairs")).first()[0] or 0
        self.folders = max(1, min(MAX_FOLDERS, total // PAIRS_PER_FOLDER))
        self.table = postings
        if self.folders > 1:
            path = shared_path(spark, "reach-postings")
            dealt = postings.withColumn("folder", self._folder(F.col("product"))).repartitionByRange("folder", "set_id")
            dealt.write.partitionBy("folder").parquet(path)
            self.table = spark.read.parquet(path)

    def _folder(self, product: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(product), F.lit(self.folders)).cast("int")

    def of(self, products: Sequence[str]) -> DataFrame:
        found = self.table.filter(F.col("product").isin(list(products)))
        if self.folders > 1:
            spark = found.sparkSession
            named = spark.createDataFrame([(p,) for p in products], "product string").select(self._folder(F.col("product")))
            found = found.filter(F.col("folder").isin(sorted({row[0] for row in named.collect()})))
        return found.select("set_id", "product", "n")

    def masks(self, candidates: Sequence[str], chosen: Sequence[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Which of ``candidates`` the sets without any of ``chosen`` hold, as bits, and how many keys hold just these.

        None where there are more than ``MOST_MASKS`` different ones; of 16 candidates there never are.
        """
        order = [*candidates, *chosen]
        place = F.least(F.array_position(F.array(*map(F.lit, order)), F.col("product")) - 1, F.lit(len(candidates)))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))
        held = self.of(order).groupBy("set_id").agg(F.bit_or(bit).alias("mask"), F.first("n").alias("n"))
        open_ = held.filter(F.col("mask") < 1 << len(candidates)).groupBy("mask").agg(F.sum("n").alias("n"))
        found = open_.limit(MOST_MASKS + 1).toPandas()
        if len(found) > MOST_MASKS:
            return None
        return found["mask"].to_numpy(np.int64), found["n"].to_numpy(np.int64)

    def without(self, chosen: Sequence[str]) -> _Postings:
        """The index of the sets that hold none of ``chosen``."""
        covered = self.of(chosen).select("set_id").distinct()
        left = self.table.select("set_id", "product", "n").join(covered, "set_id", "left_anti")
        return _Postings(left, self.gains.select("product"))


def greedy_candidates(tokens: DataFrame, n_top: int, top_k: int = 6, merge: bool = True) -> DataFrame:
    """(step, rank, product, count_key): per step the ``top_k`` candidates for the next pick.

    ``count_key`` counts the keys that hold the candidate or any product picked before it.  Rank 1
    is picked; ties go to the smaller code.  Picking stops when no product is left.

    A product's gain only falls as products are picked, so an old count is an upper bound.  A round
    counts anew, from their postings alone, the candidates with the highest bounds: their sets that
    are still open, by which of the candidates they hold.  From these counts picks follow, one after
    the other, for as long as the ``top_k`` best are above every bound outside the round.  Once half
    of the open keys are covered the index is written anew without them, so that all rewriting
    together costs no more than a few readings.  Per round at most ``MOST_MASKS`` pairs of numbers
    come to the driver, and ``BUFFER`` bounds each time the index is written.
    """
    spark = tokens.sparkSession
    sets = weighted_sets(tokens, merge).withColumn("set_id", F.monotonically_increasing_id())
    sets = materialise(sets, "reach-sets")
    index = _Postings(sets.select("set_id", F.explode("set_cat").alias("product"), "n"))
    left = sets.agg(F.sum("n")).first()[0] or 0
    report: list[tuple] = []
    picks: list[str] = []
    covered = 0

    def pick(best: list[tuple[int, str]]) -> None:
        nonlocal covered
        report.extend((len(picks) + 1, i + 1, product, covered - gain) for i, (gain, product) in enumerate(best))
        covered -= best[0][0]
        picks.append(best[0][1])
        del bounds[best[0][1]]

    wide, written, before = MOST_CANDIDATES, 0, 0  # picks, and keys covered, when the index was written
    bounds, beyond = _highest(index, picks, top_k)
    fresh = True  # the bounds are the gains
    while len(picks) < n_top and (bounds or beyond):
        stuck = not bounds
        if fresh and bounds:
            pick(sorted((-gain, product) for product, gain in bounds.items())[:top_k])
            fresh = False
        elif bounds:
            in_order = sorted((-gain, product) for product, gain in bounds.items())
            batch = [product for _, product in in_order[:wide]]
            counted = index.masks(batch, picks[written:])
            if counted is None:
                wide = max(SAFE_CANDIDATES, wide // 2)
                continue
            masks, n = counted
            # No product outside the round can come before this in the order by gain and code.
            limit = min([*in_order[wide : wide + 1], *([beyond] if beyond else [])], default=None)
            rounds = 0
            while len(picks) < n_top:
                bounds.update({p: int(n[masks >> bit & 1 == 1].sum()) for bit, p in enumerate(batch) if p in bounds})
                best = sorted((-bounds[p], p) for p in batch if p in bounds)[:top_k]
                if not best or limit is not None and (len(best) < top_k or best[-1] >= limit):
                    break
                pick(best)
                rounds += 1
                open_ = masks >> batch.index(picks[-1]) & 1 == 0
                masks, n = masks[open_], n[open_]
            # Without a pick the next round counts others, unless all were counted or bounds not held stand above.
            counted_all = len(batch) == len(in_order) or top_k > wide
            stuck = not rounds and (counted_all or beyond is not None and best[-1] >= beyond)
        if len(picks) < n_top and (stuck or 2 * (covered - before) > left):
            index = index.without(picks[written:])
            left, before, written = left - (covered - before), covered, len(picks)
            bounds, beyond = _highest(index, picks, top_k)
            fresh = True
    return spark.createDataFrame(report, REPORT)


def _highest(index: _Postings, gone: Sequence[str], top_k: int) -> tuple[dict[str, int], tuple[int, str] | None]:
    """The products of highest gain but those ``gone``, and where their order goes on if there are more."""
    most = max(BUFFER, top_k)
    gains = index.gains.select("product", "gain")
    gains = gains.filter(~F.col("product").isin(list(gone))) if gone else gains
    top = gains.orderBy(F.desc("gain"), "product").limit(most + 1).collect()
    beyond = (-top[-1]["gain"], top[-1]["product"]) if len(top) > most else None
    return {row["product"]: row["gain"] for row in top[:most]}, beyond


def greedy_reach(tokens: DataFrame, n_top: int, merge: bool = True) -> DataFrame:
    """(step, product, count_key): the picks, with the number of keys reached so far."""
    return greedy_candidates(tokens, n_top, top_k=1, merge=merge).select("step", "product", "count_key")
