"""Hard negatives by exact inner-product search over length buckets and sorted coordinate lists.

Vectors become whole numbers, floor(256 x).  They are sorted by length and cut into buckets of neighbours; a bucket is one
row that holds its vectors and, for each coordinate, the list of its vectors sorted by that coordinate's value.  Anchors come
in batches of bounded size and meet every bucket.  A search wants the first ``k`` rows whose score lies in a window.  For a
bucket whose longest vector has length l, Cauchy's inequality first tells whether any score can reach the window at all.
For each of the anchor's focus coordinates (its largest), the window, l and the rest of the anchor then bound the values
that the coordinate may have; two binary searches in the sorted list turn them into a range of places, and the ranges are
intersected, shortest first, before the survivors' scores are computed exactly.

Windows are narrowed before the search by a probe, a bounded sample of the rows: the k-th best score in it bounds the k-th
best of all from below, so the probe changes only speed.  Nothing is left out: results are those of all pairs.

Defined cases: rows take no part whose label, vector or ``vec_id`` is null, whose vector is empty or has a null or non-finite
entry, or has another length than most have (the greater length on a tie); of rows with one ``vec_id`` the one with the
least label, then the least vector, takes part; ties of score go to the smaller ``vec_id``; an anchor without other rows of
its label has no positives and no rows; a window without rows gives none; an empty table gives an empty result.  Columns
other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.llm.common import bounded_batches, least_hashed
from aislemetrics.llm.vectors import common_length, finite_vectors, scaled_floor
from aislemetrics.session import materialise

SCALE = 256
# Vectors in a bucket at most, and how much shorter than its longest its others may be.
BUCKET, SHORTEST = 2_048, 0.9
# Focus coordinates of an anchor.
FOCUS = 4
# Anchors that meet the buckets in one pass; with vectors of 1,024 entries some 34 MB.
ANCHORS = 4_096
# Rows that only bound scores from below.
PROBE = 2_048
POSITIVES, NEGATIVES = 5, 10
# A negative's score is between these hundredths of the positive's.
LEAST, MOST = 30, 90


def whole_rows(rows: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector, square): one row a ``vec_id``, the vector as whole numbers, square its length squared."""
    length = common_length(rows, column)
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, vectors = finite_vectors(batch.column(2)).get(length, (np.zeros(0, int), np.zeros((0, length))))
            whole = scaled_floor(vectors, scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * length, pa.int32()), pa.array(whole.ravel()))
            square = pa.array([int(x) for x in (whole.astype(object) ** 2).sum(axis=1)], pa.int64())
            ids = [batch.column(i).take(pa.array(places)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, lists, square], names=["vec_id", "label", "vector", "square"])

    taken = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), column).where("vec_id is not null and label is not null")
    whole = taken.mapInArrow(run, "vec_id long, label long, vector array<long>, square long")
    first = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "square")).alias("row"))
    return first.select("vec_id", "row.*")


def _packed(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, np.int32 if np.abs(matrix).max(initial=0) < 2**31 else np.int64).tobytes()


def _unpacked(data: bytes, count: int, length: int) -> np.ndarray:
    kind = np.int32 if len(data) == 4 * count * length else np.int64
    return np.frombuffer(data, kind).reshape(count, length)


def length_buckets(rows: DataFrame, size: int = BUCKET) -> DataFrame:
    """The index: (longest, ids, labels, vectors, lists) of every bucket of ``whole_rows``.

    Rows are dealt to tasks by length and, within one length, by a hash of the id, and cut into buckets task by task.
    """
    bounded_batches(rows.sparkSession)

    def bucket(part: list[tuple]) -> pa.RecordBatch:
        vectors = np.array([row[2] for row in part], np.int64)
        lists = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        columns = {
            "longest": pa.array([float(max(row[3] for row in part)) ** 0.5]),
            "ids": pa.array([np.array([row[0] for row in part], np.int64).tobytes()]),
            "labels": pa.array([np.array([row[1] for row in part], np.int64).tobytes()]),
            "vectors": pa.array([_packed(vectors)]),
            "lists": pa.array([np.ascontiguousarray(lists).tobytes()]),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if part and (len(part) >= size or row[3] < SHORTEST**2 * part[0][3]):
                    yield bucket(part)
                    part = []
                part.append(row)
        if part:
            yield bucket(part)

    order = F.desc("square"), F.xxhash64("vec_id")
    dealt = rows.select("vec_id", "label", "vector", "square").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "longest double, ids binary, labels binary, vectors binary, lists binary")


def products(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by doubles where these hold every partial sum, else by Python's integers."""
    bound = max((int(x) for x in (vectors.astype(float) ** 2).sum(axis=1)), default=0) ** 0.5
    bound *= max((int(x) for x in (others.astype(float) ** 2).sum(axis=1)), default=0) ** 0.5
    if bound < 2**52:
        return (vectors.astype(float) @ others.astype(float).T).astype(np.int64)
    return vectors.astype(object) @ others.astype(object).T


class Bucket:
    """One row of the index, ready to be searched."""

    def __init__(self, longest: float, ids: bytes, labels: bytes, vectors: bytes, lists: bytes):
        self.longest = longest
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        count = len(self.ids)
        length = len(lists) // (4 * count)
        self.vectors = _unpacked(vectors, count, length)
        self.lists = np.frombuffer(lists, np.int32).reshape(length, count)
        # Every coordinate's values in the order of its list.
        self.sorted = np.take_along_axis(self.vectors.T, self.lists, axis=1)
        self.doubles = self.vectors.astype(float)

    def candidates(self, anchor: np.ndarray, length: float, focus: np.ndarray, low: float, high: float) -> np.ndarray | None:
        """Places of all vectors whose score may lie in low .. high, and perhaps others; None stands for all places."""
        reach = length * self.longest
        if low > reach * (1 + 1e-9) or high < -reach * (1 + 1e-9):
            return np.zeros(0, np.int64)
        ranges = []
        for f in focus:
            values = feasible(float(anchor[f]), length, self.longest, low, high)
            if values is None:
                return np.zeros(0, np.int64)
            a = np.searchsorted(self.sorted[f], math.ceil(values[0]), "left")
            b = np.searchsorted(self.sorted[f], math.floor(values[1]), "right")
            ranges.append((b - a, a, b, f, values))
        ranges.sort(key=lambda r: r[0])
        size, a, b, f, _ = ranges[0]
        if size == len(self.ids):
            return None
        places = self.lists[f, a:b]
        for size, _, _, f, values in ranges[1:]:
            if size < len(self.ids):
                column = self.vectors[places, f]
                places = places[(column >= values[0]) & (column <= values[1])]
        return places

    def scores(self, anchor: np.ndarray, length: float, places: np.ndarray | None) -> np.ndarray:
        """Exact scores of the vectors at ``places``."""
        if length * self.longest < 2**52:  # doubles hold every partial sum
            return ((self.doubles if places is None else self.doubles[places]) @ anchor.astype(float)).astype(np.int64)
        return (self.vectors if places is None else self.vectors[places]).astype(object) @ anchor.astype(object)


def feasible(value: float, length: float, longest: float, low: float, high: float) -> tuple[float, float] | None:
    """Bounds on a coordinate v of a vector no longer than ``longest`` whose product with an anchor may lie in low .. high.

    The anchor has ``length`` and ``value`` in that coordinate.  With r what is left of its length, a score is at most
    value v + r sqrt(longest² - v²) and at least value v - r sqrt(longest² - v²).  None where no v will do.
    """
    rest = max(0.0, length * length - value * value) ** 0.5
    scale = length * longest

    def above(value: float, low: float) -> tuple[float, float] | None:
        """v with value v + rest sqrt(longest² - v²) >= low: the cosine of the angle is at least low / scale."""
        if low <= -scale or not scale:
            return -longest, longest
        if low > scale:
            return (None if low > scale * (1 + 1e-9) else (value / length * longest,) * 2)
        # v = longest cos(t), the anchor's coordinate = length cos(s): |t - s| is at most the angle of the score.
        s, angle = math.atan2(rest, value), math.acos(low / scale)
        return longest * math.cos(min(math.pi, s + angle)), longest * math.cos(max(0.0, s - angle))

    first, second = above(value, low), above(-value, -high)
    if first is None or second is None:
        return None
    slack = 1 + 1e-6 * longest
    # The second bounds come from the mirrored anchor, so they hold for v itself.
    bounds = max(first[0], second[0]) - slack, min(first[1], second[1]) + slack
    return bounds if bounds[0] <= bounds[1] else None


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then rising id."""
    if len(scores) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        scores, ids = scores[near], ids[near]
    order = sorted(range(len(scores)), key=lambda i: (-int(scores[i]), int(ids[i])))[:k]
    return scores[order], ids[order]


class Wanted:
    """What anchors look for: ``windows`` (low, high) of scores, each its first ``k`` rows, of the same or another label."""

    def __init__(self, anchors: list, same: bool, k: int, probe: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        self.same, self.k = same, k
        self.ids = [a["vec_id"] for a in anchors]
        self.labels = [a["label"] for a in anchors]
        self.lengths = [float(a["square"]) ** 0.5 for a in anchors]
        self.vectors = [np.array(a["vector"], np.int64) for a in anchors]
        self.focus = [np.argsort(-np.abs(v), kind="stable")[:FOCUS] for v in self.vectors]
        self.windows = [[list(w) for w in a["windows"]] for a in anchors]
        if probe is not None:
            self._narrow(*probe)

    def _narrow(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Raise the windows' lower ends to the k-th best score that the probe has in them."""
        for n, anchor in enumerate(self.vectors):
            fits = ((labels == self.labels[n]) == self.same) & (ids != self.ids[n])
            scores = np.sort(products(vectors[fits], anchor[None, :])[:, 0])
            for window in self.windows[n]:
                inside = scores[(scores >= window[0]) & (scores <= window[1])]
                if len(inside) >= self.k:
                    window[0] = max(window[0], int(inside[-self.k]))

    def search(self, buckets: Iterator[Bucket]) -> Iterator[tuple]:
        """(anchor, window, id, score): the first ``k`` rows of ``buckets`` in every window.

        A window that holds ``k`` rows narrows to the k-th best of them for the buckets that follow.
        """
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        low = [[w[0] for w in windows] for windows in self.windows]
        for bucket in buckets:
            by_label: dict[int, np.ndarray] = {}
            for n, windows in enumerate(self.windows):
                if not windows:
                    continue
                least, most = min(low[n]), max(w[1] for w in windows)
                if least > most:
                    continue
                anchor, label = self.vectors[n], self.labels[n]
                places = bucket.candidates(anchor, self.lengths[n], self.focus[n], least, most)
                if label not in by_label:
                    by_label[label] = (bucket.labels == label) == self.same
                if places is None:
                    places = np.flatnonzero(by_label[label])
                else:
                    places = places[by_label[label][places]]
                if not len(places):
                    continue
                scores, ids = bucket.scores(anchor, self.lengths[n], places), bucket.ids[places]
                fits = (scores >= least) & (scores <= most) & (ids != self.ids[n])
                if not fits.any():
                    continue
                scores, ids = scores[fits], ids[fits]
                for w, (_, high) in enumerate(windows):
                    inside = (scores >= low[n][w]) & (scores <= high)
                    if not inside.any():
                        continue
                    mine, names = scores[inside], ids[inside]
                    if (n, w) in held:
                        mine, names = np.concatenate([held[n, w][0], mine]), np.concatenate([held[n, w][1], names])
                    held[n, w] = mine, names = _best(mine, names, self.k)
                    if len(mine) == self.k:
                        low[n][w] = int(mine[-1])
        for (n, w), (scores, ids) in held.items():
            yield from ((self.ids[n], w, int(i), int(s)) for s, i in zip(scores, ids, strict=True))


def first_in_windows(index: DataFrame, anchors: DataFrame, k: int, same: bool, probe: DataFrame, batch_rows: int = ANCHORS) -> DataFrame:
    """(anchor_id, window, vec_id, score, rank): the first ``k`` rows of ``index`` in every window of every anchor.

    ``anchors`` has vec_id, label, vector, square and windows, a list of (low, high); a window's place in it names it.  Rows
    are those of the anchor's label (``same``) or of all others, never the anchor itself.  Anchors are dealt into batches of
    about ``batch_rows``, and each batch is broadcast for one pass over the index.
    """
    spark = index.sparkSession
    batches = max(1, math.ceil(anchors.count() / batch_rows))
    dealt = anchors.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(batches)))
    sample = probe.select("vec_id", "label", "vector").collect()
    some = None
    if sample:
        some = tuple(np.array([row[i] for row in sample], np.int64) for i in range(3))
    schema = "anchor_id long, window int, vec_id long, score long"
    found = []
    for number in range(batches):
        mine = [row.asDict(recursive=True) for row in dealt.where(F.col("batch") == number).orderBy("vec_id").collect()]
        mine = [row | {"windows": [(w["low"], w["high"]) for w in row["windows"]]} for row in mine]
        shared = spark.sparkContext.broadcast(Wanted(mine, same, k, some))

        def run(parts, shared=shared):
            buckets = (Bucket(*row) for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
            rows = list(shared.value.search(buckets))
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)],
                names=["anchor_id", "window", "vec_id", "score"],
            )

        tasks = index.select("longest", "ids", "labels", "vectors", "lists").mapInArrow(run, schema)
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        ranked = tasks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(materialise(ranked, "negatives-found"))
        shared.destroy()
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def with_window(anchors: DataFrame) -> DataFrame:
    """``anchors`` with one window that holds every score."""
    everything = F.struct(F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high"))
    return anchors.withColumn("windows", F.array(everything))


def hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[DataFrame], DataFrame],
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` come from ``whole_rows``; ``is_anchor`` filters the anchors from them.  An anchor's positives are its first rows
    of the same label; a positive's negatives are the first rows of other labels whose score is at least ``least`` and at
    most ``most`` hundredths of the positive's.
    """
    rows = materialise(rows, "negatives-rows")
    index = materialise(length_buckets(rows), "negatives-index")
    probe = least_hashed(rows, "vec_id", PROBE)
    anchors = is_anchor(rows)
    top = first_in_windows(index, with_window(anchors), positives, True, probe)
    top = materialise(top.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    low = F.ceil(F.col("positive_score") * F.lit(least).cast("decimal(3,0)") / 100).cast("long")
    high = F.floor(F.col("positive_score") * F.lit(most).cast("decimal(3,0)") / 100).cast("long")
    # Windows in the order of the positives' ranks, so a window's place is its positive's rank less one.
    window = F.struct("rank", low.alias("low"), high.alias("high"))
    windows = top.groupBy("anchor_id").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    windows = windows.withColumn("windows", F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))))
    asking = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = first_in_windows(index, asking, negatives, False, probe)
    found = found.select("anchor_id", (F.col("window") + 1).alias("of"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    pairs = top.withColumnRenamed("rank", "of").join(found, ["anchor_id", "of"])
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
