"""Whitening of embeddings: blockwise QR, Householder bidiagonals, singular values by dqds, directions by twisted
factorisations.

Entries become whole numbers x = floor(64 c) + 1,000,000, and their count n and sums S are exact.  Every task reduces its
centred rows, block by block, to a triangle R by QR; the triangles are reduced along a tree, so that no covariance is
formed and no task or driver holds more than ``FAN`` of them.  The last triangle (dimension by dimension) is made
bidiagonal by Householder reflections; the differential qd algorithm with shifts finds its singular values to high
relative accuracy, and a twisted factorisation at each of them gives the direction.  Close singular values are made
orthogonal among themselves, then turned until their images are orthogonal too.  A vector's whitened values are its
centred projections over the roots of the components' variances.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another
length than most have (the greater length on a tie); a null or repeated ``vec_id`` is a row like any other; components whose
variance is zero to rounding, as of constant or dependent entries and of a single row, cannot be whitened and are left out;
equal variances stand in any order, but their directions are orthogonal; of the two signs of a direction, that with a
positive largest entry is taken; an empty table gives an empty result.  Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import bounded_batches
from aislemetrics.llm.vectors import common_length, finite_vectors, merged, scaled_floor, summaries

# An entry c stands for floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
# Components returned.
COMPONENTS = 32
# Most entries of a vector: a triangle of such a side has 32 MB.
MOST_LENGTH = 2_048
# Rows that one QR step takes beside the triangle so far.
BLOCK = 4_096
# Singular values closer than this, relative to the larger, are one cluster.
CLUSTER = 1e-3
_EPS = np.finfo(float).eps


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, upper diagonal b and right factor V of a square matrix = U B V'; by Householder reflections."""
    work, size = matrix.astype(float).copy(), matrix.shape[1]
    right = np.eye(size)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, length = x.copy(), np.linalg.norm(x)
        v[0] += np.copysign(length, x[0])
        square = v @ v
        return v, 2 / square if square else 0.0

    for k in range(size):
        v, twice = reflector(work[k:, k])
        work[k:, k:] -= twice * np.outer(v, v @ work[k:, k:])
        if k < size - 1:
            v, twice = reflector(work[k, k + 1 :])
            work[k:, k + 1 :] -= twice * np.outer(work[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= twice * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(work).copy(), np.diagonal(work, 1).copy(), right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step; None where the shift was too large.  Also the sum of the reciprocals of its d."""
    d, new_q, new_e, inverse = q[0] - shift, [], [], 0.0
    if d < 0:
        return None
    for k in range(len(e)):
        pivot = d + e[k]
        inverse += 1 / d if d else float("inf")
        ratio = q[k + 1] / pivot if pivot else 1.0
        new_q.append(pivot)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        if not d >= 0:
            return None
    new_q.append(d)
    return new_q, new_e, inverse + (1 / d if d else float("inf"))


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the upper bidiagonal matrix (a, b), falling, by dqds.

    A step without shift also bounds the least eigenvalue from below (the inverse's trace), so the shift taken after a
    more daring one has failed is safe.
    """
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not size:
        return np.zeros(len(a))
    found: list[float] = []
    least = float(np.finfo(float).tiny) / _EPS**2
    open_parts = [([max(float(x), least) for x in (a / size) ** 2], [float(x) for x in (b / size) ** 2], 0.0)]
    while open_parts:
        q, e, moved = open_parts.pop()
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _EPS**2 * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                open_parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:  # the small end goes last
                q, e = q[::-1], e[::-1]
            q, e, inverse = _step(q, e, 0.0)
            low = 1 / inverse if inverse < float("inf") else 0.0
            # The smaller eigenvalue of the last 2 x 2 block, which the least eigenvalue does not exceed.
            above, last, product = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = abs(above - last) / 2
            daring = min(above, last) - (product / (half + math.hypot(half, math.sqrt(product))) if product else 0.0)
            for shift in (daring * (1 - 1e-8) - moved * 4 * _EPS, low, low / 2):
                if shift > 0 and moved + shift > moved and (made := _step(q, e, shift)):
                    q, e, moved = made[0], made[1], moved + shift
                    break
        found.append(q[0] + moved)
    return size * np.sqrt(np.sort(found)[::-1])


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twisted factors of B'B - value: the lower multipliers from the top, the upper ones from the end, the pivots gamma."""
    n, tiny = len(a), np.finfo(float).tiny / _EPS
    diagonal = np.maximum(a * a, tiny)
    factor = b / np.where(np.abs(a[:-1]) > np.sqrt(tiny), a[:-1], np.sqrt(tiny))
    top, end = np.zeros(n - 1), np.zeros(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + diagonal[k]
        top[k] = diagonal[k] * factor[k] / (pivot if pivot else -tiny)
        s[k + 1] = top[k] * factor[k] * s[k] - value
    p[-1] = diagonal[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = diagonal[k] * factor[k] ** 2 + p[k + 1]
        ratio = diagonal[k] / (pivot if pivot else -tiny)
        end[k] = factor[k] * ratio
        p[k] = p[k + 1] * ratio - value
    return top, end, s + p + value


def _vector(top: np.ndarray, end: np.ndarray, twist: int) -> np.ndarray:
    n = len(top) + 1
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -top[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -end[k] * z[k]
        if z[k + 1] == 0:
            break
    length = np.linalg.norm(z)
    return z / length if np.isfinite(length) else z * 0


def _turned(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``vectors`` turned among themselves until the columns of ``matrix @ vectors`` are orthogonal (one-sided Jacobi)."""
    image = matrix @ vectors
    for _ in range(30):
        largest = 0.0
        for i in range(image.shape[1] - 1):
            for j in range(i + 1, image.shape[1]):
                x, y, xy = image[:, i] @ image[:, i], image[:, j] @ image[:, j], image[:, i] @ image[:, j]
                if abs(xy) <= _EPS * np.sqrt(x * y):
                    continue
                largest = max(largest, abs(xy) / np.sqrt(x * y))
                zeta = (y - x) / (2 * xy)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                turn = np.array([[c, c * t], [-c * t, c]])
                image[:, [i, j]] = image[:, [i, j]] @ turn
                vectors[:, [i, j]] = vectors[:, [i, j]] @ turn
        if largest < 1e-15:
            break
    order = np.argsort(-np.linalg.norm(image, axis=0), kind="stable")
    return vectors[:, order]


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Unit right singular vectors, as columns, of the ``count`` largest ``values`` of the bidiagonal matrix (a, b)."""
    n = len(a)
    if n == 1:
        return np.ones((1, count))
    matrix, size = np.diag(a) + np.diag(b, 1), values[0]
    a, b, values, image = a / size, b / size, values / size, matrix / size
    result = np.zeros((n, 0))
    at = 0
    while at < count:
        stop = at + 1
        while stop < n and values[stop - 1] - values[stop] < CLUSTER * values[stop - 1]:
            stop += 1
        group = np.zeros((n, 0))
        for value in values[at:stop] ** 2:
            top, end, gamma = _twisted(a, b, value)
            best = None
            for twist in np.argsort(np.abs(gamma), kind="stable"):
                z = _vector(top, end, int(twist))
                rest = z - group @ (group.T @ z)
                rest -= group @ (group.T @ rest)
                length = np.linalg.norm(rest)
                fits = length and np.linalg.norm(image.T @ (image @ rest) - value * rest) <= 2 * CLUSTER * length
                if fits and length > 0.1:
                    best = rest / length
                    break
            if best is None:  # inverse iteration from what the group lacks
                best = np.random.default_rng(at).standard_normal(n)
                shifted = image.T @ image - value * (1 + 4 * _EPS) * np.eye(n)
                for _ in range(4):
                    best -= group @ (group.T @ best)
                    best = np.linalg.lstsq(shifted, best / np.linalg.norm(best), rcond=None)[0] + 0.0
                best -= group @ (group.T @ best)
                best /= np.linalg.norm(best)
            group = np.column_stack([group, best])
        result = np.column_stack([result, _turned(image, group) if stop - at > 1 else group])
        at = stop
    return result[:, :count]


@dataclass
class Whitening:
    """``directions`` (dimension by component), ``variances`` of the components, all of them in ``trace``; the fitted rows'
    count ``n`` and ``sums``."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace if self.trace else self.variances


def _shifts(column: pa.Array, length: int, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``length`` entries, and n x - S of each, exactly."""
    rows, vectors = finite_vectors(column).get(length, (np.zeros(0, int), np.zeros((0, length))))
    x = scaled_floor(vectors, SCALE) + SHIFT
    if len(rows) and n * int(np.abs(x).max()) + int(np.abs(sums).max(initial=0)) >= 2**62:
        return rows, n * x.astype(object) - sums.astype(object)
    return rows, n * x - sums


def totals(rows: DataFrame, column: str, length: int) -> tuple[int, np.ndarray]:
    """How many vectors of ``length`` entries there are, and the exact sum of each entry's whole numbers."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        n, sums = 0, np.zeros(length, np.int64)
        for batch in batches:
            _, vectors = finite_vectors(batch.column(0)).get(length, (None, np.zeros((0, length))))
            n, sums = n + len(vectors), sums + (scaled_floor(vectors, SCALE) + SHIFT).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    tasks = rows.select(column).mapInArrow(run, "n long, sums array<long>").select("n", F.posexplode("sums").alias("i", "s"))
    sums = tasks.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (sums[0].n, np.array([row.s for row in sums], np.int64)) if sums else (0, np.zeros(length, np.int64))


def _triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all finite vectors in ``column``; None without any.  Vectors have at most ``MOST_LENGTH`` entries."""
    length = common_length(rows, column)
    if not length:
        return None
    if length > MOST_LENGTH:
        raise ValueError(f"vectors of {length} entries; at most {MOST_LENGTH}")
    n, sums = totals(rows, column, length)

    def start():
        held, height, triangle = [], 0, np.zeros((0, length))

        def reduce():
            nonlocal held, height, triangle
            triangle, held, height = _triangle([triangle, *held]), [], 0

        def add(batch):
            nonlocal height
            _, shifts = _shifts(batch.column(0), length, sums, n)
            if len(shifts):
                held.append((shifts / n).astype(float))
                height += len(shifts)
            if height >= max(BLOCK, 4 * length):
                reduce()

        def result():
            if held:
                reduce()
            return triangle.tobytes() if len(triangle) else None

        return add, result

    def merge(parts):
        return _triangle([np.frombuffer(part).reshape(-1, length) for part in parts]).tobytes()

    triangle = np.zeros((length, length))
    reduced = np.frombuffer(merged(summaries(rows, [column], start), merge, "whitening-triangles")).reshape(-1, length)
    triangle[: len(reduced)] = reduced
    a, b, right = bidiagonal(triangle)
    values = singular_values(a, b)
    count = min(components, int((values > values[0] * max(n, length) * _EPS).sum()) if values[0] else 0)
    directions = right @ right_vectors(a, b, values, count) if count else np.zeros((length, 0))
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(count)]) if count else 1.0
    return Whitening(n, sums, directions * signs, values[:count] ** 2 / n, float((triangle**2).sum() / n))


def whiten(
    rows: DataFrame, model: Whitening, column: str = "embedding", carry: tuple[str, ...] = ("vec_id",)
) -> DataFrame:
    """``carry``, deviation decimal(38) and whitened array<double> of every vector that ``model`` was fitted on."""
    bounded_batches(rows.sparkSession)
    length = len(model.sums)
    scaled = model.directions / np.sqrt(model.variances)
    fields = rows.select(*carry).schema.fields
    source = rows.select(*carry, column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "deviation decimal(38,0), whitened array<double>"])

    def run(batches):
        for batch in batches:
            places, shifts = _shifts(batch.column(len(carry)), length, model.sums, model.n)
            if not len(places):
                continue
            if shifts.dtype != object and float(np.abs(shifts).max()) ** 2 * length >= 2**62:
                shifts = shifts.astype(object)
            deviation = pa.array([int(x) for x in (shifts * shifts).sum(axis=1)], pa.decimal128(38, 0))
            white = (shifts / model.n).astype(float) @ scaled
            ends = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel()))
            kept = [batch.column(i).take(pa.array(places)) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, deviation, lists], names=[*carry, "deviation", "whitened"])

    return source.mapInArrow(run, schema)


def identity_error(white: DataFrame) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity.

    Tasks sum products about their own means; pairs of tasks are merged about the common mean.  0 without components.
    """

    def start():
        n, mean, square = 0, None, None

        def add(batch):
            nonlocal n, mean, square
            values = np.vstack(batch.column(0).to_numpy(zero_copy_only=False))
            here, count = values.mean(axis=0), len(values)
            about = values - here
            n, mean, square = _joined((n, mean, square), (count, here, about.T @ about))

        def result():
            return np.concatenate([[n], mean, square.ravel()]).tobytes() if n else None

        return add, result

    def parted(summary: bytes):
        flat = np.frombuffer(summary)
        k = int(round((np.sqrt(4 * len(flat) - 3) - 1) / 2))
        return flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    def merge(parts):
        total = (0, None, None)
        for part in parts:
            total = _joined(total, parted(part))
        return np.concatenate([[total[0]], total[1], total[2].ravel()]).tobytes()

    found = merged(summaries(white.where("size(whitened) > 0"), ["whitened"], start), merge, "whitening-moments")
    if found is None:
        return 0.0
    n, _, square = parted(found)
    return float(np.abs(square / n - np.eye(len(square))).max())


def _joined(left, right):
    """Count, mean and products about it of two sets of rows together."""
    if not left[0]:
        return right
    n, apart = left[0] + right[0], right[1] - left[1]
    return n, left[1] + apart * (right[0] / n), left[2] + right[2] + np.outer(apart, apart) * (left[0] * right[0] / n)


def whitened_components(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row a vector and component."""
    model = fit(rows, column, components)
    if model is None or not len(model.variances):
        white = rows.select("vec_id").limit(0).withColumn("deviation", F.lit(None).cast("decimal(38,0)"))
        white, n, error, shares = white.withColumn("whitened", F.array().cast("array<double>")), 0, 0.0, [0.0]
    else:
        white, n, shares = whiten(rows, model, column), model.n, [float(x) for x in model.explained]
        error = identity_error(white)
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
