import numpy as np
import pytest

from aislemetrics.llm import negatives


def brute(rows, anchors, positives=5, count=10, least=30, most=90):
    """All pairs; ``rows`` is {id: (label, vector of whole numbers)}."""
    made = []
    for a in anchors:
        own, v = rows[a]
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, label) for i, (label, w) in rows.items() if i != a]
        scored.sort()
        for score, p, _ in [s for s in scored if s[2] == own][:positives]:
            fits = [s for s in scored if s[2] != own and 30 * -score <= 100 * -s[0] <= 90 * -score]
            made += [(a, p, r, i, -score, -s) for r, (s, i, _) in enumerate(fits[:count], 1)]
    return sorted(made)


def frame_of(spark, data, labels):
    rows = [(i, [float(x) for x in v], int(n)) for i, (v, n) in enumerate(zip(data, labels, strict=True))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def mined(spark, frame, every):
    whole = negatives.whole_rows(frame)
    return sorted(tuple(r) for r in negatives.hard_negatives(whole, lambda f: f.where(f"vec_id % {every} = 0")).collect())


SHAPES = {
    "alike lengths": lambda rng: rng.standard_normal((700, 8)) * 0.2,
    "lengths apart": lambda rng: rng.standard_normal((700, 8)) * rng.lognormal(0, 1.5, (700, 1)),
    "one direction": lambda rng: np.outer(rng.lognormal(0, 1, 700), [0.5, 0.5, 0.7, 0, 0, 0]) + rng.standard_normal((700, 6)) * 0.02,
    "one vector": lambda rng: np.where(rng.random((700, 1)) < 0.6, 0.3, rng.standard_normal((700, 5)) * 0.3),
    "few values": lambda rng: rng.integers(-1, 2, (700, 4)) / 4,
    "zeros": lambda rng: np.zeros((700, 3)),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_against_all_pairs(spark, shape, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 64)
    monkeypatch.setattr(negatives, "PROBE", 100)
    rng = np.random.default_rng(len(shape))
    data, labels = SHAPES[shape](rng), rng.choice(4, 700, p=[0.4, 0.3, 0.2, 0.1])
    rows = {i: (int(n), [int(np.floor(256 * x)) for x in v]) for i, (v, n) in enumerate(zip(data, labels, strict=True))}
    assert mined(spark, frame_of(spark, data, labels), 50) == brute(rows, range(0, 700, 50))


def test_pruning_keeps_every_vector_of_a_window():
    rng = np.random.default_rng(3)
    pruned = 0
    for trial in range(80):
        size = 3 + trial % 3
        vectors = rng.standard_normal((200, size)) * rng.lognormal(0, trial % 2, (200, 1))
        if trial % 4 < 2:  # of one length, as buckets are nearly
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.floor(256 * vectors).astype(np.int64)
        part = [(i, 0, list(map(int, v)), int(v @ v)) for i, v in enumerate(vectors)]
        lists = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)).tobytes()
        zeros = np.zeros(200, np.int64).tobytes()
        bucket = negatives.Bucket(
            max(p[3] for p in part) ** 0.5, np.arange(200).astype(np.int64).tobytes(), zeros, negatives._packed(vectors), lists
        )
        anchor = np.floor(256 * rng.standard_normal(size) * (trial % 5)).astype(np.int64)
        scores = vectors @ anchor
        low, high = np.sort(rng.choice(np.sort(scores)[-10 if trial % 4 else 0 :], 2))
        focus = np.argsort(-np.abs(anchor))[:4]
        places = bucket.candidates(anchor, float(anchor @ anchor) ** 0.5, focus, int(low), int(high))
        if places is not None:
            assert set(np.flatnonzero((scores >= low) & (scores <= high))) <= set(places.tolist())
            assert (bucket.scores(anchor, float(anchor @ anchor) ** 0.5, places) == scores[places]).all()
            pruned += 200 - len(places)
    assert pruned > 2_000


def test_batches_of_anchors(spark):
    rng = np.random.default_rng(9)
    data, labels = rng.standard_normal((300, 6)) * 0.3, rng.integers(0, 3, 300)
    rows = negatives.whole_rows(frame_of(spark, data, labels))
    index, anchors = negatives.length_buckets(rows, 50), negatives.with_window(rows.where("vec_id % 10 = 0"))
    none = rows.limit(0)
    one = negatives.first_in_windows(index, anchors, 5, True, rows.limit(40)).collect()
    many = negatives.first_in_windows(index, anchors, 5, True, none, batch_rows=4).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 150


def test_long_scores_are_exact():
    rng = np.random.default_rng(1)
    big = rng.integers(-(2**38), 2**38, (5, 3))
    theirs = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in big] for a in big]
    assert negatives.products(big, big).tolist() == theirs


def test_odd_rows(spark):
    nan = float("nan")
    rows = [
        (0, [0.5, 0.5], 1),
        (0, [0.5, 0.5], 1),  # one vec_id twice: one of them takes part
        (1, [0.5, 0.25], 1),
        (2, [0.25, 0.25], 2),
        (3, [0.25, 0.25], 2),  # a tie
        (4, [0.125, 0.125], None),
        (5, None, 2),
        (6, [nan, 0.5], 2),
        (7, [None, 0.5], 2),
        (8, [], 2),
        (9, [0.25], 2),  # another length than most
        (None, [0.25, 0.25], 2),
        (10, [-0.5, -0.5], 3),  # the only one of its label
    ]
    rows = [(*row, 1, b"x", "y") for row in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score int, lists binary, windows string")
    assert mined(spark, frame, 10) == [(0, 1, 1, 2, 24576, 16384), (0, 1, 2, 3, 24576, 16384)]
    assert mined(spark, frame.limit(0), 10) == []
