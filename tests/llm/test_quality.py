import collections
import math
import re
import zlib

import numpy as np

from aislemetrics.llm import quality
from aislemetrics.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, inside = collections.Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            inside |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


FIELDS = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()


def test_statistics_and_verdicts(spark, folder, documents):
    rows = QUERIES["op5_quality_rules"](spark, folder).collect()
    for row in rows:
        assert tuple(row[f] for f in FIELDS) == brute(documents[row.doc_id])
        assert not (row.base_failed and row.kept)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(row, labels[row.doc_id].quality) for row in rows if row.doc_id in labels and not row.base_failed]
    good = [row.kept for row, label in judged if label == 1]
    bad = [row.kept for row, label in judged if label == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    kept = [row.score for row in rows if row.kept]
    lost = [row.score for row in rows if not row.kept and not row.base_failed]
    assert min(kept) > max(lost)  # one threshold for every document


def bucket(a, b=None, size=quality.BUCKETS):
    """A word's, or a pair of words', bucket by whole numbers."""
    low = (1 << 64) - 1
    a = zlib.crc32(a.encode()) + 1
    if b is None:
        return ((a * 0x9E3779B97F4A7C15 & low) >> 33) % size
    mixed = (a * 0xC2B2AE3D27D4EB4F + (zlib.crc32(b.encode()) + 1) * 0x165667B19E3779F9) & low
    return (((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & low) >> 33) % size


def test_scores_and_verdicts_by_brute_force(spark, folder, documents):
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    trusted = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    distrusted = {r.doc_id for r in labels if r.quality == 0}
    assert len(trusted) <= quality.TRUSTED
    grams, raw, target = {}, collections.Counter(), collections.Counter()
    for doc_id, text in documents.items():
        words = WORD.findall(text)
        grams[doc_id] = [bucket(w) for w in words] + [bucket(a, b) for a, b in zip(words, words[1:])]
        raw.update(grams[doc_id])
        if doc_id in trusted:
            target.update(grams[doc_id])
    n_raw, n_target, ratio = raw.total(), target.total(), {}
    for b in raw:
        share = (raw[b] + 0.5) / (n_raw + 0.5 * quality.BUCKETS)
        ratio[b] = math.log((target[b] + quality.PRIOR * share) / (n_target + quality.PRIOR) / share)
    scores = {i: math.fsum(ratio[b] for b in of) / len(of) if of else 0.0 for i, of in grams.items()}
    rows = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, folder).collect()}
    assert set(rows) == set(documents)
    assert all(abs(rows[i].score - scores[i]) < 1e-8 for i in rows)
    # The threshold by its definition: of all steps that keep enough of the trusted, the one that divides best.
    steps = {i: math.floor(rows[i].score / quality.STEP) for i in rows if not brute(documents[i])[-1]}
    good = [s for i, s in steps.items() if i in trusted]
    bad = [s for i, s in steps.items() if i in distrusted]
    best, at = 0.0, -math.inf
    for step in sorted({*good, *bad}):
        lost, caught = sum(s <= step for s in good), sum(s <= step for s in bad)
        if lost <= (1 - quality.KEEP_TRUSTED) * len(good) and caught / len(bad) - lost / len(good) > best:
            best, at = caught / len(bad) - lost / len(good), (step + 1) * quality.STEP
    assert at > -math.inf
    assert {i for i, r in rows.items() if r.kept} == {i for i in steps if rows[i].score >= at}


def test_counts_against_a_loop(spark, odd_docs):
    trusted = spark.createDataFrame([(5,), (7,)], "doc_id long")
    counts = {r.bucket: (r.n_raw, r.n_target) for r in quality.ngram_counts(odd_docs, trusted, buckets=64).collect()}
    raw, target = collections.Counter(), collections.Counter()
    for row in odd_docs.collect():
        words = [quality._hash(w.encode()) for w in WORD.findall(row.text or "")]
        numbers = np.array(words, np.uint64)
        if len(words):
            single, pair = quality._buckets(numbers, np.array([len(words)]), 64)
            for counter in (raw, target) if row.doc_id in (5, 7) else (raw,):
                counter.update(single.tolist() + pair.tolist())
    assert counts == {b: (n, target[b]) for b, n in raw.items()}


def test_repeated_words_exactly():
    rng = np.random.default_rng(0)
    for size in (1, 3, 8):
        for _ in range(50):
            words = rng.integers(0, 3, rng.integers(0, 60))
            windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
            often, inside = collections.Counter(windows), set()
            for i, window in enumerate(windows):
                if often[window] > 1:
                    inside |= set(range(i, i + size))
            assert quality.repeated_words(words.astype(np.int64), size) == len(inside)


def test_odd_documents(spark, odd_docs, no_docs, no_labels):
    rows = quality.quality_rules(odd_docs, no_labels).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert row.kept == (not row.base_failed)  # no labels: the base rules alone decide
    assert quality.quality_rules(no_docs, no_labels).collect() == []
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, None), (None, 1, 0), (7, None, 1), (7, 1, 1)], no_labels.schema)
    kept = quality.kept_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    assert quality.kept_documents(no_docs, labels).count() == 0


def test_threshold_keeps_the_trusted(spark, no_labels):
    rows = [(i, i / 10, False) for i in range(20)]
    scored = spark.createDataFrame(rows, "doc_id long, score double, base_failed boolean")
    labels = spark.createDataFrame([(i, int(i >= 8), 0) for i in range(20)], no_labels.schema)
    assert 0.7 < quality.threshold(scored, labels) <= 0.8
    assert quality.threshold(scored, labels.where("quality = 1")) == float("-inf")


def test_threshold_does_not_keep_toxic_documents(spark, no_labels):
    scored = spark.createDataFrame([(i, i / 10, False) for i in range(20)], "doc_id long, score double, base_failed boolean")
    labels = spark.createDataFrame([(i, i % 2, int(i < 8 and i % 2)) for i in range(20) if i < 8 or i % 2], no_labels.schema)
    assert 0.6 < quality.threshold(scored, labels) <= 0.8
