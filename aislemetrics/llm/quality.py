"""Quality rules: plain text statistics, then a hashed n-gram log-likelihood ratio.

Every word and every pair of neighbouring words falls into one of ``BUCKETS`` buckets.  Two multinomials are counted over
the buckets: one over all documents, one over a trusted sample of them.  A document's score is the mean log ratio of the
two over its n-grams, so that its length does not matter, and one threshold decides every document.

Defined cases: a null text has no words and fails the base rules; a null ``doc_id`` is scored like any other but is never
trusted; repeated rows are counted and scored as often as they stand; without trusted or without distrusted labels the
base rules alone decide; an empty table gives an empty result.  Columns other than the named ones are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import Memo, bounded_batches, least_hashed, map_rows
from aislemetrics.session import materialise

# Buckets of the hashed n-grams.
BUCKETS = 16_384
# Trusted documents that the target multinomial is fitted on: those of least hash, at most so many.
TRUSTED = 50_000
# Pseudo-counts drawing the target multinomial towards the raw one.
PRIOR = 20_000.0
# The threshold is sought on a grid of scores from -SPAN to SPAN.
STEP, SPAN = 0.002, 8.0
# Share of the trusted documents that the threshold must keep.
KEEP_TRUSTED = 0.995
# Base rules.
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
# Labels that make a document trusted, and distrusted; toxic ones of quality 1 are neither.
GOOD, BAD = "coalesce(quality, 0) = 1 and coalesce(toxic, 0) = 0", "coalesce(quality = 0, false)"

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"


def _hash(word: bytes) -> int:
    return zlib.crc32(word) + 1


def repeated_words(words: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur at least twice; ``words`` are numbers that stand for words."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    # Number the windows of 1, 2, 4, ... words exactly, each from two of half the size.
    label, width = words, 1
    while width < size:
        grow = min(width, size - width)
        left, right = label[: len(label) - grow], label[grow:]
        _, label = np.unique(left * (int(label.max()) + 1) + right, return_inverse=True)
        width += grow
    often = np.bincount(label)[label] > 1
    if not often.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _statistics(data: bytes, words: list[bytes], numbers: np.ndarray) -> tuple[int, int, int, int, int]:
    solid = data.translate(None, _SPACES)
    chars = len(solid.decode())
    symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    _, local = np.unique(numbers, return_inverse=True)
    if len(local) and len(set(words)) != int(local.max()) + 1:  # two words with one hash: number the words themselves
        seen: dict[bytes, int] = {}
        local = np.array([seen.setdefault(word, len(seen)) for word in words], np.int64)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(local)


def _buckets(numbers: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and of all pairs of neighbours by the place of the first word.

    ``ends`` holds where each document ends; a pair across an end gets the bucket ``buckets``, which stands for none.
    """
    single = (numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    pair = numbers[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + numbers[1:] * np.uint64(0x165667B19E3779F9)
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
    inside = np.ones(len(numbers), bool)
    inside[ends[ends > 0] - 1] = False
    pair = np.where(inside[:-1], pair % np.uint64(buckets), np.uint64(buckets))
    return (single % np.uint64(buckets)).astype(np.int64), pair.astype(np.int64)


def _numbers(texts: list[str | None], memo: Memo) -> tuple[list[bytes], list[list[bytes]], np.ndarray, np.ndarray]:
    data = [(text or "").encode() for text in texts]
    words = [item.split() for item in data]
    ends = np.cumsum([len(item) for item in words], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    numbers = np.fromiter((memo[word] for item in words for word in item), np.uint64, total)
    return data, words, ends, numbers


def ngram_counts(docs: DataFrame, trusted: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Counts (bucket, n_raw, n_target) over all ``docs`` and over those whose ``doc_id`` is in the bounded ``trusted``.

    A task sums its own documents first and hands on at most ``buckets`` rows.
    """
    marked = docs.select("doc_id", F.col(text_col).alias("text")).join(
        F.broadcast(trusted.select("doc_id").distinct().withColumn("is_target", F.lit(True))), "doc_id", "left"
    )
    bounded_batches(docs.sparkSession)
    schema = "bucket int, n_raw long, n_target long"

    def run(batches):
        import pyarrow as pa

        memo, raw, target = Memo(_hash), np.zeros(buckets + 1, np.int64), np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                _, _, ends, numbers = _numbers(part.column(0).to_pylist(), memo)
                if not len(numbers):
                    continue
                single, pair = _buckets(numbers, ends, buckets)
                raw += np.bincount(single, minlength=buckets + 1) + np.bincount(pair, minlength=buckets + 1)
                flags = np.array([bool(x) for x in part.column(1).to_pylist()])
                word_flag = np.repeat(flags, np.diff(ends, prepend=0))
                target += np.bincount(single[word_flag], minlength=buckets + 1)
                target += np.bincount(pair[word_flag[:-1]], minlength=buckets + 1)
        some = np.flatnonzero(raw[:buckets])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "n_raw", "n_target"]
        )

    counted = marked.select("text", "is_target").mapInArrow(run, schema)
    return counted.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """log p_target / p_raw of each bucket (at most ``buckets`` rows come to the driver); all zero without a target."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():
        raw[row.bucket], target[row.bucket] = row.n_raw, row.n_target
    if not target.sum():
        return np.zeros(buckets)
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * buckets)
    p_target = (target + prior * p_raw) / (target.sum() + prior)
    return np.log(p_target / p_raw)


def score(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, the statistics and the score of every document; a text without words scores 0.

    The score is the mean log ratio over a document's words and pairs of neighbouring words.
    """
    buckets = len(ratios)
    weights = np.append(ratios, 0.0)

    def start():
        memo = Memo(_hash)

        def work(texts):
            data, words, ends, numbers = _numbers(texts, memo)
            single, pair = _buckets(numbers, ends, buckets) if len(numbers) else (np.zeros(0, int), np.zeros(0, int))
            gain = weights[single]
            gain[:-1] += weights[pair]
            begins = np.append(0, ends)
            stats, scores = [], []
            for i, item in enumerate(words):
                a, b = begins[i], begins[i + 1]
                stats.append(_statistics(data[i], item, numbers[a:b]))
                grams = 2 * int(b - a) - 1
                scores.append(round(float(gain[a:b].sum()) / grams, 9) if b > a else 0.0)
            return [*([s[k] for s in stats] for k in range(5)), scores]

        return work

    return map_rows(docs, f"{STATISTICS}, score double", [text_col], start, carry)


def threshold(scored: DataFrame, labels: DataFrame, keep_trusted: float = KEEP_TRUSTED) -> float:
    """The score below which documents go, from all labelled documents that pass the base rules.

    Of the grid's scores that keep at least ``keep_trusted`` of the trusted documents, the one that divides trusted
    (quality 1, not toxic) from distrusted (quality 0) documents best, the least of them on a tie; minus infinity without either.
    At most one row a grid step comes to the driver.
    """
    grid = F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), "score")) / STEP).cast("int")
    sides = (
        scored.where(~F.col("base_failed"))
        .select("doc_id", grid.alias("step"))
        .join(labels.where("quality is not null").select("doc_id", F.expr(GOOD).alias("good"), F.expr(BAD).alias("bad")), "doc_id")
        .groupBy("step")
        .agg(F.sum(F.expr("cast(good as long)")).alias("good"), F.sum(F.expr("cast(bad as long)")).alias("bad"))
        .orderBy("step")
        .collect()
    )
    good, bad = sum(r.good for r in sides), sum(r.bad for r in sides)
    if not good or not bad:
        return float("-inf")
    best, at, lost, caught = 0.0, float("-inf"), 0, 0
    for row in sides:
        lost, caught = lost + row.good, caught + row.bad
        if lost > (1 - keep_trusted) * good:
            break
        if caught / bad - lost / good > best:
            best, at = caught / bad - lost / good, (row.step + 1) * STEP
    return at


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    trusted_limit: int = TRUSTED,
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Verdict on every row of ``docs``: its columns ``carry``, the statistics, score, base_failed, kept.

    ``labels`` has doc_id, quality (1 trusted, 0 not) and toxic; toxic documents are not trusted.
    """
    trusted = labels.where(f"{GOOD} and doc_id is not null").select("doc_id").distinct()
    trusted = least_hashed(trusted, "doc_id", trusted_limit)
    ratios = log_ratios(ngram_counts(docs, trusted, text_col))
    scored = score(docs, ratios, text_col, carry)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    scored = materialise(scored.withColumn("base_failed", failed), "quality-scores")
    at = threshold(scored, labels)
    passes = F.lit(True) if at == float("-inf") else F.col("score") >= F.lit(at)
    return scored.withColumn("kept", ~F.col("base_failed") & passes)


def kept_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, that ``quality_rules`` keeps.

    The rows travel with their scores, so that no text is shuffled to meet its verdict.
    """
    packed = docs.select("doc_id", F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    return quality_rules(packed, labels, "text", carry=("doc_id", "row")).where("kept").select("row.*")
