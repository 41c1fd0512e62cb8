"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal data, and piece ids at the end.

A stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns of
``documents``, and whatever further columns the input has.

Defined cases: null, empty and very short texts fall to the quality rules; rows without a doc_id are judged like any other,
and of a group of near-duplicates stay only where no row of it has an id; repeated rows are one group, so one of them stays;
of a tie in doc_id the text of least hash stays; texts of any length are processed whole; an empty table gives an empty
result; columns of the operators' own names (kept, fp, _sig, ids ...) come through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aislemetrics.llm import contamination, pieces, pii, quality, simhash
from aislemetrics.llm.common import table
from aislemetrics.llm.queries import vocabulary
from aislemetrics.session import materialise, release, written


def passing_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return simhash.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return contamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind in brackets, n_chars counted anew."""
    return pii.redacted_documents(docs, pii.fit(docs))


def as_piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every remaining text, the text decoded from them, and their digests."""
    encoded = pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    return pieces.digests(encoded, "ids")


STAGES = [
    ("quality_rules", passing_quality),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("piece_ids", as_piece_ids),
]

# The quality score hashes words in a way SQL cannot follow; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it.

    What a stage and those before it wrote is deleted as soon as its result stands, and all of it where a stage fails, so the
    folder holds no more than two results at a time.
    """
    before = set(written())

    def made() -> list[str]:
        return [path for path in written() if path not in before]

    docs = table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            release(spark, made()[:-1])
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        release(spark, made())
        raise
