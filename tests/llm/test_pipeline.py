"""The pipeline against the brute-force versions of its stages."""

import hashlib

import pytest
import sentencepiece
from test_contamination import brute as brute_hits
from test_pii import brute as brute_spans
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from aislemetrics.llm import pii
from aislemetrics.llm.queries import QUERIES, vocabulary
from aislemetrics.session import materialise, written


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), f"test-{name}")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept[-1]) == docs.count()
        if name != "piece_ids":
            assert docs.columns == columns
    verdicts = {r.doc_id for r in QUERIES["op5_quality_rules"](spark, folder).where("kept").collect()}
    assert set(kept[0]) == verdicts
    groups = brute_components({i: brute_fingerprint(r.text) for i, r in kept[0].items()})
    assert set(kept[1]) == set(groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(kept[2]) == {i for i, r in kept[1].items() if not brute_hits(r.text, items)[1]}
    assert set(kept[3]) == set(kept[2])
    for i, row in kept[3].items():
        before = kept[2][i].text
        assert not brute_spans(row.text) and row.n_chars == len(row.text)
        if not brute_spans(before) and "[" not in row.text:
            assert row.text == before
        if row.text != before:
            assert any(f"[{kind.upper()}]" in row.text for kind in pii.KINDS)
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    assert set(kept[4]) == set(kept[3])
    for i, row in kept[4].items():
        assert row.ids == library.encode(kept[3][i].text)
        assert row.decoded_sha256 == hashlib.sha256(library.decode(row.ids).encode()).hexdigest()


def test_run_is_the_stages(spark, folder):
    before = written()
    found = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), "again")
    assert found.columns == docs.columns and found.columns[:2] == ["doc_id", "n_tokens"]
    assert sorted(found.collect()) == sorted(docs.collect()) != []
    left = [path for path in written() if path not in before and "pipeline-" in path]
    assert len(left) == 1  # the last stage's input


def test_failed_run_leaves_nothing(spark, folder, monkeypatch):
    def fails(spark, docs, sf_dir):
        raise ValueError("stage")

    stages = [*corpus_pipeline.STAGES[:1], ("fails", fails), *corpus_pipeline.STAGES[1:]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    before = written()
    with pytest.raises(ValueError, match="stage"):
        corpus_pipeline.run(spark, folder)
    assert written() == before


def test_odd_documents(spark, odd_docs, no_docs, folder):
    given = odd_docs.collect()
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, folder), f"odd-{name}")
            assert docs.dtypes == odd_docs.dtypes
        # Null, empty and short texts and repeated windows fail the base rules; what stays is as it was.
        rows = docs.collect()
        assert all(row in given for row in rows) and {r.doc_id for r in rows} <= {7}
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert last.columns[0] == "doc_id" and last.count() == len(rows)
