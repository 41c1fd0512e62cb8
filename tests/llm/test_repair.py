import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aislemetrics.llm import repair
from aislemetrics.llm.queries import QUERIES, vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_whole_table(spark, folder, documents):
    library, at = Tokenizer.from_file(PATH), 0
    found = {r.doc_id: r for r in QUERIES["op2_grammar_shards"](spark, folder).collect()}
    assert len(found) == len(documents)
    for doc_id in sorted(documents):
        ids = [*library.encode(documents[doc_id], add_special_tokens=False).ids, 2]
        row = found[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


docs = st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(docs, st.sampled_from([10, 70_000]), st.integers(1, 7), st.integers(0, 70), st.integers(0, 70))
def test_round_trip_and_ranges(held, first, rounds, a, b):
    starts = np.concatenate(([0], np.cumsum([len(x) for x in held])))
    ids = np.array([x for doc in held for x in doc], np.int64)
    grammar = repair.compress(ids, starts, first, rounds=rounds, rules=4, least=2)
    shard = repair.Shard(repair.pack([None, *range(1, len(held))], starts, grammar))
    assert shard.doc_ids == [None, *range(1, len(held))] and shard.id_starts.tolist() == starts.tolist()
    for i, doc in enumerate(held):
        assert shard.ids(i).tolist() == doc
        assert shard.ids(i, min(a, b), max(a, b)).tolist() == doc[min(a, b) : max(a, b)]
    for rule, length in zip(shard.rules, shard.lengths):
        assert len(repair.expand(rule, shard.rules, first)) == length


def test_repeats_shrink():
    ids = np.array(([5, 6, 7, 8] * 100 + [2]) * 20, np.int64)
    starts = np.arange(0, len(ids) + 1, 401)
    grammar = repair.compress(ids, starts, 100, rounds=8)
    assert len(grammar.symbols) < len(ids) / 20
    assert grammar.starts[-1] == len(grammar.symbols) and (np.diff(grammar.starts) > 0).all()


@pytest.mark.parametrize("first", [300, 65_530, 70_000])  # symbols of two bytes, of two and then four, of four
def test_production_setting_leaves_no_frequent_pair(first):
    rng = np.random.default_rng(5)
    passage = rng.integers(3, 300, 1_000)
    held = [np.concatenate([rng.integers(3, 300, 50), passage, rng.integers(3, 300, 50), [2]]) for _ in range(40)]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in held])))
    ids = np.concatenate(held)
    grammar = repair.compress(ids, starts, first)
    assert repair.expand(grammar.symbols, grammar.rules, first).tolist() == ids.tolist()
    assert grammar.lengths.max() >= 1_000 and len(grammar.symbols) < 40 * 110
    inside = np.ones(len(grammar.symbols), bool)
    inside[grammar.starts[1:] - 1] = False
    inside = inside[:-1]
    pairs = np.stack([grammar.symbols[:-1], grammar.symbols[1:]], axis=1)[inside]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < repair.LEAST


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_pairs_of_one_hash_are_all_found(kind):
    rng = np.random.default_rng(6)
    chosen = np.unique(rng.integers(1, 1 << 31, 5_000).astype(kind) << kind(0 if kind is np.uint32 else 16))
    rng.shuffle(chosen)
    keys = rng.permutation(np.concatenate([chosen, chosen, chosen + kind(1)]))
    rank = {key: i for i, key in enumerate(chosen.tolist())}
    places, ranks = repair._ranks(keys, chosen)
    expected = [(i, rank[key]) for i, key in enumerate(keys.tolist()) if key in rank]
    assert list(zip(places.tolist(), ranks.tolist())) == expected


def test_texts_as_the_library(documents):
    library = Tokenizer.from_file(PATH)
    texts = ["", " ", "<|endoftext|> a", "a<|startoftext|>b", "é ́x é", "İ Σ ΑΣ", "a\x1cd \x1f", "\x85x y", "日本語 😀", "it's 'S", None]
    texts += ["I'M we'LL 'Dx y'd_z 12a.,_ ''t", "ǅ ŉ ÷ × ªº ²", "Æ Ⅷ ½ \xa0\u2003 a", "x" * 900, "ÀÖØ ɏ ı don't'", "'", "a'", "9", "9.9'9"]
    texts += list(documents.values())[:80]
    for limit in (50, 1_000_000):  # a table that is emptied again and again, and one that is not
        encode = repair.WordIds(PATH, limit)
        for text in texts:
            expected = library.encode(text or "", add_special_tokens=False).ids
            assert encode(text).tolist() == expected == encode(text).tolist(), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aBz'sStrReéÀİıß09_.,-!<|> \n\x1c\u0301日"), max_size=12))
def test_any_text_as_the_library(text):
    assert repair.word_ids(PATH)(text).tolist() == repair.word_ids(PATH).library.encode(text, add_special_tokens=False).ids


def test_one_id_holds_a_third_of_all_rows(spark, tmp_path, all_partitions):
    rows = spark.range(3_000, numPartitions=6).selectExpr(
        "if(id % 3 = 0, 7, id) AS doc_id", "if(id % 2 = 0, 'a copy', concat('text ', id)) AS text"
    )
    path = str(tmp_path / "a")
    repair.write_shards(rows, path, PATH)
    found = repair.read_documents(spark, path).join(repair.shard_starts(spark, path), ["part", "seq"]).collect()
    found.sort(key=lambda r: r.shard_start + r.place)
    names = [r.doc_id for r in found]
    assert names == sorted(names) and len(names) == 3_000
    assert len({r.part for r in found if r.doc_id == 7}) > 1
    library = Tokenizer.from_file(PATH)
    given = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids + [2]) for r in rows.collect())
    assert sorted((r.doc_id, list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in found) == given


@pytest.mark.parametrize("tokens", [3, 1 << 19])
def test_odd_documents(spark, odd_docs, no_docs, tmp_path, tokens):
    repair.write_shards(odd_docs, str(tmp_path / "a"), PATH, shard_tokens=tokens)
    rows = repair.digests(spark, str(tmp_path / "a")).orderBy("start").collect()
    names = [r.doc_id for r in rows]
    assert names == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])))[:-1].tolist()
    texts, library = {r.doc_id: r.text or "" for r in odd_docs.where("doc_id is not null").collect()}, Tokenizer.from_file(PATH)
    for row in repair.read_documents(spark, str(tmp_path / "a")).where("doc_id is not null").collect():
        ids = [*library.encode(texts[row.doc_id], add_special_tokens=False).ids, 2]
        assert row.ids == struct.pack(f"<{len(ids)}I", *ids)
    repair.write_shards(no_docs, str(tmp_path / "b"), PATH)
    assert repair.digests(spark, str(tmp_path / "b")).count() == 0
