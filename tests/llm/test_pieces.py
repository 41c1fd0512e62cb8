import hashlib
import random

import pytest
import sentencepiece

from aislemetrics.llm import pieces
from aislemetrics.llm.queries import QUERIES, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_whole_table(spark, folder, documents, library):
    for row in QUERIES["op3_piece_round_trip"](spark, folder).collect():
        ids = library.encode(documents[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_texts_of_every_kind(library):
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "▁", "a", "the", "é", "ﬁ", "日", "🎉", "\x00", "<s>", "</s>", "<unk>", "　", "\xa0", "0x"]
    table = pieces.chunk_ids(MODEL)
    for n in list(range(12)) * 60 + [3_000]:
        text = "".join(rng.choice(signs) for _ in range(n))
        assert pieces.encode_text(text, table) == library.encode(text), text


def test_a_small_table_changes_nothing(library):
    table = pieces.chunk_ids(MODEL)
    table.limit = 2
    text = "one two three one two three " + "x" * 500 + " one"
    assert pieces.encode_text(text, table) == library.encode(text) and len(table) <= 2


def test_odd_documents(odd_docs, no_docs, library):
    rows = pieces.encode_decode(odd_docs, MODEL).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    assert sorted(r.ids for r in rows) == sorted(map(library.encode, texts))
    assert pieces.digests(pieces.encode_decode(no_docs, MODEL)).count() == 0
