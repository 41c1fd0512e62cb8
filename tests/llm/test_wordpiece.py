import random

import sentencepiece
from tokenizers.models import WordPiece

from aislemetrics.llm import wordpiece
from aislemetrics.llm.queries import QUERIES, vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def library_of(starts, goes_on):
    names = [*starts, *(f"##{piece}" for piece in goes_on), "[UNK]"]
    vocab = {piece: i for i, piece in enumerate(dict.fromkeys(names))}
    return WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1_000_000)


def count(library, word):
    found = library.tokenize(word)
    return 0 if [t.value for t in found] == ["[UNK]"] else len(found)


def test_small_vocabularies_against_the_library():
    rng = random.Random(3)
    piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(60):
        starts, goes_on = [piece() for _ in range(rng.randint(1, 8))], [piece() for _ in range(rng.randint(1, 8))]
        ours, library = wordpiece.Automaton(starts, goes_on), library_of(starts, goes_on)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert ours.pieces(word) == count(library, word), (starts, goes_on, word)


def test_whole_table(spark, folder, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = [model.id_to_piece(i) for i in range(259, model.get_piece_size())]
    starts = [n[1:] for n in names if n[0] == "▁" and len(n) > 1 and "▁" not in n[1:]]
    library = library_of(starts, [n for n in names if "▁" not in n])
    for row in QUERIES["op10_piece_counts"](spark, folder).collect():
        lengths = [count(library, w.decode()) for w in documents[row.doc_id].encode().split()]
        unknown = lengths.count(0)
        assert (row.n_words, row.n_tokens, row.n_unknown) == (len(lengths), sum(lengths) + unknown, unknown)


def test_linear_on_a_long_word():
    ours = wordpiece.Automaton(["a", "ab"], ["a", "aaaa", "b"])
    word = "a" * 100_000 + "b"
    assert ours.pieces(word) == 1 + (99_999 // 4) + 99_999 % 4 + 1


def test_odd_documents(odd_docs, no_docs):
    rows = wordpiece.token_counts(odd_docs, MODEL).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_words == r.n_tokens == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert wordpiece.token_counts(no_docs, MODEL).count() == 0
