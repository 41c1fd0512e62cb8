import random
import re

from aislemetrics.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    words, hit, named = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        size = min(10, len(own))
        for window in {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else ():
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) == window:
                    hit |= set(range(i, i + size))
                    named |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(named)


def sample():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["ab", "Cd", "é", "9", "x-y", "..", "Ü"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(12)] + [(3, "ab"), (None, "zz yy"), (20, None), (21, "ab"), (30, ".,")]
    bodies = [text(rng.randint(0, 60)) for _ in range(40)] + [items[4][1].upper() + " end", "say zz, YY!", None, "", "ab " * 5_000]
    return [*enumerate(bodies), (None, "ab"), (1, bodies[1])], items


def test_against_brute_force(spark):
    docs, items = sample()
    for limit in (10, 250_000):  # many blocks of items, and one
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        found = contamination.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
        expected = sorted((i or -1, *brute(text, items)) for i, text in docs)
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in found) == expected


def test_blocks_are_built_once_a_chunk(spark, monkeypatch):
    """Ten blocks over texts of several slices: a build a block and chunk, not a build a slice."""
    docs, items = sample()
    texts = [text for _, text in docs] * 12
    parts = [spark.sparkContext.broadcast([(i, text)]) for i, text in items[:10]]
    built = []
    real = contamination.Automaton

    class Counted(real):
        def __init__(self, *arguments):
            built.append(1)
            super().__init__(*arguments)

    monkeypatch.setattr(contamination, "Automaton", Counted)
    found = contamination._scanner(parts, 10)(texts)
    assert len(built) == 10 and len(texts) > 2 * contamination.SLICE
    one = contamination._scanner([spark.sparkContext.broadcast(items[:10])], 10)
    once = one(texts[:300]) + one(texts[300:])
    assert len(built) == 11  # and one automaton once a process
    for (n, edges, ids), (m, others, names) in zip(found, once, strict=True):
        assert (n, ids) == (m, names) and (edges is None) == (others is None)
        assert edges is None or (edges == others).all()


def test_a_large_benchmark_is_one_compact_automaton(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=400))) for i in range(500)]
    known = contamination.Automaton(items)
    windows = 500 * 391
    assert sum(map(len, known.keys)) <= 10 * windows  # eight bytes each
    text = "x " + " ".join(items[7][1].split()[100:150]) + " y"
    (edges, ids), none = known.scan([contamination.words_of(text), [b"word1"] * 50])
    assert ids == {7} and (edges.cumsum()[:-1] > 0).sum() == 50 and none == (None, set())


def test_spans_are_the_words_in_the_original(spark):
    items = spark.createDataFrame([(1, "Größe 7, ÉTÉ; end")], "item_id long, text string")
    text = "Ach: GRößE 7 -- été... fin. größe 7 ÉTÉ END! Größe 7"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = contamination.contamination(docs, items).collect()[0]
    assert [text[s.start : s.end] for s in row.spans] == ["größe 7 ÉTÉ END"] and row.n_hit == 4


def test_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "three four")], "item_id long, text string")
    assert contamination.contamination(odd_docs, items).count() == odd_docs.count()
    clean = contamination.clean_documents(odd_docs, items)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count() - 1
    assert contamination.contamination(no_docs, items).count() == 0
    assert contamination.clean_documents(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert contamination.digests(contamination.contamination(odd_docs, items.limit(0))).where("contaminated").count() == 0
