import random

from aislemetrics.llm import preference

TURN = "array<struct<role: string, text: string>>"


def rendered(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_longest_common_prefix_against_a_loop(spark):
    rng = random.Random(4)
    side = lambda: [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", ""])) for _ in range(rng.randint(0, 5))]
    pairs = [(i, side(), side()) for i in range(150)]
    pairs += [(200, x, x) for x in [[("user", "é🎉"), ("assistant", "z")]]]
    frame = spark.createDataFrame(pairs, f"pair_id long, chosen {TURN}, rejected {TURN}")
    rows = {r.pair_id: r for r in preference.preference_rows(frame).collect()}
    assert len(rows) == len(pairs)
    for pair, chosen, rejected in pairs:
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        row = rows[pair]
        assert (row.n_shared, row.prompt) == (n, rendered(chosen[:n]))
        for text, mask, turns in ((row.chosen, row.chosen_mask, chosen[n:]), (row.rejected, row.rejected_mask, rejected[n:])):
            assert text == rendered(turns)
            assert [text[s.start : s.end] for s in mask] == [t for r, t in turns if r == "assistant"]


def test_swapped_replies(spark):
    turns = [
        (1, 5, "assistant", "late"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 9, "user", "bye"),
        (2, 0, None, "q2"), (2, 1, "assistant", None), (2, 1, "assistant", None),
        (3, 0, "user", "never answered"), (64, 0, "assistant", "alone"),
        (None, 0, "user", "x"), (1, None, "user", "x"),
        (4, 0, "assistant", "b"), (4, 0, "assistant", "a"),
    ]
    frame = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, chosen string")
    rows = {r.pair_id: r for r in preference.with_swapped_replies(preference.conversations(frame)).collect()}
    assert set(rows) == {1, 2, 4, 64}
    assert [tuple(t) for t in rows[1].chosen] == [("user", "q1"), ("assistant", "a1"), ("assistant", "late")]
    assert [tuple(t) for t in rows[1].rejected] == [("user", "q1"), ("assistant", "a1"), ("assistant", "")]
    assert [tuple(t) for t in rows[2].chosen] == [("unknown", "q2"), ("assistant", "")]
    assert [tuple(t) for t in rows[4].chosen] == [("assistant", "a")] and [tuple(t) for t in rows[4].rejected] == [("assistant", "alone")]
    assert [tuple(t) for t in rows[64].chosen] == [("assistant", "alone")] and [tuple(t) for t in rows[64].rejected] == [("assistant", "late")]
    none = preference.with_swapped_replies(preference.conversations(frame.limit(0)))
    assert preference.digests(preference.preference_rows(none)).count() == 0


def test_sparse_ids_never_borrow_from_themselves(spark):
    """Ids a hundred apart, over many ranges: everyone has the next one's reply, the last the first one's."""
    frame = spark.range(0, 40_000, 100).selectExpr("id AS conv_id", "1L AS turn", "'assistant' AS role", "concat('r', id) AS text")
    pairs = preference.with_swapped_replies(preference.conversations(frame.repartition(11)))
    found = {r.pair_id: (r.chosen[0].text, r.rejected[0].text) for r in pairs.collect()}
    assert found == {i: (f"r{i}", f"r{(i + 100) % 40_000}") for i in range(0, 40_000, 100)}


def test_a_long_conversation(spark):
    text = "é" * 300_000
    frame = spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", text + "!"), (2, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    pairs = preference.with_swapped_replies(preference.conversations(frame))
    row = next(r for r in preference.preference_rows(pairs).collect() if r.pair_id == 1)
    assert row.n_shared == 1 and text in row.prompt and row.chosen[row.chosen_mask[0].start : row.chosen_mask[0].end] == text + "!"
