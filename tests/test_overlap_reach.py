import datetime as dt
import itertools
import random

import pytest

from aislemetrics.operators import overlap, reach

DAY = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    rows = [
        (rng.randrange(40), rng.choice([None, *range(25)]), f"p{rng.randrange(12)}", rng.choice("12"),
         DAY + dt.timedelta(days=rng.randrange(3)))
        for _ in range(300)
    ]
    schema = "transaction_fid long, card_id long, prod_code string, format_code string, date_id date"
    return rows, spark.createDataFrame(rows, schema).cache()


GROUPS = [
    overlap.ProductGroup("any", ["p0", "p1"]),
    overlap.ProductGroup("small, day 1", ["p1", "p2", "p3"], "1", [DAY]),
    overlap.ProductGroup("two days", ["p3", "p4"], None, [DAY, DAY + dt.timedelta(days=1)]),
    overlap.ProductGroup("nobody", ["p99"], "2"),
]


def _buyers(rows, group):
    return {
        card
        for _, card, code, fmt, day in rows
        if card is not None
        and code in group.products
        and group.fmt in (None, fmt)
        and (not group.dates or day in group.dates)
    }


def test_overlap_equals_set_intersection(spark, lines):
    rows, items = lines
    control = overlap.control_table(spark, GROUPS)
    found = overlap.customer_overlap(items, control, [g.name for g in GROUPS])
    counts = {r.comb_flag: (r.comb_size, r.n_custs) for r in found.collect()}
    wanted = {}
    for size in range(1, 5):
        for combo in itertools.combinations(GROUPS, size):
            shared = set.intersection(*(_buyers(rows, g) for g in combo))
            wanted[" , ".join(g.name for g in combo)] = (size, len(shared))
    assert counts == wanted
    assert counts["any , nobody"] == (2, 0)


def test_adding_a_group_never_adds_customers(spark, lines):
    _, items = lines
    control = overlap.control_table(spark, GROUPS)
    found = overlap.customer_overlap(items, control, [g.name for g in GROUPS]).collect()
    counts = {frozenset(r.comb_flag.split(" , ")): r.n_custs for r in found}
    for small, large in itertools.product(counts, counts):
        if small < large:
            assert counts[large] <= counts[small]


def test_overlap_refuses_too_many_groups(lines):
    _, items = lines
    with pytest.raises(ValueError):
        overlap.combination_counts(items, [str(i) for i in range(17)])
    masks = items.selectExpr("card_id", "shiftleft(1L, cast(card_id % 40 as int)) | 1L AS mask").filter("mask > 0").distinct()
    pairs = overlap.combination_counts(masks, [f"g{i}" for i in range(40)], max_size=2).collect()
    assert {r.comb_size for r in pairs} == {1, 2} and {r.n_custs for r in pairs if r.comb_flag == "g0"} == {masks.count()}


def test_sixteen_groups_with_every_mask(spark):
    masks = spark.range(1, 1 << 16).selectExpr("id AS mask")
    counts = {r.comb_flag: r.n_custs for r in overlap.combination_counts(masks, [f"g{i}" for i in range(16)]).collect()}
    assert len(counts) == (1 << 16) - 1
    assert all(n == 1 << (16 - len(flag.split(" , "))) for flag, n in counts.items())


def _greedy(sets, n_top, top_k):
    """The exhaustive rule: count the keys of every candidate together with the picks."""
    products, chosen, report = sorted(set().union(*sets)), [], []
    for step in range(1, n_top + 1):
        counts = [(-sum(bool(s & {*chosen, c}) for s in sets), c) for c in products if c not in chosen]
        if not counts:
            break
        counts.sort()
        report += [(step, i + 1, c, -n) for i, (n, c) in enumerate(counts[:top_k])]
        chosen.append(counts[0][1])
    return report


@pytest.mark.parametrize("key", ["transaction_fid", "card_id"])
def test_greedy_equals_exhaustive_rule(spark, lines, key):
    rows, items = lines
    products = spark.createDataFrame([(f"p{i}",) for i in range(12)], "prod_code string")
    tokens = reach.token_sets(items, products, key, "prod_code")
    sets = {}
    for basket, card, code, _, _ in rows:
        owner = basket if key == "transaction_fid" else card
        if owner is not None:
            sets.setdefault(owner, set()).add(code)
    assert {r[0]: set(r[1]) for r in tokens.collect()} == sets
    # More steps than products, past the write-out of open sets.
    found = [tuple(r) for r in reach.greedy_candidates(tokens, 20, 3).collect()]
    assert found == _greedy(list(sets.values()), 20, 3)


LIMITS = [
    ("nested", {}),
    ("even", {"MOST_CANDIDATES": 5}),
    ("skewed", {"BUFFER": 6}),
    ("skewed", {"MOST_MASKS": 70, "SAFE_CANDIDATES": 6, "PAIRS_PER_FOLDER": 200}),
]


@pytest.mark.parametrize(("shape", "limits"), LIMITS, ids=str)
def test_lazy_bounds_change_no_pick(spark, monkeypatch, limits, shape):
    """Rounds of few candidates, few bounds held, too many combinations, an index in folders."""
    for name, value in limits.items():
        monkeypatch.setattr(reach, name, value)
    rng = random.Random(8)
    products = [f"p{i:02}" for i in range(15)]
    if shape == "nested":  # equal gains, and nothing left after the first pick
        sets = [set(products[: 1 + i % 15]) for i in range(45)]
    else:
        weights = [1 / (1 + i) if shape == "skewed" else 1 for i in range(15)]
        sets = [set(rng.choices(products, weights, k=rng.randrange(1, 5))) for _ in range(120)]
    tokens = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "transaction_fid long, set_cat array<string>")
    found = [tuple(r) for r in reach.greedy_candidates(tokens, 18, 2, shape == "even").collect()]
    assert found == _greedy(sets, 18, 2)


def test_a_round_reads_only_its_products(spark, monkeypatch):
    monkeypatch.setattr(reach, "PAIRS_PER_FOLDER", 100)
    pairs = spark.range(4000).selectExpr("id AS set_id", "concat('p', id % 40) AS product", "1L AS n")
    index = reach._Postings(pairs)
    plan = index.of(["p7"])._jdf.queryExecution().executedPlan().toString()
    assert index.folders == 40 and "PartitionFilters: [isnotnull(folder" in plan.replace("folder#", "folder")
    assert index.of(["p7"]).count() == 100


def test_reach_level_and_ties(spark):
    items = spark.createDataFrame([(1, "b1"), (2, "a1"), (2, "a2"), (3, "c1")], "transaction_fid long, prod_code string")
    products = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C")], "prod_code string, lvl string")
    tokens = reach.token_sets(items, products, "transaction_fid", "lvl")
    assert [tuple(r) for r in reach.greedy_reach(tokens, 3).collect()] == [(1, "A", 1), (2, "B", 2), (3, "C", 3)]
    with pytest.raises(ValueError):
        reach.token_sets(items, products, "store_id", "lvl")
