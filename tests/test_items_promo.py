import pytest

from aislemetrics.operators import items
from aislemetrics.operators.promo import promo_rollup


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [(1, 10, "p1", 1, 199701), (2, None, "p1", 1, 199702), (3, 11, "p2", 2, 199702), (4, 12, "p3", 2, 199701)],
        "transaction_fid long, card_id long, prod_code string, store_id long, fis_week_id int",
    )


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([(10, "Shopper"), (11, "Trader"), (12, None)], "card_id long, kptr_seg string")


def test_tags_keep_every_line(sales, tags):
    tagged = {r.transaction_fid: r.kptr_seg for r in items.tag_customers(sales, tags).collect()}
    assert tagged == {1: "Shopper", 2: None, 3: "Trader", 4: None}


def test_unknown_tags_are_not_end_customers(sales, tags):
    kept = items.end_customers(items.tag_customers(sales, tags)).collect()
    assert [r.transaction_fid for r in kept] == [1]


def test_product_filter_takes_code_list_or_frame(spark, sales):
    products = spark.createDataFrame([("p1",), ("p1",), ("p2",)], "prod_code string")
    for codes in ("p1", ["p1", "p3"], spark.createDataFrame([("p1",), ("p3",)], "prod_code string")):
        assert items.filter_products(sales, products, codes).count() == 2


def test_slice(spark, sales):
    stores = spark.createDataFrame([(1, "1"), (2, "2")], "store_id long, format_code string")
    sliced = items.item_slice(sales, 199702, 199702, stores=stores, formats="2")
    assert [r.transaction_fid for r in sliced.collect()] == [3]


def test_like_for_like(sales):
    assert {r.store_id for r in items.like_for_like_stores(sales).collect()} == {1, 2}
    assert {r.store_id for r in items.like_for_like_stores(sales.filter("transaction_fid <> 2")).collect()} == {2}


@pytest.fixture(scope="module")
def hierarchy(spark):
    return spark.createDataFrame(
        [("a1", "A", "c1"), ("a2", "A", "c1"), ("a3", "A", "c2"), ("b1", "B", "c2"), ("z1", "Z", "c3")],
        "prod_code string, prod_hier_l10_code string, prod_hier_l20_code string",
    ).selectExpr("*", "prod_hier_l10_code AS prod_hier_l10_desc", "prod_hier_l20_code AS prod_hier_l20_desc")


def test_rollup_takes_whole_nodes(spark, hierarchy):
    # A repeated code must not count twice.
    promo = spark.createDataFrame([("a1",), ("a1",), ("b1",)], "prod_code string")
    rolled = promo_rollup(hierarchy, promo, "subclass")
    assert sorted(r.prod_code for r in rolled.products.collect()) == ["a1", "a2", "a3", "b1"]
    share = [tuple(r) for r in rolled.share.collect()]
    # All of B is promoted: its other cell, total and percent are null, and it sorts last.
    assert share == [("A", "A", 1, 2, 3, 33.33), ("B", "B", 1, None, None, None)]


def test_zero_fill_and_levels(spark, hierarchy):
    promo = spark.createDataFrame([("b1",)], "prod_code string")
    share = [tuple(r) for r in promo_rollup(hierarchy, promo, "subclass", zero_fill=True).share.collect()]
    assert share == [("B", "B", 1, 0, 1, 100.0)]
    assert promo_rollup(hierarchy, promo, "class").products.count() == 2
    assert promo_rollup(hierarchy, promo, "product").products.collect() == promo.collect()
    with pytest.raises(ValueError):
        promo_rollup(hierarchy, promo, "division")
