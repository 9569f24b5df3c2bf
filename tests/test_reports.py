"""Reports, filters, sources and sinks on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import clean as C
from shelfwise.operators import features, learn, reports
from shelfwise.sources import listings, sinks


@pytest.mark.parametrize(
    "text, want",
    [
        ("Save $1.00\nFresh Milk\n$3.50", ("Fresh Milk", 3.5, None, None, None)),
        ("Tea\nOrganic\nLong Leaf Description Line\n$2.00", ("Organic", 2.0, None, None, None)),
        (" $2.50 \n$3.00\nPasar Kailan\n220 g\n$1.14/100g\n(12)", ("Pasar Kailan", 2.5, 3.0, 0.5, "220 g")),
        ("Buy 2\n4.5\n3D\nCoke Zero\n12 x 320 ml\n$9", ("Coke Zero", 9.0, None, None, "12 x 320 ml")),
        ("Sold out\n$4", None),
        ("Only a name", None),
        ("", None),
        (None, None),
    ],
)
def test_lines(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(listings.from_lines(F.col("t")).alias("r")).first().r
    assert (row and tuple(row[c] for c in ("name", "price_sgd", "original_price_sgd", "discount_sgd", "unit"))) == want


def test_processed_files(spark, tmp_path):
    for store, price in (("redmart", 2.5), ("fairprice", None)):
        folder = tmp_path / store / "2026-04-01"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(json.dumps([{"name": "Milk", "store": store, "price_sgd": price, "scraped_at": "2026-04-01T10:00:00"}]))
    (tmp_path / "redmart" / "2026-04-02").mkdir()
    read = lambda day, stores: sorted((r.store, r.price_sgd) for r in listings.processed_listings(spark, str(tmp_path), day, stores).collect())
    assert read("2026-04-01", ["redmart", "fairprice", "shengsiong"]) == [("fairprice", None), ("redmart", 2.5)]
    assert read("2026-04-02", ["redmart"]) == [] and read("2026-04-03", ["redmart"]) == []


def test_caps_urls_and_categories(spark):
    rows = [("a", "fruit", i, f"/{i % 3}", "n", 1.0) for i in range(5)] + [("b", "fruit", 9, "/9", None, 1.0), ("b", "meat", 8, None, "n", 1.0)]
    df = spark.createDataFrame(rows, "store string, category_slug string, id int, product_url string, name string, price_sgd double")
    assert sorted(r.id for r in listings.capped(df, ["id"], 2).collect()) == [0, 1, 8, 9]
    assert sorted(r.id for r in listings.first_by_url(df, ["id"]).collect()) == [0, 1, 2]
    assert [r.id for r in listings.in_categories(df, ["meat"]).collect()] == [8] and listings.in_categories(df, None).count() == 7


def test_validated(spark):
    df = spark.createDataFrame([("  Oat   milk ", "1,200.50", "1300", None), ("", "x", None, "2")], "name string, price_sgd string, original_price_sgd string, discount_sgd string")
    assert [tuple(r) for r in listings.validated(df).collect()] == [("Oat milk", 1200.5, 1300.0, 99.5), (None, None, None, 2.0)]


def test_sorted_table_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0), (4, 5.0)], "id int, v double")
    assert [r.id for r in reports.sorted_table(df, v=True, id=False).collect()] == [3, 2, 4, 1]
    assert [r.id for r in reports.sorted_table(df, v=False, id=True).collect()] == [4, 2, 3, 1]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Milo Tin", "Beverages"), (2, None, "Beverages"), (3, "milo bar", None), (4, "Tea", "Fresh")], "id int, canonical_name string, unified_category string")
    ids = lambda **k: sorted(r.id for r in reports.filtered(df, **k).collect())
    assert ids() == [1, 2, 3, 4] and ids(search="MILO") == [1, 3] and ids(search="^tea$") == [4]
    assert ids(unified_category="Beverages") == [1, 2] and ids(without={"unified_category": ["Fresh"]}) == [1, 2, 3] and ids(unified_category=None) == [1, 2, 3, 4]


def test_fences_come_from_all_rows(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(1, 9)] + [(9, 100.0, 1.0), (10, 4.0, 50.0)], "id int, x double, y double")
    assert sorted(r.id for r in features.within_fences(df, ["x", "y"]).collect()) == list(range(1, 9))
    assert features.within_fences(df.filter("id < 0"), ["x"]).count() == 0


def test_names_are_joined_once_and_nameless_rows_go(spark):
    rows = spark.createDataFrame([(1, "Budget"), (2, "Premium"), (3, "Budget"), (None, "Budget")], "canonical_product_id int, tier string")
    names = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (3, None, 1), (None, "n", 1)], "canonical_product_id int, canonical_name string, no int")
    assert [tuple(r) for r in reports.with_names(rows, names, ["canonical_name"], ["no"]).collect()] == [(1, "Budget", "a")]


def test_predictions_replace_older_ones(spark):
    old = spark.createDataFrame([(1, "a", "d", 2.0, 1.0, "r1"), (2, "a", "d", 2.0, 1.0, "r1")], "canonical_product_id int, store string, scraped_date_sg string, price_sgd double, predicted_price double, model_run_date string")
    new = spark.createDataFrame([(1, "a", "d", 2.0, 3.0, "y"), (1, "a", "d", 2.0, 4.0, "x")], "canonical_product_id int, store string, scraped_date_sg string, price_sgd double, predicted_price double, product_id string")
    found = learn.stored_predictions(old, new, "r2").select("canonical_product_id", "predicted_price", "model_run_date").collect()
    assert sorted(map(tuple, found)) == [(1, 4.0, "r2"), (2, 1.0, "r1")]


def test_members_get_ids(spark):
    members = spark.createDataFrame([("k", 1), ("gone", 2)], "canonical_key string, product_id int")
    out = sinks.members_with_ids(members, spark.createDataFrame([("k", 7)], "canonical_key string, id int"), "run", "source").collect()
    assert [(r.product_id, r.canonical_product_id, r.run_key, r.match_source) for r in out] == [(1, 7, "run", "source")]


def test_reports_of_empty_tables(spark):
    none = spark.createDataFrame([], "scraped_date date, cut string, frozen_flag string, unified_category string, cheapest_store string, priciest_store string, cheapest_price_sgd double, price_spread_sgd double")
    assert tuple(reports.commodity_kpis(none).first()) == (0, 0, 0, None, None)
    assert reports.most_competitive(none).count() == 0 and reports.commodity_trend(none).count() == 0
    assert reports.described(none, ["price_spread_sgd"]).first()["count"] == 0


def test_text_of_reports(spark):
    df = spark.createDataFrame([("redmart", 2.5, "Milk", "1L"), ("x", None, "Tea", "—"), (None, 0.0, "Oil", None)], "store string, price double, name string, size string")
    out = df.select(C.labelled(F.col("store"), {"redmart": "RedMart"}), C.currency(F.col("price")), C.with_size(F.col("name"), F.col("size")))
    assert [tuple(r) for r in out.collect()] == [("RedMart", "$2.50", "Milk (1L)"), ("x", "—", "Tea"), (None, "$0.00", "Oil")]
