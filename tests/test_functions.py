"""Column functions against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import clean as C
from shelfwise.functions import text as T
from shelfwise.functions import vocabulary as V
from shelfwise.operators import features


def value(spark, column, **inputs):
    kinds = {str: "string", float: "double", int: "long", type(None): "string"}
    row = spark.range(1).select(*[F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in inputs.items()])
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("6 x 200ml", (1200.0, "ml", 6, "6 x 200ml", 200.0)),
        ("1.5L", (1500.0, "ml", 1, "1.5l", 1500.0)),
        ("20 s", (20.0, "count", 20, "20s", 1.0)),
        ("1 L", (1000.0, "ml", 1, "1l", 1000.0)),
        ("100 lemons", (100000.0, "ml", 1, "100l", 100000.0)),
        ("abc", (None,) * 5),
        ("", (None,) * 5),
        (None, (None,) * 5),
    ],
)
def test_size(spark, text, expected):
    assert tuple(value(spark, T.size_of(F.col("t")), t=text)) == expected


@pytest.mark.parametrize("given, expected", [("0", None), ("-1.5", -1.5), ("x", None), (None, None), ("0.126", 0.13)])
def test_discount(spark, given, expected):
    assert value(spark, C.clean_discount(F.col("d")), d=given) == expected


@pytest.mark.parametrize("store, expected", [("fairprice", 4.0), ("redmart", 5.0)])
def test_reconciled_price(spark, store, expected):
    got = value(spark, C.reconcile_price(F.col("s"), F.col("p"), F.col("o"), F.col("d")), s=store, p=5.0, o=5.0, d=1.0)
    assert got == expected


@pytest.mark.parametrize("store, url, expected", [("shengsiong", "/p/1", V.RELATIVE_URL_BASE + "/p/1"), ("redmart", "https://a/b?x=1#f", "https://a/b"), ("fairprice", "https://a/b?x=1", "https://a/b?x=1"), ("redmart", "", None), ("redmart", None, None)])
def test_url(spark, store, url, expected):
    assert value(spark, C.clean_product_url(F.col("u"), F.col("s")), u=url, s=store) == expected


def test_text(spark):
    assert value(spark, T.normalize_text(F.col("t")), t="A×B & c-d (É)") == "a x b and c d"
    assert value(spark, C.slugify(F.col("t")), t="--A  b!") == "a-b"
    assert value(spark, C.slugify(F.col("t")), t="é") == "unknown"
    assert value(spark, C.title_case(F.col("t")), t=" don't  a-b ") == "Don'T A-B"
    assert value(spark, C.number_fragment(F.col("t")), t=1.5) == "1p5"
    assert value(spark, C.number_fragment(F.col("t")), t=3.0) == "3"
    assert value(spark, C.unit_from_name(F.col("t")), t="Milk 2 x 1.5L Pack") == "1.5L Pack"
    assert value(spark, C.source_image_url(F.col("t")), t="https://i/x?url=https%3A%2F%2Fa%2Fb&w=1") == "https://a/b"
    assert value(spark, T.strip_labels(T.normalize_text(F.col("t"))), t="Pasar SG Local Kailan") == "kailan"
    assert value(spark, T.cut_of(T.normalize_loose(F.col("t"))), t="Pineapple Slices") == "fruit - apple"
    assert value(spark, T.variants(T.normalize_text(F.col("t")), V.MEAT_VARIANTS), t="chicken boneless skin on") == ["bone in", "skin on"]


@pytest.mark.parametrize("a, b, expected", [("kitten", "sitting", 8 / 13), ("abc", "abc", 1.0), ("", "abc", 0.0), ("", "", 1.0), ("ab", "cd", 0.0)])
def test_indel_ratio(spark, a, b, expected):
    assert value(spark, T.indel_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(expected)


def test_advice_and_deals(spark):
    assert value(spark, features.shopping_advice(F.lit("Budget"), F.lit(0.2), F.lit(1))) == features.ADVICE["single"]
    assert value(spark, features.shopping_advice(F.lit("Premium"), F.lit(0.2), F.lit(3))) == features.ADVICE["Premium", True]
    assert value(spark, features.deal_status(F.lit(-1.0), F.lit(-6.0), F.lit(0.3))) == "Good deal"
    assert value(spark, features.deal_status(F.lit(-1.0), F.lit(-4.0), F.lit(0.3))) == "Normal price"
