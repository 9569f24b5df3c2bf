"""Functions under SQL names against the columns that they stand for."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import clean as C
from shelfwise.functions import registered
from shelfwise.functions import text as T
from shelfwise.operators import features

TEXTS = ["Milk × 6", "6 x 200ml", "1.5 L & more", "20s", "2 x 500g (Frozen)", "1.5kg", "café--Noir!", "", None, "30 s pack", "3x1.25kg", "12", "×&", "0.5l"]


@pytest.fixture
def frame(spark):
    registered.register(spark)
    df = spark.createDataFrame([(i, t, TEXTS[i - 1], float(i - 5), 100.0 * (i % 4)) for i, t in enumerate(TEXTS)], "i int, t string, u string, x double, g double")
    df.createOrReplaceTempView("texts")
    return df


def test_functions_equal_columns(spark, frame):
    t, size = F.col("t"), T.size_of(F.col("t"))
    pairs = {
        "slug(t)": C.slugify(t), "normal_text(t)": T.normalize_text(t), "size_total(t)": size["total"], "size_unit(t)": size["unit"], "weight_g(t)": T.weight_g(t),
        "price_text(x)": C.currency(F.col("x")), "name_ratio(t, u)": T.indel_ratio(t, F.col("u")), "deal(x, x * 4, 1.5)": features.deal_status(F.col("x"), F.col("x") * 4, F.lit(1.5)),
        "unit_price(x, g)": F.round(F.col("x") / F.nullif("g", F.lit(0.0)) * 100, 4),
    }
    for call, column in pairs.items():
        got = [r[0] for r in spark.sql(f"SELECT {call} FROM texts ORDER BY i").collect()]
        assert got == [r[0] for r in frame.select("i", column.alias("c")).orderBy("i").select("c").collect()], call


def test_sql_functions_are_expressions(spark, frame):
    plan = spark.sql("SELECT slug(t), weight_g(t), deal(x, g, 1) FROM texts")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    registered.register(spark)  # again in the same session
