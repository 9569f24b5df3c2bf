"""The random forest: against MLlib's single tree, however rows are dealt and nodes are grown."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import forest, learn


def table(spark, n=3000):
    r = random.Random(5)
    rows = []
    for i in range(n):
        a, b, c, d = r.randrange(6), r.randrange(20), r.randrange(3), r.gauss(0, 1)
        rows.append((i, a, b, c, d, 10.0 * a + (3.7 * b if a % 2 else -2.3 * b) + (5.1 * c if b > 7 else 0.0) + r.gauss(0, 1)))
    return spark.createDataFrame(rows, "id long, a int, b int, c int, d double, y double")


@pytest.mark.parametrize("local", [1 << 16, 400, 1])
def test_one_tree_is_mllibs(spark, monkeypatch, local):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    monkeypatch.setattr(forest, "LOCAL", local)
    df, columns = table(spark), ["a", "b", "c"]
    tree = DecisionTreeRegressor(maxDepth=4, minInstancesPerNode=2, labelCol="y").fit(VectorAssembler(inputCols=columns, outputCol="features").transform(df))
    mine = forest.RandomForestRegressor(1, 4, 2, columns, "y", "mine").fit(df)
    both = mine.transform(tree.transform(VectorAssembler(inputCols=columns, outputCol="features").transform(df)))
    assert both.agg(F.max(F.abs(F.col("mine") - F.col("prediction")))).first()[0] < 1e-9


def test_nodes_grown_by_all_tasks_are_those_grown_by_one(spark, monkeypatch):
    got = []
    for local, part in ((1 << 16, 1 << 20), (300, 100), (1, 1 << 20)):
        monkeypatch.setattr(forest, "LOCAL", local)
        monkeypatch.setattr(forest, "PART", part)
        found = forest.RandomForestRegressor(6, 6, 2, ["a", "b", "c", "d"], "y", "p").fit(table(spark))
        got.append([r.p for r in found.transform(table(spark)).orderBy("id").collect()])
    assert got[1] == pytest.approx(got[0]) and got[2] == pytest.approx(got[0])


def test_rows_may_be_dealt_as_they_are(spark):
    rows = table(spark, 800).selectExpr("id", "a as category_code", "c as store_code", "b as month", "1 as weekday", "1 as day", "d as prev_price", "d + a as mean_3", "y as price_sgd", "id % 5 > 0 as is_train")
    got = []
    for parts in (1, 5):
        _, out = learn.price_model(rows.repartition(parts), trees=4, depth=5)
        got.append([r.predicted_price for r in out.orderBy("id").collect()])
    assert got[0] == pytest.approx(got[1]) and len(set(got[0])) > 5


def test_rows_are_drawn_with_mean_and_variance_one():
    import numpy as np

    keys = np.arange(200_000, dtype=np.uint64)
    first, second = forest.draws(keys, 42, 0).astype(float), forest.draws(keys, 42, 1).astype(float)
    assert abs(first.mean() - 1) < 0.02 and abs(first.var() - 1) < 0.03 and abs(np.corrcoef(first, second)[0, 1]) < 0.02


def test_few_rows_and_one_value(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "a int, y double")
    assert {r.prediction for r in forest.RandomForestRegressor(1, 3, 2, ["a"], "y").fit(df).transform(df).collect()} == {3.0}
    with pytest.raises(ValueError):
        forest.RandomForestRegressor(3, 3, 2, ["a"], "y").fit(df.limit(0))
