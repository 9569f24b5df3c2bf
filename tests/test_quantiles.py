"""Exact quantiles against sorting, in one pass and in several."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import features, quantiles, reports

AT = [0.0, 0.25, 0.5, 0.9, 1.0]


def plain(values):
    values = sorted(values)
    out = []
    for q in AT:
        p = q * (len(values) - 1)
        low, high = math.floor(p), math.ceil(p)
        a, b = values[low], values[high]
        out.append(a if low == high or a == b else (high - p) * a + (p - low) * b)
    return out


def cases(r):
    return {
        "even": [r.uniform(-5, 5) for _ in range(900)],
        "far": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(700)] + [0.0] * 40 + [5e-324, -5e-324, float("inf"), float("-inf")],
        "hot": [7.25] * 800 + [7.25 + 2.0**-50, 7.0, 9.0],
        "near": [1 + i * 2.0**-52 for i in range(600)],
        "one": [3.5],
        None: [float(r.randint(-3, 3)) for _ in range(50)],
    }


@pytest.mark.parametrize("small", [100_000, 20, 1])
def test_quantiles_equal_those_of_sorted_values(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    groups = cases(random.Random(small))
    rows = [(g, v, -v) for g, vs in groups.items() for v in vs] + [("even", None, 2.5), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {(r.g, r.column): r for r in quantiles.quantiles(df, ["x", "y"], AT, ["g"]).collect()}
    assert set(got) == {(g, c) for g in groups for c in "xy"}
    for g, vs in groups.items():
        assert got[g, "x"].n == len(vs) and got[g, "x"].q == plain(vs)
        assert got[g, "y"].q == plain([-v for v in vs] + [2.5] * (g == "even"))


def test_all_rows_at_once(spark):
    values = np.random.default_rng(1).lognormal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = quantiles.quantiles(df, ["x"], [0.25, 0.5]).collect()
    assert len(got) == 1 and np.allclose(got[0].q, np.quantile(values, [0.25, 0.5]), rtol=1e-14)
    assert quantiles.quantiles(df.limit(0), ["x"], [0.5]).collect() == []


def test_keys_never_fall(spark):
    values = sorted({*(10.0 ** random.Random(2).uniform(-320, 308) for _ in range(3000)), *(2.0**e * f for e in range(-60, 60) for f in (1 - 2**-53, 1.0, 1 + 2**-52)), 0.0, float("inf")})
    values = [-v for v in reversed(values)] + values
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").coalesce(1)
    keys = [r.k for r in df.select("i", quantiles.monotone_key(F.col("v")).alias("k")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(keys, keys[1:]))


def test_no_task_sees_more_than_a_cells_counts(spark, monkeypatch):
    """What is left to sort after the passes: the counts of small cells, though one value fills most of the table."""
    monkeypatch.setattr(quantiles, "SMALL", 50)
    sorted_rows = []
    picked = quantiles._picked

    def watched(values, wanted, keys, scale):
        kept = quantiles._kept(values, wanted, keys, scale).groupBy(*keys, "cell").agg(F.count_distinct("value").alias("n"))
        sorted_rows.append(kept.agg(F.max("n")).first()[0])
        return picked(values, wanted, keys, scale)

    monkeypatch.setattr(quantiles, "_picked", watched)
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 12.5).otherwise(F.exp(F.rand(3) * 20)).alias("x"))
    quantiles.quantiles(rows, ["x"], [0.25, 0.5, 0.75]).collect()
    assert sorted_rows[0] <= 50


def test_reports_use_exact_quantiles(spark):
    """No plan of these gathers a column's values in one aggregate."""
    df = spark.createDataFrame([(float(i), float(i % 7), 0.1 * i, 2 + i % 3, "t") for i in range(50)], "mean_price double, price_range double, cv double, num_stores int, tier string")
    for out in (features.within_fences(df, ["mean_price", "cv"]), reports.described(df, ["cv"]), reports.tier_summary(df)):
        assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    row = reports.described(df, ["cv"]).first()
    assert (row.q1, row.median, row.q3) == tuple(np.round(np.quantile([0.1 * i for i in range(50)], [0.25, 0.5, 0.75]), 3))
