"""Models on product features: price tiers, anomalies and price prediction.

K-means is MLlib's; random forests are those of ``forest``. Isolation forests are built here: every tree on its
own small random sample, trees in parallel, scores by a function that all tasks share.
"""

from __future__ import annotations

import hashlib
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.steps import written
from .forest import RandomForestRegressor
from .quantiles import quantiles

TIERS = ("Budget", "Mid-range", "Premium")
TIER_FEATURES = ["mean_price", "median_price"]
ANOMALY_FEATURES = ["mean_price", "price_range", "cv", "num_stores"]
PRICE_FEATURES = ["category_code", "store_code", "month", "weekday", "day", "prev_price", "mean_3"]


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``scaled``: the columns with mean 0 and deviation 1."""
    raw = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df)
    return StandardScaler(inputCol="_raw", outputCol="scaled", withMean=True, withStd=True).fit(raw).transform(raw).drop("_raw")


#: Fits that run at the same time, and rows of points that make a part: a start is a series of short jobs.
AT_ONCE, POINTS = 8, 200_000


def _points(df: DataFrame) -> DataFrame:
    """The scaled points alone, written once, in parts of about ``POINTS`` rows and no more than Spark reads them in."""
    points = written(df.select("scaled"))
    return points.coalesce(max(1, -(-points.count() // POINTS))).persist()


def best_kmeans(df: DataFrame, k: int, starts: int = 10, seed: int = 42):
    """The model of least cost among several starts, of which some run at the same time."""
    fit = inheritable_thread_target(df.sparkSession)(lambda i: KMeans(k=k, featuresCol="scaled", predictionCol="cluster", seed=seed + i).fit(df))
    with ThreadPool(min(AT_ONCE, starts)) as pool:
        models = pool.map(fit, range(starts))
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans_sweep(features: DataFrame, ks=range(2, 9), starts: int = 10) -> DataFrame:
    """Cost and silhouette by number of clusters."""
    df = _points(scaled(written(features), TIER_FEATURES))
    try:
        rows = []
        for k in ks:
            m = best_kmeans(df, k, starts)
            score = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster").evaluate(m.transform(df))
            rows.append((k, float(m.summary.trainingCost), float(score)))
        return features.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")
    finally:
        df.unpersist()


def kmeans_tiers(features: DataFrame, starts: int = 10) -> DataFrame:
    """Features with cluster and tier; tiers are the clusters by ascending mean price."""
    df = scaled(written(features), TIER_FEATURES)
    points = _points(df)
    try:
        model = best_kmeans(points, len(TIERS), starts)
    finally:
        points.unpersist()
    out = model.transform(df).drop("scaled")
    ranks = out.groupBy("cluster").agg(F.avg("mean_price").alias("m")).withColumn("r", F.row_number().over(Window.orderBy("m")))
    return out.join(F.broadcast(ranks.drop("m")), "cluster").withColumn("tier", F.element_at(F.array(*map(F.lit, TIERS)), F.col("r"))).drop("r")


def _path(n) -> np.ndarray:
    """Mean depth of a search tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def draw(*parts) -> float:
    """A number from 0 up to 1 that depends on the parts alone: the start of the MD5 of their text."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2.0**32


def _grow(x: np.ndarray, seed: int, tree: int, most: int) -> list[tuple[int, float, int, int, float]]:
    """An isolation tree as rows (feature, limit, left, right, depth); leaves have feature -1.

    A node's number tells its place: the root is 1, those below node i are 2 i and 2 i + 1. By seed, tree
    and number it draws its feature, of those whose values differ, and its limit between their ends.
    """
    nodes: list = []

    def grow(rows: np.ndarray, depth: int, number: int) -> int:
        me = len(nodes)
        nodes.append(None)
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        open_ = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(open_):
            nodes[me] = (-1, 0.0, 0, 0, depth + float(_path(len(rows))))
            return me
        f = int(open_[int(draw(seed, tree, number, "feature") * len(open_))])
        limit = float(low[f] + draw(seed, tree, number, "limit") * (high[f] - low[f]))
        left = grow(rows[rows[:, f] < limit], depth + 1, 2 * number)
        right = grow(rows[rows[:, f] >= limit], depth + 1, 2 * number + 1)
        nodes[me] = (f, limit, left, right, 0.0)
        return me

    grow(x, 0, 1)
    return nodes


def _flat(tree: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features, limits, both nodes below each node in turn, and depths; leaves stand above themselves."""
    feature, limit, left, right, depth = (tree[:, i] for i in range(5))
    leaf, me = feature < 0, np.arange(len(tree))
    below = np.column_stack([np.where(leaf, me, left), np.where(leaf, me, right)]).astype(np.intp).ravel()
    return np.where(leaf, 0, feature).astype(np.intp), limit.copy(), below, depth.copy()


def _depths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    feature, limit, below, depth = _flat(tree)
    n, width = x.shape
    values, first = np.ascontiguousarray(x).ravel(), np.arange(n) * width
    at = np.zeros(n, np.intp)
    while True:
        left = values.take(first + feature.take(at)) < limit.take(at)  # NaN goes right
        new = below.take(2 * at + ~left)
        # a node's number is below those of the nodes under it, so nothing moves only where all rows stand in leaves
        if np.array_equal(new, at):
            return depth.take(at)
        at = new


def isolation_forest(features: DataFrame, key: str = "canonical_product_id", trees: int = 200, sample: int = 256, contamination: float = 0.03, seed: int = 42) -> DataFrame:
    """Features with anomaly score (lower is odder) and flag (-1 for the share ``contamination`` of rows).

    Each tree's sample is the rows with the smallest hashes of seed, tree and key, so it is the same
    however the rows are dealt. A forest is bounded by trees and sample, whatever the number of rows.
    Features count to six places and scores to nine, so last digits of means decide nothing.
    """
    columns = ANOMALY_FEATURES
    features = written(features)
    spark, n = features.sparkSession, features.count()
    size = min(sample, n)
    if not size:
        return features.withColumns({"score": F.lit(0.0), "flag": F.lit(1)})
    # a few times the sample by a hash limit, then exactly the smallest; a row stands only in the trees that draw it
    share = int(min(1.0, 4.0 * size / n) * (1 << 32)) + 1
    places = lambda c: F.round(F.col(c).cast("double"), 6)
    # exploded and filtered in compiled code; a digest is below a limit of eight digits if its first eight digits are
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tree").cast("string"), F.col("_key")))
    trees_of = features.select(key, *[places(c).alias(c) for c in columns], F.col(key).cast("string").alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    drawn = trees_of if share >= 1 << 32 else trees_of.filter(draw < f"{share:08x}")
    rows = drawn.select(key, *columns, "tree", draw.alias("draw"))
    most = int(np.ceil(np.log2(max(2, size))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["draw", key]).head(size)
        found = _grow(pdf[columns].to_numpy(float), seed, t, most)
        return pd.DataFrame(found, columns=["feature", "split", "below", "above", "depth"]).assign(tree=t, node=range(len(found)))

    schema = "feature int, split double, below int, above int, depth double, tree int, node int"
    got = rows.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])  # trees * 2 * sample rows at most
    forest = spark.sparkContext.broadcast([g[["feature", "split", "below", "above", "depth"]].to_numpy(float) for _, g in got.groupby("tree")])
    norm = max(float(_path(size)), 1e-9)

    @F.pandas_udf("double")
    def anomaly(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        return pd.Series(-(2.0 ** (-np.mean([_depths(t, x) for t in forest.value], axis=0) / norm)))

    scored = written(features.withColumn("raw_score", F.round(anomaly(*[places(c) for c in columns]), 9)))
    limit = quantiles(scored, ["raw_score"], [contamination]).select(F.round(F.col("q")[0], 9).alias("_limit"))  # one row
    out = scored.crossJoin(F.broadcast(limit))
    return out.withColumns({"score": F.col("raw_score") - F.col("_limit"), "flag": F.when(F.col("raw_score") < F.col("_limit"), -1).otherwise(1)}).drop("raw_score", "_limit")


def price_model(series: DataFrame, trees: int = 200, depth: int = 12):
    """Random forest on series features with ``is_train``; returns the model and predictions of the other rows."""
    rows = series.withColumnsRenamed({"unified_category_code": "category_code"}).dropna(subset=["price_sgd", *PRICE_FEATURES])
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, inputCols=PRICE_FEATURES, labelCol="price_sgd", predictionCol="predicted_price", seed=42).fit(rows.filter("is_train"))
    out = model.transform(rows.filter("not is_train"))
    error = F.col("price_sgd") - F.col("predicted_price")
    return model, out.withColumns({"error": error, "abs_error": F.abs(error)})


def stored_predictions(existing: DataFrame, predictions: DataFrame, run_date: str) -> DataFrame:
    """The table of predictions after a run: one row per product, store and date, the run's in place of older ones.

    Of repeated rows of a run the one with the smallest product_id counts.
    """
    keys = ["canonical_product_id", "store", "scraped_date_sg"]
    error = F.col("price_sgd") - F.col("predicted_price")
    new = predictions.withColumns({"error": error, "abs_error": F.abs(error), "model_run_date": F.lit(run_date)})
    return sinks.upsert(existing, sinks.first_per_key(new, keys, ["product_id"]).select(*existing.columns), keys, ["price_sgd"])
