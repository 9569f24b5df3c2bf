"""The models' stored tables, written run by run and read by the stages after them.

Clusters have a row per product, predictions one per product, store and date, metrics one per run; what
a run writes takes the place of older rows of its keys. Deals are told by the newest run's mean error.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import sinks
from ..sources.versions import Table
from . import features, learn

_KINDS = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType()}


def _columns(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in map(str.split, text.split(", "))])


# Columns of the stored tables, and the limit of deals before there is a run.
CLUSTERS = _columns(
    "canonical_product_id bigint, price_tier string, mean_price double, median_price double, min_price double, max_price double, "
    "std_price double, price_range double, cv double, num_observations bigint, num_stores bigint, shopping_advice string"
)
METRICS = _columns("model_run_date string, mae double, rmse double, r2 double")
PREDICTIONS = _columns(
    "canonical_product_id bigint, canonical_name string, unified_category string, store string, scraped_date_sg date, "
    "price_sgd double, predicted_price double, error double, abs_error double, model_run_date string"
)
NO_RUN_LIMIT = 0.3


def run_stamp(at: datetime.datetime | None = None) -> str:
    """The date of a run as tables have it; of now by default."""
    return f"{at or datetime.datetime.now():%Y-%m-%d}"


class ModelTables:
    """Clusters, metrics and predictions below one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.clusters, self.metrics, self.predictions = (Table(spark, f"{base.rstrip('/')}/{name}") for name in ("product_clusters", "price_prediction_metrics", "product_price_predictions"))

    def store_clusters(self, tiers: DataFrame) -> None:
        """Products with tier and features, a row each; of repeated products the first by tier."""
        numbers = {c: F.round(c, 4) for c in ("mean_price", "median_price", "min_price", "max_price", "std_price", "price_range", "cv")}
        advice = features.shopping_advice(F.col("tier"), F.col("cv"), F.col("num_stores"))
        rows = tiers.withColumn("shopping_advice", advice).withColumns(numbers).withColumnsRenamed({"tier": "price_tier", "num_prices": "num_observations"})
        rows = as_stored(rows, CLUSTERS)
        self.clusters.update(lambda known: sinks.upsert(known, rows, ["canonical_product_id"], ["price_tier"]), CLUSTERS)

    def store_run(self, predictions: DataFrame, run_date: str | None = None) -> None:
        """A run's predictions, with actual prices, and its errors over them."""
        run_date = run_date or run_stamp()
        metrics = as_stored(features.regression_metrics(predictions, "price_sgd", "predicted_price").withColumn("model_run_date", F.lit(run_date)), METRICS)
        self.metrics.update(lambda known: sinks.upsert(known, metrics, ["model_run_date"], ["mae"]), METRICS)
        new = lambda known: as_stored(learn.stored_predictions(known, predictions, run_date), PREDICTIONS)
        self.predictions.update(new, PREDICTIONS)

    def newest_metrics(self) -> DataFrame:
        """The row of the newest run, or none."""
        return self.metrics.read(schema=METRICS).orderBy(F.desc("model_run_date")).limit(1)

    def deal_limit(self) -> DataFrame:
        """The newest run's mean error, or NO_RUN_LIMIT before there is one: one row."""
        newest = self.metrics.read(schema=METRICS).agg(F.max_by("mae", "model_run_date").alias("mae"))
        return newest.select(F.coalesce("mae", F.lit(NO_RUN_LIMIT)).alias("deal_limit"))

    def deals(self) -> DataFrame:
        """Stored predictions with difference, percent and kind of deal, from prices in cents as reports show them."""
        cents = lambda c: F.round(F.round(c, 6), 2)
        rows = self.predictions.read(schema=PREDICTIONS).withColumns({c: cents(c) for c in ("price_sgd", "predicted_price")})
        rows = rows.withColumn("difference", cents(F.col("price_sgd") - F.col("predicted_price")))
        rows = rows.withColumn("percent", cents(F.col("difference") / F.nullif("predicted_price", F.lit(0.0)) * 100)).crossJoin(F.broadcast(self.deal_limit()))
        return rows.withColumn("deal", features.deal_status(F.col("difference"), F.col("percent"), F.col("deal_limit"))).drop("deal_limit")


def as_stored(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a stored table, in its order and types."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
