"""Price features of products, fences, tiers, advice, series features and deals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import written
from .numbering import numbered, tile
from .quantiles import quantiles

SERIES = ["canonical_product_id", "store"]

# Labels of reports.

#: Prices vary if their deviation is more than this part of their mean.
VARIED = 0.15
ADVICE = {
    "single": "Only available at one store — no comparison possible",
    ("Budget", True): "Budget product with volatile pricing — compare stores before buying",
    ("Budget", False): "Budget product with stable pricing — consistent across stores",
    ("Mid-range", True): "Mid-range product with price variation — worth checking stores",
    ("Mid-range", False): "Mid-range product with stable pricing — similar across stores",
    ("Premium", True): "Premium product with significant price variation — always compare stores",
    ("Premium", False): "Premium product with consistent pricing across stores",
    "none": "No advice available",
}
SPREADS = ["Spread: Low", "Spread: Medium", "Spread: High"]
#: Deal kinds that reports list even where none occurs.
DEALS = ["Good deal", "Normal price", "Overpriced"]


def product_features(rows: DataFrame, least_stores: int = 2) -> DataFrame:
    """Price statistics of products priced in several stores; deviations of one price are 0.

    Rows are dealt by product before, as partial medians are larger than the prices that they hold.
    """
    used = rows.filter("price_sgd > 0").select("canonical_product_id", "canonical_name", "unified_category", "price_sgd", "store").repartition("canonical_product_id")
    out = used.groupBy("canonical_product_id").agg(
        F.min("canonical_name").alias("canonical_name"), F.min("unified_category").alias("unified_category"), F.avg("price_sgd").alias("mean_price"), F.median("price_sgd").alias("median_price"),
        F.min("price_sgd").alias("min_price"), F.max("price_sgd").alias("max_price"), F.coalesce(F.stddev_samp("price_sgd"), F.lit(0.0)).alias("std_price"), F.count("*").alias("num_prices"), F.size(F.collect_set("store")).cast("long").alias("num_stores"),
    )
    return out.withColumns({"price_range": F.col("max_price") - F.col("min_price"), "cv": F.col("std_price") / F.col("mean_price")}).filter(F.col("num_stores") >= least_stores)


def within_fences(df: DataFrame, columns: list[str], factor: float = 3.0) -> DataFrame:
    """Rows at or below third quartile plus ``factor`` ranges in all columns; fences are from all rows."""
    rows = written(df)
    fence = F.col("q")[1] + factor * (F.col("q")[1] - F.col("q")[0])
    found = quantiles(rows, columns, [0.25, 0.75]).select("column", fence.alias("fence"))
    fences = found.agg(*[F.max(F.when(F.col("column") == c, F.col("fence"))).alias(f"_{c}") for c in columns])  # one row
    out = rows.crossJoin(F.broadcast(fences))
    return out.filter(reduce(lambda x, y: x & y, [F.col(c) <= F.col(f"_{c}") for c in columns])).select(*df.columns)


def spread_flag(price_range: Column) -> Column:
    """Right-closed bins of a price range."""
    return F.when(price_range <= -0.01, None).when(price_range <= 1, SPREADS[0]).when(price_range <= 10, SPREADS[1]).when(price_range.isNotNull(), SPREADS[2])


def even_tiers(features: DataFrame, labels: tuple[str, ...] = ("Budget", "Mid-range", "Premium")) -> DataFrame:
    """Tiers of equal size by mean price."""
    rows = numbered(features, ["mean_price", "canonical_product_id"], "_no")
    out = rows.withColumn("tier", F.element_at(F.array(*map(F.lit, labels)), tile(F.col("_no"), F.col("_no_total"), len(labels))))
    return out.drop("_no", "_no_total")


def shopping_advice(tier: Column, cv: Column, stores: Column) -> Column:
    """Advice by tier and by whether prices vary; one for products of a single store."""
    varied = cv > VARIED
    out = F.when(stores < 2, ADVICE["single"])
    for name in ("Budget", "Mid-range", "Premium"):
        out = out.when((tier == name) & varied, ADVICE[name, True]).when(tier == name, ADVICE[name, False])
    return out.otherwise(ADVICE["none"])


def series_features(rows: DataFrame, date: str = "scraped_date_sg", codes: bool = True) -> DataFrame:
    """Last price, mean of the last three of these and, with ``codes``, calendar parts and category codes, per product and store.

    All columns of ``rows`` are shuffled, with ``codes`` written too, so callers leave out those that they do not need.
    """
    rows = written(rows) if codes else rows
    w = Window.partitionBy(*SERIES).orderBy(date)
    out = rows.withColumn("prev_price", F.lag("price_sgd").over(w)).withColumn("mean_3", F.avg("prev_price").over(w.rowsBetween(-2, 0)))
    if not codes:
        return out
    # codes number the sorted distinct values: small tables
    code = lambda c: rows.select(c).distinct().withColumn(f"{c}_code", (F.dense_rank().over(Window.orderBy(c)) - 1).cast("long"))
    out = out.join(F.broadcast(code("store")), "store", "left").join(F.broadcast(code("unified_category")), "unified_category", "left")
    return out.withColumns({"month": F.month(date), "weekday": F.weekday(date), "day": F.dayofmonth(date)})


def positional_split(df: DataFrame, order: list[str], part: float = 0.8, date: str | None = None) -> DataFrame:
    """Marks the first ``part`` of the rows in order as training rows; with ``date`` the order is by time first."""
    out = numbered(written(df), [date, *[c for c in order if c != date]] if date else order, "_no", step=False)
    return out.withColumn("is_train", F.col("_no") <= F.floor(F.col("_no_total") * part)).drop("_no", "_no_total")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute error, root mean squared error and R², one row."""
    e = F.col(actual) - F.col(predicted)
    sums = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("_mse"), F.var_pop(actual).alias("_var"), F.count("*").alias("n"))
    return sums.select("mae", "rmse", (1 - F.col("_mse") / F.nullif("_var", F.lit(0.0))).alias("r2"), "n")


def deal_status(difference: Column, percent: Column, threshold: Column) -> Column:
    """By how far a price is from the expected one, in money and in percent."""
    return F.when((difference <= -threshold) & (percent <= -5), "Good deal").when((difference >= threshold) & (percent >= 5), "Overpriced").otherwise("Normal price")


def deals(predictions: DataFrame, mae: float | None = None) -> DataFrame:
    """Adds difference, percent and status; the threshold is the model's error or 0.3."""
    difference = F.col("price_sgd") - F.col("predicted_price")
    percent = difference / F.nullif(F.col("predicted_price"), F.lit(0.0)) * 100
    return predictions.withColumns({"difference": difference, "percent": percent}).withColumn("deal", deal_status(F.col("difference"), F.col("percent"), F.lit(0.3 if mae is None else mae)))


def deal_counts(found: DataFrame) -> DataFrame:
    """Number of each kind of deal, 0 where there is none."""
    kinds = found.sparkSession.createDataFrame([(k,) for k in DEALS], "deal string")
    return kinds.join(found.groupBy("deal").agg(F.count("*").alias("n")), "deal", "left").select("deal", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
