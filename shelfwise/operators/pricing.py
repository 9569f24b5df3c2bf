"""Daily price marts: one offer per store, ranks, cheapest and priciest store, spreads.

Input rows have canonical_product_id, canonical_name, unified_category, store, product_id, scraped_at,
scraped_date_sg and price_sgd. ``daily_*`` follow the mart (one preferred offer per store and day);
``view_*`` follow the plain view, which keeps all offers, counts rows and breaks ties by store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = ["canonical_product_id", "scraped_date_sg"]


def member_prices(canonical: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """Members with their canonical product and the product's row; rows without a time are left out."""
    found = members.select("canonical_product_id", "product_id").join(products.filter("scraped_at is not null"), "product_id")
    return found.join(canonical.select("canonical_product_id", "canonical_name", "canonical_brand", "unified_category"), "canonical_product_id")


def preferred_offers(rows: DataFrame) -> DataFrame:
    """One row per product, day and store: one with a price, then the latest, then the largest id."""
    store = F.coalesce("store", F.concat(F.lit("product:"), F.col("product_id").cast("string")))
    w = Window.partitionBy(*DAY, store).orderBy(F.col("price_sgd").isNotNull().desc(), F.desc_nulls_last("scraped_at"), F.desc("product_id"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def daily_prices(rows: DataFrame) -> DataFrame:
    """Preferred offers with minimum, maximum, dense rank, gap and number of stores of the day."""
    day = Window.partitionBy(*DAY)
    out = preferred_offers(rows).withColumns({
        "min_price_sgd": F.min("price_sgd").over(day),
        "max_price_sgd": F.max("price_sgd").over(day),
        "price_rank": F.when(F.col("price_sgd").isNotNull(), F.dense_rank().over(day.orderBy(F.asc_nulls_last("price_sgd")))),
        "compared_store_count": F.size(F.collect_set(F.when(F.col("price_sgd").isNotNull(), F.col("store"))).over(day)).cast("long"),
    })
    return out.withColumns({
        "price_gap_sgd": F.round(F.col("price_sgd") - F.col("min_price_sgd"), 4),
        "is_cheapest": F.coalesce(F.col("price_sgd") == F.col("min_price_sgd"), F.lit(False)),
    })


def store_price_map(price: str = "price_sgd"):
    """Map from store to its offer, as an aggregate."""
    entry = F.struct(F.col("store").alias("key"), F.struct(F.col(price).alias("price_sgd"), F.col("product_id").alias("product_id")).alias("value"))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def daily_recommendations(rows: DataFrame, least_stores: int = 2) -> DataFrame:
    """Cheapest and priciest store, spread and all stores' prices of products priced in several stores.

    Among equal prices the cheapest store is the first by name and the priciest the last.
    """
    priced = preferred_offers(rows).filter("price_sgd is not null")
    low, high = F.min(F.struct("price_sgd", "store")), F.max(F.struct("price_sgd", "store"))
    out = priced.groupBy(*DAY).agg(
        F.min("canonical_name").alias("canonical_name"), F.min("unified_category").alias("unified_category"), low.alias("low"), high.alias("high"),
        F.count_distinct("store").alias("compared_store_count"), store_price_map().alias("store_prices"),
    )
    return out.filter(F.col("compared_store_count") >= least_stores).select(
        *DAY, "canonical_name", "unified_category", F.col("low.store").alias("cheapest_store"), F.col("low.price_sgd").alias("cheapest_price_sgd"),
        F.col("high.store").alias("priciest_store"), F.col("high.price_sgd").alias("priciest_price_sgd"),
        F.round(F.col("high.price_sgd") - F.col("low.price_sgd"), 4).alias("price_spread_sgd"), "compared_store_count", "store_prices",
    )


def view_prices(rows: DataFrame) -> DataFrame:
    """All offers with window columns: rank with ties broken by store, row counts, null prices last."""
    day = Window.partitionBy(*DAY)
    return rows.withColumns({
        "min_price_sgd": F.min("price_sgd").over(day), "max_price_sgd": F.max("price_sgd").over(day),
        "price_rank": F.rank().over(day.orderBy(F.asc_nulls_last("price_sgd"), "store")),
        "price_gap_sgd": F.col("price_sgd") - F.min("price_sgd").over(day),
        "is_cheapest": F.coalesce(F.col("price_sgd") == F.min("price_sgd").over(day), F.lit(False)),
        "compared_store_count": F.count("*").over(day),
    })


def view_summary(rows: DataFrame) -> DataFrame:
    """A row per product and day: cheapest and priciest store, both the first by name among equals."""
    low = F.min(F.struct(F.col("price_sgd").isNull().alias("none"), "price_sgd", "store"))
    high = F.min(F.struct(F.col("price_sgd").isNull().alias("none"), (-F.col("price_sgd")).alias("p"), "store"))
    out = rows.groupBy(*DAY, "canonical_name", "unified_category").agg(low.alias("low"), high.alias("high"), F.count("*").alias("compared_store_count"))
    return out.select(
        *DAY, "canonical_name", "unified_category", F.col("low.store").alias("cheapest_store"), F.col("low.price_sgd").alias("cheapest_price_sgd"),
        F.col("high.store").alias("priciest_store"), (-F.col("high.p")).alias("priciest_price_sgd"), (-F.col("high.p") - F.col("low.price_sgd")).alias("price_spread_sgd"), "compared_store_count",
    )


def exploded_prices(recommendations: DataFrame) -> DataFrame:
    """A row per product, day and store of the price map."""
    return recommendations.select(*DAY, F.explode("store_prices").alias("store", "offer")).select(*DAY, "store", F.col("offer.price_sgd").alias("price_sgd"))


def latest(rows: DataFrame, by: list[str], date: str = "scraped_date_sg") -> DataFrame:
    """The rows of each key's last date."""
    # a row per key: a key may have most of the rows, so these are not brought together
    last = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(date).alias("_last"))
    same = F.col(date) == F.col("_last")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(last, same, "left_semi")


def latest_day(rows: DataFrame, date: str = "scraped_date_sg") -> DataFrame:
    """The rows of the last date of all; the date is a scalar subquery's result."""
    last = rows.agg(F.max(date).alias("_last"))  # one row
    return rows.join(F.broadcast(last), F.col(date) == F.col("_last"), "left_semi")


def price_history(rows: DataFrame, least_days: int = 1) -> DataFrame:
    """Preferred offers of product-store pairs seen on enough days."""
    offers = preferred_offers(rows)
    w = Window.partitionBy("canonical_product_id", "store")
    days = offers.withColumn("days", F.size(F.collect_set("scraped_date_sg").over(w)).cast("long"))
    return days.filter(F.col("days") >= least_days).select("canonical_product_id", "store", "scraped_date_sg", "price_sgd", "days")
