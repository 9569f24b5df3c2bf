"""Commodities: prices of one cut across stores at the pack size sold most.

Rows have cut, frozen_flag, store, name, price_sgd, weight_g, scraped_date and ord, their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.steps import written
from .pricing import latest

GROUP = ["cut", "frozen_flag"]
#: Weights within this part of another count as the same pack.
TOLERANCE = 0.20


def tagged(listings: DataFrame) -> DataFrame:
    """Listings that tell a cut, a weight and a price, with both as columns."""
    out = listings.withColumns({"cut": T.cut_of(T.normalize_loose(F.col("name"))), "frozen_flag": F.when(T.is_frozen(F.col("name")), "frozen").otherwise("fresh/chilled"), "weight_g": T.listing_weight_g(F.col("unit"), F.col("name"))})
    return out.filter("cut is not null and weight_g is not null and price_sgd is not null")


def modal_weights(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per group the weight that stands for its most common pack.

    Each weight counts those within the tolerance; the first with the most wins, and the upper median
    of what it counted is the result. Weights are counted as (weight, rows, first order) before. Each
    then stands three times in its group's order, as itself and as both ends of its band, so running
    counts tell what is within: a sort of the different weights, without comparing them pair by pair.
    """
    counted = rows.filter("weight_g is not null").groupBy(*GROUP, "weight_g").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    place = lambda value, kind: F.struct(value.alias("value"), F.lit(kind).alias("kind"))
    weight = F.col("weight_g")
    # among equals the lower ends come before the weights and the upper ends behind
    places = F.explode(F.array(place(weight * (1 - tolerance), 0), place(weight, 1), place(weight * (1 + tolerance), 2)))
    marked = counted.withColumn("place", places).select("*", "place.value", "place.kind").drop("place")
    order = Window.partitionBy(*GROUP).orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("seen", F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).over(order))
    seen = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seen")))
    ranked = marked.groupBy(*GROUP, "weight_g", "n", "first").agg(seen(0).alias("below"), seen(1).alias("upto"), (seen(2) - seen(0)).alias("members"))
    top = F.max(F.struct("members", -F.col("first"), "below")).over(Window.partitionBy(*GROUP))
    ranked = ranked.withColumn("top", top)
    middle = F.col("top.below") + F.floor(F.col("top.members") / 2)
    return ranked.filter((F.col("upto") - F.col("n") <= middle) & (middle < F.col("upto"))).select(*GROUP, F.col("weight_g").alias("modal_weight_g"), F.col("top.members").alias("members"))


def comparison(rows: DataFrame, tolerance: float = TOLERANCE, least_stores: int = 2) -> DataFrame:
    """Per cut the stores' lowest prices at the common pack size, where several stores sell it.

    Only each store's last date counts. Among equal prices a store's first row counts, and of stores
    the one met first is the cheapest, the one met last the priciest.
    """
    rows = latest(written(rows.select(*GROUP, "store", "price_sgd", "weight_g", "scraped_date", "ord")), ["store"], "scraped_date")
    modal = modal_weights(rows, tolerance)
    near = rows.join(modal.drop("members"), GROUP).filter(F.col("weight_g").between(F.col("modal_weight_g") * (1 - tolerance), F.col("modal_weight_g") * (1 + tolerance)))
    best = F.min_by(F.struct("price_sgd", "weight_g", "scraped_date"), F.struct(F.col("price_sgd").isNotNull(), "price_sgd", "ord"))
    offers = near.groupBy(*GROUP, "modal_weight_g", "store").agg(best.alias("best"), F.min("ord").alias("_met")).select("*", "best.*").drop("best")
    offers = offers.withColumn("unit_price", F.col("price_sgd") / F.col("weight_g") * 100)
    entry = F.struct(F.col("store").alias("key"), F.struct("price_sgd", "weight_g", F.round("unit_price", 4).alias("unit_price_per_100g")).alias("value"))
    low, high = F.min(F.struct("price_sgd", "_met", "store", "unit_price", "scraped_date")), F.max(F.struct("price_sgd", "_met", "store", "unit_price"))
    out = offers.groupBy(*GROUP, "modal_weight_g").agg(low.alias("low"), high.alias("high"), F.count("*").alias("store_count"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("store_prices"))
    return out.filter(F.col("store_count") >= least_stores).select(
        *GROUP, "modal_weight_g", F.col("low.scraped_date").alias("scraped_date"), F.col("low.store").alias("cheapest_store"), F.col("low.price_sgd").alias("cheapest_price_sgd"),
        F.col("high.store").alias("priciest_store"), F.col("high.price_sgd").alias("priciest_price_sgd"), F.round(F.col("high.price_sgd") - F.col("low.price_sgd"), 4).alias("price_spread_sgd"),
        F.round("low.unit_price", 4).alias("cheapest_unit_price"), F.round("high.unit_price", 4).alias("priciest_unit_price"), "store_count", "store_prices",
    )


#: What stored comparisons tell of each store's offer.
OFFER = "struct<price_sgd double, weight_g double, unit_price_per_100g double>"


def offers_of_text(rows: DataFrame, keys: list[str], text: str = "store_prices") -> tuple[DataFrame, DataFrame]:
    """Offers of each store from comparisons' text (a JSON object of objects), and what is no offer.

    Offers have the keys, store, price, weight and unit price; those without a unit price, or with one
    of 0, tell nothing and are left out. Apart go, as they stand, texts that are no object (without a
    store) and entries that are no object of numbers; null texts have neither.
    """
    entries = F.from_json(text, "map<string,string>")
    kept = rows.select(*keys, F.col(text).alias("_text"), entries.alias("_entries"))
    # a text that is no object parses to null or to no entry
    strange = F.col("_entries").isNull() | ((F.size("_entries") == 0) & ~F.col("_text").rlike(r"^\s*\{\s*\}\s*$"))
    whole = kept.filter(F.col("_text").isNotNull() & strange).select(*keys, F.lit(None).cast("string").alias("store"), F.col("_text").alias("entry"))
    each = kept.filter(~strange).select(*keys, F.explode("_entries").alias("store", "entry"))
    each = each.withColumn("offer", F.from_json("entry", OFFER))
    # fields that are there but no number parse to null
    numbers = [F.col(f"offer.{c}").isNotNull() | F.coalesce(F.get_json_object("entry", f"$.{c}"), F.lit("null")).isin("null") for c in ("price_sgd", "weight_g", "unit_price_per_100g")]
    fine = F.coalesce(F.col("entry").rlike(r"^\s*\{") & numbers[0] & numbers[1] & numbers[2], F.lit(False))
    offers = each.filter(fine).select(*keys, "store", "offer.*").filter("unit_price_per_100g <> 0")
    return offers, whole.unionByName(each.filter(~fine).select(*keys, "store", "entry"))


def unit_price_extremes(comparisons: DataFrame) -> DataFrame:
    """Per cut the stores with the lowest and highest unit price, and the spread, where there is one."""
    offers = comparisons.select("cut", F.explode("store_prices").alias("store", "offer")).select("cut", "store", F.col("offer.unit_price_per_100g").alias("unit_price")).filter("unit_price > 0")
    low, high = F.min(F.struct("unit_price", "store")), F.max(F.struct("unit_price", "store"))
    out = offers.groupBy("cut").agg(low.alias("low"), high.alias("high"))
    spread = F.round(F.col("high.unit_price") - F.col("low.unit_price"), 4)
    return out.select("cut", F.col("low.store").alias("cheapest_store"), F.col("low.unit_price").alias("cheapest_unit_price"), F.col("high.store").alias("priciest_store"), F.col("high.unit_price").alias("priciest_unit_price"), spread.alias("spread_per_100g")).filter("spread_per_100g > 0")
