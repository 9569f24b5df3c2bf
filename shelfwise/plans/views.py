"""The star-schema tables seen as price data: offers of stores, listings, and commodity listings.

A supplier's region is a store, a part is a product, a shipped line is an offer, a month is a day.
Each view has a twin in SQL, as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.steps import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_suppkey and store, written: Spark takes a join's size for the product of its sides', and would shuffle all lines by supplier."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return written(joined.select("s_suppkey", F.lower("r_name").alias("store")))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """canonical_product_id, names, category, store, times, prices, unit and product_id of each line."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    stores = _stores(spark, sf_dir)
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.date_format("l_shipdate", "yyyyMMdd")
    return rows.select(
        F.col("l_partkey").alias("canonical_product_id"), F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("canonical_brand"), F.col("p_type").alias("unified_category"), "store",
        F.col("l_shipdate").alias("scraped_at"), F.to_date(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("scraped_date_sg"), F.col("l_extendedprice").alias("price_sgd"), F.col("p_retailprice").alias("original_price_sgd"),
        F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("discount_sgd"), F.concat(F.col("p_size").cast("string"), F.lit("g")).alias("unit"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", day).alias("product_id"),
    )


OFFERS = """offers AS (
  SELECT l_partkey AS canonical_product_id, p_name AS canonical_name, p_brand AS canonical_brand, p_type AS unified_category, lower(r_name) AS store,
         l_shipdate AS scraped_at, CAST(date_trunc('month', l_shipdate) AS DATE) AS scraped_date_sg, l_extendedprice AS price_sgd, p_retailprice AS original_price_sgd,
         round(l_extendedprice * l_discount, 4) AS discount_sgd, p_size || 'g' AS unit,
         concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS product_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: One preferred offer per product, day and store.
PREFERRED = """preferred AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_product_id, scraped_date_sg, store
    ORDER BY (price_sgd IS NOT NULL) DESC, scraped_at DESC, product_id DESC) AS n FROM offers) WHERE n = 1)"""

MART = """mart AS (
  SELECT canonical_product_id, scraped_date_sg, min(canonical_name) AS canonical_name, min(unified_category) AS unified_category,
         min({'p': price_sgd, 's': store}) AS low, max({'p': price_sgd, 's': store}) AS high, count(DISTINCT store) AS compared_store_count
  FROM preferred WHERE price_sgd IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT store) >= 2
), marts AS (
  SELECT canonical_product_id, scraped_date_sg, canonical_name, unified_category, low.s AS cheapest_store, low.p AS cheapest_price_sgd,
         high.s AS priciest_store, high.p AS priciest_price_sgd, round(high.p - low.p, 4) AS price_spread_sgd, compared_store_count FROM mart)"""


def with_sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw listings of four stores."""
    key = F.col("p_partkey")
    seen = F.to_timestamp_ntz(F.lit("2026-04-01 00:00:00")) + F.make_dt_interval(days=(key % 5).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.concat(F.lit("s"), (key % 4).cast("string")).alias("store"), F.col("p_name").alias("name"), F.replace(F.lower("p_brand"), F.lit("brand#"), F.lit("b")).alias("brand"),
        F.concat(F.col("p_size").cast("string"), F.lit("g")).alias("unit"), F.col("p_retailprice").alias("price_sgd"), F.col("p_type").alias("category"), seen.alias("scraped_at"),
    )


LISTINGS = """listings AS (
  SELECT p_partkey AS id, 's' || (p_partkey % 4) AS store, p_name AS name, replace(lower(p_brand), 'brand#', 'b') AS brand,
         p_size || 'g' AS unit, p_retailprice AS price_sgd, p_type AS category FROM part)"""


def commodities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as commodity listings: the name's last word is the cut, and the part's size gives the weight."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    stores = _stores(spark, sf_dir)
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.element_at(F.split("p_name", " "), -1).alias("cut"), F.when(F.contains("p_name", F.lit("cold")), "frozen").otherwise("fresh/chilled").alias("frozen_flag"), "store", F.col("p_name").alias("name"),
        F.col("l_extendedprice").alias("price_sgd"), (F.col("p_size") * 50).cast("double").alias("weight_g"), F.to_date(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("scraped_date"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


COMMODITIES = """commodities AS (
  SELECT string_split(p_name, ' ')[-1] AS cut, CASE WHEN contains(p_name, 'cold') THEN 'frozen' ELSE 'fresh/chilled' END AS frozen_flag, lower(r_name) AS store, p_name AS name,
         l_extendedprice AS price_sgd, CAST(p_size * 50 AS DOUBLE) AS weight_g, CAST(date_trunc('month', l_shipdate) AS DATE) AS scraped_date,
         l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
