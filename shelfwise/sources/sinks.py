"""Writing results: upserts on keys, slices, exports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def missing(existing: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The new rows whose keys the table has not; of new rows of one key the first."""
    fresh = first_per_key(new, keys, order)
    same = [fresh[k].eqNullSafe(existing[k]) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return fresh.join(existing, condition, "left_anti")


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The table after new rows came in whose keys it had not; of new rows of one key the first."""
    return existing.unionByName(missing(existing, new, keys, order))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The table after new rows took the place of those of their keys; of new rows of one key the first in order."""
    fresh = first_per_key(new, keys, order)
    condition = None
    for k in keys:
        c = existing[k].eqNullSafe(fresh[k])
        condition = c if condition is None else condition & c
    return existing.join(fresh, condition, "left_anti").unionByName(fresh)


def undirected(pairs: DataFrame) -> DataFrame:
    """Pairs with the smaller id as a, stores, names and ids exchanged together."""
    swap = F.col("product_id_a") > F.col("product_id_b")
    sides = {}
    for c in ("product_id", "store", "name"):
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        sides |= {f"{c}_a": F.when(swap, b).otherwise(a), f"{c}_b": F.when(swap, a).otherwise(b)}
    return pairs.withColumns(sides)


def members_with_ids(members: DataFrame, canonical: DataFrame, run_key: str, source: str) -> DataFrame:
    """Members with the surrogate id of their key; those without one are left out."""
    return members.join(canonical.select("canonical_key", F.col("id").alias("canonical_product_id")), "canonical_key").withColumns({"run_key": F.lit(run_key), "match_source": F.lit(source)})


def write_partitioned(df: DataFrame, path: str, by: list[str], format: str = "parquet") -> None:
    """Replace the partitions that ``df`` has rows of and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(format).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def checked_counts(rows: DataFrame, expected: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Rows per expected value; with ``strict`` a value without rows fails the job that reads the result."""
    counts = expected.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if not strict:
        return counts
    fail: Column = F.raise_error(F.concat(F.lit("no rows for "), F.col(column)))
    return counts.withColumn("n", F.when(F.col("n") == 0, fail.cast("long")).otherwise(F.col("n")))
