"""What a matching run leaves behind: pairs, products, members and a summary, each in its order.

Files are parts in order, of compressed JSON lines, written by as many tasks as there are; every row has its
position, so order does not hang on the names of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score as S
from ..sources.steps import written
from . import resolve
from .numbering import numbered

#: Best pairs that a run shows apart (a fixed value).
SHOWN = 20


def ordered(rows: DataFrame, order: list[str], step: bool = True) -> DataFrame:
    """Rows with their position from 1 in ascending order of the columns; parts hold ranges of it. ``step`` is as in ``numbered``."""
    return numbered(rows, order, "position", step).drop("position_total").orderBy("position")


def write_run(listings: DataFrame, category: str, folder: str, s: S.Scoring = S.PACKAGED) -> DataFrame:
    """Match a category's listings and write the run's files below ``folder``; returns the summary, one row.

    Review pairs are of first copies, with the numbers of copies of both; ``listing_copies`` tells each
    listing's first copy, and so all other pairs. Strong pairs are best pairs, which are of first copies
    alone. Pairs are ordered by score, stores, name and ids; products by members, the most first, then by the
    smallest id; members by their product, store and id. A run that is written again replaces its files.
    """
    pairs, best, products, members = resolve.match(listings, category, s)
    products, copies = written(products), written(resolve.copies(listings))
    low = pairs.withColumn("_low", -F.col("match_score"))
    by_score = ["_low", "store_a", "store_b", "name_a", "product_id_a", "product_id_b"]
    kept = products.withColumns({"_less": -F.col("member_count"), "_first": F.element_at("source_product_ids", 1)})
    in_order = ordered(kept, ["_less", "_first"], step=False)
    places = written(in_order.select("canonical_key", F.col("position").alias("_product")))
    of_product = members.join(places, "canonical_key")
    files = {
        "strong_match_pairs": ordered(best.drop("copies_a", "copies_b").withColumn("_low", -F.col("match_score")), by_score, step=False),
        "review_pairs": ordered(low.filter("match_status = 'review'"), by_score, step=False),
        "top_pairs": ordered(resolve.top_pairs(pairs, copies, SHOWN).withColumn("_low", -F.col("match_score")), by_score),
        "canonical_products": in_order,
        "canonical_product_members": ordered(of_product, ["_product", "store", "product_id"]),
        "listing_copies": ordered(copies, ["copy_id", "id"], step=False),
    }
    for name, rows in files.items():
        rows.drop("_low", "_less", "_first", "_product").write.mode("overwrite").json(f"{folder}/{name}", compression="gzip")
    summary = written(resolve.run_summary(listings, pairs, best, products).withColumn("category", F.lit(category)))
    summary.write.mode("overwrite").json(f"{folder}/summary", compression="gzip")
    return summary


def read_artifact(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A file of a run, with the columns wanted."""
    return spark.read.schema(schema).json(f"{folder}/{name}")
