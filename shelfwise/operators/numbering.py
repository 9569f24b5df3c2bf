"""Global row numbers without gathering all rows in one task.

Rows are written, cut into ranges of the order, numbered as they are sorted there and written again, so the
cut is stable and finding its borders computes nothing anew; sizes of the ranges, a row each, give where
every range's numbers begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import written


def numbered(df: DataFrame, order: list[str], name: str = "row_no", step: bool = True) -> DataFrame:
    """Adds ``name``, the row's number from 1 in the given ascending order, and ``<name>_total``, the number of rows.

    Without ``step`` rows are not written before they are cut into ranges, for such as are a step already.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = (written(df) if step else df).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id has the part above 33 bits and the place in it below
    cut = written(ranges.withColumns({"_part": F.spark_partition_id(), "_inner": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1}))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_size"))  # a row per range
    before = Window.orderBy("_part")
    bases = sizes.select("_part", (F.sum("_size").over(before) - F.col("_size")).alias("_base"), F.sum("_size").over(Window.partitionBy()).alias(f"{name}_total"))
    out = cut.join(F.broadcast(bases), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_inner")).drop("_part", "_inner", "_base")


def tile(number: Column, total: Column, tiles: int) -> Column:
    """The tile from 1 of a row number when all rows are dealt into equal tiles, the first ones larger by one."""
    size, larger = F.floor(total / tiles), total % tiles
    edge = (size + 1) * larger
    return F.when(number <= edge, F.floor((number - 1) / (size + 1)) + 1).otherwise(larger + F.floor((number - 1 - edge) / F.greatest(size, F.lit(1))) + 1).cast("int")
