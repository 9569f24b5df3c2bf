"""Inner joins that stay even when a few keys have most of the rows.

The rows of a key with more than a stated number of rows on a side are cut into parts, and the parts of
both sides meet in blocks: a key cut into j and k parts makes j x k blocks, each a key of its own for
the join. A row is copied for every part of the other side, so each pair of rows meets in exactly one
block and no block has more than about the stated number of rows of a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written

#: Rows of one key on one side that make a block.
MOST = 4000


def _parts(a: DataFrame, b: DataFrame, on: list[str], most: int) -> DataFrame:
    """Keys with more than ``most`` rows on a side and the numbers of parts of both: a row for each such key."""
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    parts = lambda n: F.ceil(F.col(n) / most).cast("int").alias(f"_{n}")
    both = count(a, "rows_a").join(count(b, "rows_b"), on)
    return both.filter((F.col("rows_a") > most) | (F.col("rows_b") > most)).select(*on, parts("rows_a"), parts("rows_b"))


def _cut(df: DataFrame, hot: DataFrame, on: list[str], spread: str, own: str, other: str) -> DataFrame:
    """Rows with the number of their own part, once for each part of the other side."""
    several = lambda c: F.coalesce(c, F.lit(1))
    part = F.pmod(F.xxhash64(spread), several(F.col(f"_rows_{own}"))).cast("int")
    cut = df.join(hot, on, "left").withColumn(f"_part_{own}", part)
    return cut.withColumn(f"_part_{other}", F.explode(F.sequence(F.lit(0), several(F.col(f"_rows_{other}")) - 1))).drop("_rows_a", "_rows_b")


def block_join(a: DataFrame, b: DataFrame, on: list[str], condition: Column, spread: str = "id", most: int | None = None) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` with equal keys that fulfil ``condition``, columns under the aliases a and b.

    ``spread`` is a column of both, such as an id, whose values part the rows of a hot key. Null keys
    meet nothing. Both sides are read twice, once for the sizes of their keys.
    """
    hot = written(_parts(a, b, on, most or MOST))
    left, right = _cut(a, hot, on, spread, "a", "b").alias("a"), _cut(b, hot, on, spread, "b", "a").alias("b")
    meet = condition
    for c in [*on, "_part_a", "_part_b"]:
        meet = meet & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    # dealt by blocks even where a side is small enough to be broadcast: its few input files would make few tasks
    return left.join(right.hint("merge"), meet)
