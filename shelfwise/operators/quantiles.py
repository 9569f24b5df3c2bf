"""Exact quantiles of several columns and groups without a sort of all values.

Values are counted in cells of a monotone key, finer from pass to pass. Of each pass only the cells
that hold a wanted rank are kept, so after a few passes over the values the ranks stand in cells that
are small, or of so few different values that counting these is small. No task ever holds more than
the counts of one cell's parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import written

#: Values of a cell that one task may sort; larger cells are cut further.
SMALL = 100_000
#: Parts of an octave that a cell is cut into, pass by pass. In the last a cell has 4096 numbers at most.
FINER = [1 << 4, 1 << 16, 1 << 28, 1 << 40]


def monotone_key(value: Column) -> Column:
    """A number that never falls as ``value`` grows: its octave and the place in it, by sign; NaN comes last."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    place = F.when(size == 0, 0.0).when(size == float("inf"), 2200.0).otherwise(octave + size / F.pow(F.lit(2.0), octave) - 1 + 1100)
    return F.when(F.isnan(value), 3000.0).otherwise(F.signum(value) * place)


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``column``, ``n`` (values that are no null) and ``q``: the quantiles ``at``, between values by proportion.

    A row for each group and column that has values; null groups are groups. NaN is larger than all
    numbers. The values are written once. Groups' columns may not be named as those made here.
    """
    by, keys = list(by), [*by, "column"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_x")
    values = df.select(*by, pairs).select(*by, "_x.column", "_x.value").filter("value is not null").withColumn("key", monotone_key(F.col("value")))
    values = written(values)
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"))
    places = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in at])
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p)))))
    wanted = written(sizes.select(*keys, "n", F.explode(ranks).alias("rank")).withColumns({"cell": F.lit(0).cast("long"), "inner": F.col("rank"), "size": F.col("n")}))
    scale = None
    for parts in FINER:
        if (wanted.agg(F.max("size")).first()[0] or 0) <= SMALL:
            break
        wanted, scale = written(_finer(values, wanted, keys, scale, parts)), parts
    found = _picked(values, wanted, keys, scale)
    value = F.map_from_entries(F.collect_list(F.struct("rank", "value")))
    out = found.groupBy(*keys, "n").agg(value.alias("known"))

    def between(p: Column) -> Column:
        low, high = F.floor(p), F.ceil(p)
        a, b = F.element_at("known", low), F.element_at("known", high)
        return F.when((low == high) | (a == b), a).otherwise((high - p) * a + (p - low) * b)

    return out.select(*keys, "n", F.transform(places, between).alias("q"))


def _cell(scale: int | None) -> Column:
    return F.lit(0).cast("long") if scale is None else F.floor(F.col("key") * scale).cast("long")


def _same(keys: list[str], *more: str) -> Column:
    """Whether a (values) and b (wanted ranks) agree; null groups are equal."""
    out = F.lit(True)
    for c in [*keys, *more]:
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def _kept(values: DataFrame, wanted: DataFrame, keys: list[str], scale: int | None) -> DataFrame:
    """The values in cells that hold a wanted rank, once each."""
    cells = wanted.select(*keys, "cell").distinct()
    return values.withColumn("cell", _cell(scale)).alias("a").join(cells.alias("b"), _same(keys, "cell"), "left_semi").select("a.*")


def _finer(values: DataFrame, wanted: DataFrame, keys: list[str], scale: int | None, parts: int) -> DataFrame:
    """The wanted ranks with the smaller cells that they stand in and their ranks within these."""
    counts = _kept(values, wanted, keys, scale).groupBy(*keys, "cell", _cell(parts).alias("part")).agg(F.count("*").alias("m"))
    # parts of one cell: 4096 at most, in the first pass as many as the octaves have
    before = F.sum("m").over(Window.partitionBy(*keys, "cell").orderBy("part")) - F.col("m")
    found = counts.withColumn("before", before).alias("a").join(wanted.alias("b"), _same(keys, "cell") & (F.col("b.inner") >= F.col("a.before")) & (F.col("b.inner") < F.col("a.before") + F.col("a.m")))
    return found.select(*[f"b.{k}" for k in keys], "b.n", "b.rank", F.col("a.part").alias("cell"), (F.col("b.inner") - F.col("a.before")).alias("inner"), F.col("a.m").alias("size"))


def _picked(values: DataFrame, wanted: DataFrame, keys: list[str], scale: int | None) -> DataFrame:
    """The value at each wanted rank, by counts of a cell's different values."""
    counts = _kept(values, wanted, keys, scale).groupBy(*keys, "cell", "value").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy(*keys, "cell").orderBy("value")) - F.col("m")
    found = counts.withColumn("before", before).alias("a").join(wanted.alias("b"), _same(keys, "cell") & (F.col("b.inner") >= F.col("a.before")) & (F.col("b.inner") < F.col("a.before") + F.col("a.m")))
    return found.select(*[f"b.{k}" for k in keys], "b.n", "b.rank", "a.value")
