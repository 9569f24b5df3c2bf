"""Reports on the marts: discounts, price leadership, savings, spreads, tiers and trends.

Each returns a small frame with its order as part of the result where it is one. Ties are broken by
the columns named, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import written
from .quantiles import quantiles


def whole() -> Window:
    """All rows of a small frame."""
    return Window.partitionBy()


def share(count: str = "n"):
    """Percent of the total over all rows of a small frame."""
    return F.col(count) / F.sum(count).over(whole()) * 100


def discounts(rows: DataFrame) -> DataFrame:
    """Rows with a discount, and its percentage of the original price."""
    return rows.filter("discount_sgd > 0").withColumn("discount_pct", F.col("discount_sgd") / F.nullif("original_price_sgd", F.lit(0.0)) * 100)


def discount_summary(rows: DataFrame) -> DataFrame:
    return discounts(rows).groupBy("store").agg(F.count_distinct("canonical_product_id").alias("discounted_products"), F.avg("discount_sgd").alias("avg_discount"), F.max("discount_sgd").alias("max_discount"))


def top_discounts(rows: DataFrame, k: int = 10) -> DataFrame:
    """The products with the largest discounts, one row each."""
    best = Window.partitionBy("canonical_product_id").orderBy(F.desc("discount_sgd"), F.desc("product_id"))
    return discounts(rows).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n").orderBy(F.desc("discount_sgd"), F.desc("product_id")).limit(k)


def leadership(marts: list[DataFrame]) -> DataFrame:
    """category and cheapest store of all marts, one row per compared product."""
    out = None
    for m in marts:
        one = m.select("unified_category", "cheapest_store").filter("cheapest_store is not null")
        out = one if out is None else out.unionByName(one)
    return out


def price_leadership(leaders: DataFrame) -> DataFrame:
    return leaders.groupBy("cheapest_store").agg(F.count("*").alias("n")).withColumn("pct", share())


def category_winners(leaders: DataFrame) -> DataFrame:
    """Per category the store that is cheapest most often (the first by name among equals)."""
    counts = leaders.groupBy("unified_category", "cheapest_store").agg(F.count("*").alias("n"))
    w = Window.partitionBy("unified_category")
    out = counts.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("n"), "cheapest_store")), "_total": F.sum("n").over(w)})
    return out.filter("_n = 1").select("unified_category", "cheapest_store", "n", (F.col("n") / F.col("_total") * 100).alias("pct"))


def leadership_pivot(leaders: DataFrame, stores: list[str]) -> DataFrame:
    """Category by store, counts with 0, and the category's total."""
    out = leaders.groupBy("unified_category").pivot("cheapest_store", stores).agg(F.count(F.lit(1))).fillna(0, stores)
    return out.withColumn("total", sum((F.col(s) for s in stores[1:]), F.col(stores[0])))


def savings_buckets(spreads: DataFrame) -> DataFrame:
    """How many products cost the same everywhere or save more than 1, 2 and 5, one row."""
    s = F.col("price_spread_sgd")
    out = spreads.filter(s.isNotNull()).agg(F.count("*").alias("total"), F.count_if(s > 1).alias("over_1"), F.count_if(s > 2).alias("over_2"), F.count_if(s > 5).alias("over_5"), F.count_if(s == 0).alias("zero"))
    return out.withColumns({"small": F.col("total") - F.col("over_1") - F.col("zero"), "pct_worth": F.col("over_1") / F.nullif("total", F.lit(0)) * 100, "pct_zero": F.col("zero") / F.nullif("total", F.lit(0)) * 100})


def category_spreads(marts: DataFrame) -> DataFrame:
    out = written(marts.filter("price_spread_sgd > 0 and compared_store_count >= 2").select("unified_category", "price_spread_sgd"))
    middle = quantiles(out, ["price_spread_sgd"], [0.5], ["unified_category"]).select(F.col("unified_category").alias("_of"), F.col("q")[0].alias("median_spread"))
    means = out.groupBy("unified_category").agg(F.count("*").alias("n"), F.avg("price_spread_sgd").alias("mean_spread"))
    return means.join(middle, F.col("unified_category").eqNullSafe(F.col("_of"))).select("unified_category", "n", "median_spread", "mean_spread")


def top_spreads(marts: DataFrame, k: int, category: str | None = None) -> DataFrame:
    """The largest spreads of products in several stores."""
    rows = marts.filter("compared_store_count >= 2")
    rows = rows if category is None else rows.filter(F.col("unified_category") == category)
    return rows.orderBy(F.desc_nulls_first("price_spread_sgd"), "canonical_product_id", "scraped_date_sg").limit(k)


def top_savings(marts: DataFrame, k: int = 10) -> DataFrame:
    return top_spreads(marts.filter("price_spread_sgd > 0"), k)


def with_store_counts(rows: DataFrame, marts: DataFrame) -> DataFrame:
    """Marts with the number of stores that ever had the product."""
    return marts.join(rows.groupBy("canonical_product_id").agg(F.count_distinct("store").alias("actual_store_count")), "canonical_product_id", "left")


def candidates_for(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with a side among ``ids`` (column product_id), each unordered pair once, the best scored."""
    a = pairs.join(ids.select(F.col("product_id").alias("product_id_a")), "product_id_a", "left_semi")
    b = pairs.join(ids.select(F.col("product_id").alias("product_id_b")), "product_id_b", "left_semi")
    both = a.unionByName(b).withColumns({"low": F.least("product_id_a", "product_id_b"), "high": F.greatest("product_id_a", "product_id_b")})
    w = Window.partitionBy("low", "high").orderBy(F.desc("match_score"), "product_id_a")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("low", "high", "match_score", "match_status")


def cross_share(df: DataFrame, row: str, column: str) -> DataFrame:
    """Share of each column value within a row value, as (row, column, n, pct)."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(row)) * 100)


def top_categories(df: DataFrame, group: str, category: str, k: int = 8) -> DataFrame:
    """Per group the ``k`` most frequent categories and their share of these."""
    counts = df.groupBy(group, category).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    top = counts.withColumn("_n", F.row_number().over(w.orderBy(F.desc("n"), category))).filter(F.col("_n") <= k).drop("_n")
    return top.withColumn("pct", F.col("n") / F.sum("n").over(w) * 100)


def tier_summary(tiers: DataFrame) -> DataFrame:
    """Per tier its size, share, means and quartiles, and whether its prices vary most."""
    tiers = written(tiers.select("tier", "mean_price", "price_range", "cv"))
    q = quantiles(tiers, ["mean_price"], [0.25, 0.5, 0.75], ["tier"]).select(F.col("tier").alias("_of"), "q")
    out = tiers.groupBy("tier").agg(F.count("*").alias("n"), F.avg("mean_price").alias("mean_price"), F.avg("price_range").alias("mean_range"), F.avg("cv").alias("mean_cv"))
    out = out.join(q, F.col("tier").eqNullSafe(F.col("_of")), "left")
    most = F.col("mean_cv") == F.max("mean_cv").over(whole())
    return out.select("tier", "n", share().alias("pct"), "mean_price", "mean_range", "mean_cv", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), most.alias("varies_most"))


def good_deals(found: DataFrame, k: int = 10) -> DataFrame:
    """The good deals with the largest savings in percent of the expected price, one per product and store."""
    saving = (F.col("predicted_price") - F.col("price_sgd")) / F.col("predicted_price") * 100
    rows = found.filter("deal = 'Good deal'").withColumn("savings_pct", saving).filter("savings_pct > 0 and savings_pct <= 100")
    w = Window.partitionBy("canonical_product_id", "store").orderBy(F.desc("savings_pct"), F.desc("scraped_date_sg"), "product_id")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(F.desc("savings_pct"), "canonical_product_id", "store").limit(k)


def trend(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Change of the mean price from the first to the last date, and what it means, per key."""
    daily = rows.groupBy(*keys, "scraped_date_sg").agg(F.avg("price_sgd").alias("p"))
    out = daily.groupBy(*keys).agg(F.count("*").alias("days"), F.min_by("p", "scraped_date_sg").alias("first_price"), F.max_by("p", "scraped_date_sg").alias("last_price")).filter("days >= 2")
    change = (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100
    return out.withColumn("change_pct", change).withColumn("verdict", F.when(F.col("change_pct") > 2, "up").when(F.col("change_pct") < -2, "down").otherwise("stable"))


def kpis(rows: DataFrame, marts: DataFrame) -> DataFrame:
    """Numbers of products, offers, categories and the mean spread, one row."""
    a = rows.agg(F.count_distinct("canonical_product_id").alias("products"), F.count("*").alias("offers"), F.count_distinct("unified_category").alias("categories"), F.count_distinct("store").alias("stores"))
    return a.crossJoin(marts.agg(F.avg("price_spread_sgd").alias("mean_spread"), F.count("*").alias("comparisons")))


def category_counts(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows per expected category (column unified_category), 0 for missing ones."""
    counts = rows.groupBy("unified_category").agg(F.count("*").alias("n"))
    return expected.join(counts, "unified_category", "left").select("unified_category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def filtered(rows: DataFrame, search: str | None = None, name: str = "canonical_name", since=None, until=None, without: dict[str, list] | None = None, **equal) -> DataFrame:
    """Rows that pass all filters given; a filter of None passes all rows.

    ``search`` is a regular expression that the name contains, whatever the case. ``since`` and
    ``until`` are bounds of scraped_date_sg, both included. ``without`` leaves out rows whose column has
    one of the values. Further arguments are columns and the value, or the list of values, they must
    have. Rows with a null in a column that is searched or must have a value go; ``without`` keeps them.
    """
    if search:
        rows = rows.filter(F.col(name).rlike(f"(?i){search}"))
    if since is not None:
        rows = rows.filter(F.col("scraped_date_sg") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("scraped_date_sg") <= F.lit(until).cast("date"))
    for c, values in (without or {}).items():
        rows = rows.filter(F.col(c).isNull() | ~F.col(c).isin(values))
    for c, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(c).isin(value) if isinstance(value, (list, tuple, set)) else F.col(c) == F.lit(value))
    return rows


def sorted_table(rows: DataFrame, **order: bool) -> DataFrame:
    """Rows by columns in turn, True for descending; nulls come last in both directions."""
    return rows.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order.items()])


def described(rows: DataFrame, columns: list[str], places: int = 3) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of number columns, one row per column."""
    rows = written(rows.select(*columns))
    one = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
    )
    out = rows.agg(F.array(*map(one, columns)).alias("all")).select(F.inline("all"))
    out = out.join(quantiles(rows, columns, [0.25, 0.5, 0.75]).select("column", "q"), "column", "left")
    number = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "q1": F.col("q")[0], "median": F.col("q")[1], "q3": F.col("q")[2], "max": F.col("max")}
    return out.select("column", "count", *[F.round(v, places).alias(k) for k, v in number.items()])


def widest(features: DataFrame, k: int = 15) -> DataFrame:
    """The products whose prices lie furthest apart."""
    return features.orderBy(F.desc_nulls_last("price_range"), "canonical_product_id").limit(k)


def anomaly_summary(found: DataFrame) -> DataFrame:
    """Per flag (1 usual, -1 odd) the number of products, its share and means."""
    label = F.when(F.col("flag") == -1, "Anomalous").otherwise("Normal").alias("anomaly_flag")
    means = [F.avg(c).alias(f"avg_{c}") for c in ("mean_price", "price_range", "cv", "num_stores")]
    return found.groupBy(label).agg(F.count("*").alias("n"), *means).withColumn("pct", share())


def anomaly_categories(found: DataFrame) -> DataFrame:
    """Odd products per category, 0 for categories without any."""
    return found.groupBy("unified_category").agg(F.count_if(F.col("flag") == -1).alias("n"))


def top_anomalies(found: DataFrame, k: int = 20) -> DataFrame:
    """The odd products with the lowest scores."""
    return found.filter("flag = -1").orderBy("score", "canonical_product_id").limit(k)


def commodity_kpis(compared: DataFrame) -> DataFrame:
    """Numbers of cuts, of those with both stores, of categories, the mean spread and the last date, one row."""
    both = F.col("cheapest_store").isNotNull() & F.col("priciest_store").isNotNull()
    return compared.agg(
        F.count("*").alias("cuts"), F.count_if(both).alias("comparable"), F.count_distinct("unified_category").alias("categories"),
        F.avg("price_spread_sgd").alias("mean_spread"), F.max("scraped_date").alias("last_date"),
    )


def most_competitive(compared: DataFrame) -> DataFrame:
    """The store that is cheapest most often (the first by name among equals); no row where none is."""
    counts = compared.filter("cheapest_store is not null").groupBy("cheapest_store").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "cheapest_store").limit(1)


def commodity_trend(compared: DataFrame) -> DataFrame:
    """Mean lowest price and mean spread per date, cut and flag."""
    return compared.groupBy("scraped_date", "cut", "frozen_flag").agg(F.avg("cheapest_price_sgd").alias("avg_cheapest"), F.avg("price_spread_sgd").alias("avg_spread"))


def with_names(rows: DataFrame, names: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows with columns of their product, from its first row in order; rows without a name go."""
    first = names.filter("canonical_product_id is not null").groupBy("canonical_product_id").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_named"))
    return rows.join(first, "canonical_product_id", "left").select(*rows.columns, *[F.col(f"_named.{c}").alias(c) for c in columns]).filter("canonical_name is not null and canonical_name <> '—'")


def cross_table(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Percent of each column value within a row value, one column per value, 0 where there is none."""
    counts = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.select(row, *[(F.col(v) / F.nullif(total, F.lit(0)) * 100).alias(v) for v in values])


def predicted_trend(rows: DataFrame, limit: float = 2.0) -> DataFrame:
    """Change in percent from the first to the last date of actual and of predicted mean prices, and what it means."""
    daily = rows.groupBy("scraped_date_sg").agg(F.avg("price_sgd").alias("actual"), F.avg("predicted_price").alias("predicted"))
    ends = [f(c, "scraped_date_sg").alias(f"{n}_{c}") for c in ("actual", "predicted") for n, f in (("first", F.min_by), ("last", F.max_by))]
    out = daily.agg(F.count("*").alias("days"), *ends).filter("days >= 2")
    for c in ("actual", "predicted"):
        change = (F.col(f"last_{c}") - F.col(f"first_{c}")) / F.nullif(F.col(f"first_{c}"), F.lit(0.0)) * 100
        out = out.withColumn(f"{c}_change_pct", change)
        verdict = F.when(F.col(f"{c}_change_pct") > limit, "up").when(F.col(f"{c}_change_pct") < -limit, "down").otherwise("stable")
        out = out.withColumn(f"{c}_verdict", verdict)
    return out


def options(rows: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, for filters."""
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
