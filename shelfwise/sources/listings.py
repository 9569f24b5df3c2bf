"""Reading listings: raw store files, tables, and text or markup of listing pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean as C

#: The superset of all stores' raw fields. Prices are read as text, as some stores write them so.
RAW = T.StructType([T.StructField(n, T.StringType()) for n in "name brand price_sgd original_price_sgd discount_sgd unit promo_text main_category subcategory category_slug country_of_origin storage_type item_code store product_url image_url scraped_at".split()])

#: Columns of the unified schema.
UNIFIED = ["name", "brand", "price_sgd", "original_price_sgd", "discount_sgd", "unit", "unified_category", "category_slug", "store", "product_url", "scraped_at"]

#: Fixed value: rows that one store's pages may give per category.
ROWS_PER_CATEGORY = 410


def raw_listings(spark: SparkSession, base: str, store: str = "*", date: str = "*") -> DataFrame:
    """All rows of ``base/<store>/<date>/*.json`` (JSON arrays); path parts as path_store and path_date.

    A folder that does not exist gives no rows.
    """
    path = f"{base}/{store}/{date}/*.json"
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    if not found:
        return spark.createDataFrame([], T.StructType([*RAW.fields, T.StructField("path_store", T.StringType()), T.StructField("path_date", T.StringType())]))
    file = F.col("_metadata.file_path")
    return spark.read.schema(RAW).option("multiLine", True).json(path).withColumns({"path_store": F.regexp_extract(file, "([^/]+)/[^/]+/[^/]+$", 1), "path_date": F.regexp_extract(file, "([^/]+)/[^/]+$", 1)})


#: Columns of processed files.
PROCESSED = T.StructType([T.StructField(n, T.DoubleType() if n.endswith("_sgd") else T.StringType()) for n in UNIFIED])


def processed_listings(spark: SparkSession, base: str, date: str, stores: list[str]) -> DataFrame:
    """All rows of ``base/<store>/<date>/*.json`` of the stores; one without a folder for the date gives none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for store in stores:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{base}/{store}/{date}/*.json")
        if pattern.getFileSystem(conf).globStatus(pattern):
            found.append(str(pattern))
    return spark.read.schema(PROCESSED).option("multiLine", True).json(found) if found else spark.createDataFrame([], PROCESSED)


def unify(raw: DataFrame) -> DataFrame:
    """Raw rows in the unified schema; rows of other categories are left out."""
    price, original, discount = C.to_float(F.col("price_sgd")), C.to_float(F.col("original_price_sgd")), C.to_float(F.col("discount_sgd"))
    store = F.col("store")
    out = raw.withColumn("unified_category", C.unified_category(F.col("category_slug"))).filter("unified_category is not null")
    return out.select(
        "name", "brand", C.reconcile_price(store, price, original, discount).alias("price_sgd"), original.alias("original_price_sgd"), C.clean_discount(F.col("discount_sgd")).alias("discount_sgd"),
        "unit", "unified_category", "category_slug", "store", C.clean_product_url(F.col("product_url"), store).alias("product_url"), "scraped_at",
    )


def day_of(rows: DataFrame, store: str, category: str, date: str) -> DataFrame:
    """One store's rows of a category and a day, from its start to the next one's, in order of id."""
    day = F.lit(date).cast("date").cast("timestamp_ntz")
    after = F.date_add(F.lit(date).cast("date"), 1).cast("timestamp_ntz")
    return rows.filter((F.col("store") == store) & (F.col("unified_category") == category) & (F.col("scraped_at") >= day) & (F.col("scraped_at") < after)).orderBy("id")


def first_by_url(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with name, price and url, the first of each url."""
    w = Window.partitionBy("product_url").orderBy(*order)
    return rows.filter("name is not null and price_sgd is not null and product_url is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def capped(rows: DataFrame, order: list[str], most: int = ROWS_PER_CATEGORY) -> DataFrame:
    """The first rows of each store and category: a source's limit."""
    w = Window.partitionBy("store", "category_slug").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def in_categories(rows: DataFrame, slugs: list[str] | None) -> DataFrame:
    return rows.filter(F.col("category_slug").isin(slugs)) if slugs else rows


#: Nested records of one store's interface.
RECORD = "name string, brand struct<name string>, primaryCategory struct<name string, parentCategory struct<name string>>, storeSpecificData array<struct<mrp string, discount string>>, finalPrice string, metaData struct<DisplayUnit string, `Unit Of Weight` string>, slug string"


def from_records(records: Column) -> Column:
    """Flat fields of a nested JSON record, as a struct."""
    r = F.from_json(records, RECORD)
    store = F.try_element_at(r["storeSpecificData"], F.lit(1))
    return F.struct(
        r["name"].alias("name"), r["brand"]["name"].alias("brand"), C.to_float(r["finalPrice"]).alias("price_sgd"), C.to_float(store["mrp"]).alias("original_price_sgd"), C.to_float(store["discount"]).alias("discount_sgd"),
        F.coalesce(r["metaData"]["DisplayUnit"], r["metaData"]["Unit Of Weight"]).alias("unit"), r["primaryCategory"]["parentCategory"]["name"].alias("main_category"), r["primaryCategory"]["name"].alias("subcategory"), r["slug"].alias("slug"),
    )


#: Words of lines that are no name, lines that say a listing is not sold, ends of sizes.
NO_NAME = ["save", "off", "buy", "any", "spend", "multiple promo", "sold"]
SIZE_ENDS = [" g", " kg", " ml", " l"]


def from_lines(text: Column) -> Column:
    """Fields of a listing given as lines of text, as a struct; null without a price or a name.

    A line with a dollar sign and no slash that is a number without that sign is a price: the first the
    present, the second the former one. The unit is the first line of at most four words that ends with
    a unit or has an x. The name is the first line that is neither of these, nor one of promotions,
    in brackets, a bare number, a code ending in D or W, or of three characters or fewer.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    number = lambda x: F.trim(F.replace(x, F.lit("$"), F.lit("")))
    plain = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
    prices = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("$")) & ~F.contains(x, F.lit("/")) & number(x).rlike(plain)), lambda x: number(x).try_cast("double"))

    def sized(x: Column) -> Column:
        low = F.lower(x)
        marks = [F.endswith(low, F.lit(e)) for e in SIZE_ENDS] + [F.contains(low, F.lit(c)) for c in ("x", "×")]
        return reduce(lambda a, b: a | b, marks) & (F.size(F.split(low, r"\s+")) <= 4)

    unit = F.try_element_at(F.filter(lines, sized), F.lit(1))

    def named(x: Column) -> Column:
        low = F.lower(x)
        no = [F.contains(low, F.lit(w)) for w in NO_NAME] + [
            low == "out of stock", F.contains(x, F.lit("$")), F.coalesce(x == unit, F.lit(False)), F.startswith(x, F.lit("(")) & F.endswith(x, F.lit(")")),
            F.replace(x, F.lit("."), F.lit("")).rlike("^[0-9]+$"), F.endswith(x, F.lit("D")), F.endswith(x, F.lit("W")), F.length(x) <= 3,
        ]
        return ~reduce(lambda a, b: a | b, no)

    name = F.try_element_at(F.filter(lines, named), F.lit(1))
    price, original = F.try_element_at(prices, F.lit(1)), F.try_element_at(prices, F.lit(2))
    fields = F.struct(name.alias("name"), price.alias("price_sgd"), original.alias("original_price_sgd"), F.round(original - price, 2).alias("discount_sgd"), unit.alias("unit"))
    return F.when(price.isNotNull() & name.isNotNull(), fields)


def validated(rows: DataFrame) -> DataFrame:
    """Trimmed text, numbers as numbers, and a discount where the prices tell one."""
    fields = {f.name: C.clean_text(F.col(f.name)) for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ("price_sgd", "original_price_sgd", "discount_sgd")}
    numbers = {c: C.maybe_float(F.col(c)) for c in ("price_sgd", "original_price_sgd", "discount_sgd") if c in rows.columns}
    out = rows.withColumns(fields | numbers)
    return out.withColumn("discount_sgd", F.coalesce("discount_sgd", C.compute_discount(F.col("price_sgd"), F.col("original_price_sgd"))))


def jdbc_table(spark: SparkSession, url: str, name: str, columns: list[str], key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table in ranges of a key, read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts, **options)
    return reader.load().select(*columns)
