"""Cleaning of raw listing fields, as column expressions.

Rounding is half up on the printed decimal value. Casts never throw: what is no number is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import CATEGORIES, RELATIVE_URL_BASE


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def looked_up(column: Column, values: dict[str, str]) -> Column:
    """The value of a key, null for other keys and for null."""
    return F.try_element_at(literal_map(values), column)


def unified_category(slug: Column) -> Column:
    return looked_up(slug, CATEGORIES)


def to_float(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def maybe_float(value: Column) -> Column:
    """A number that may have thousands separators."""
    return to_float(F.replace(value.cast("string"), F.lit(","), F.lit("")))


def clean_discount(discount: Column) -> Column:
    """Null for null and 0, else rounded to cents; negative discounts stay."""
    d = to_float(discount)
    return F.when(d != 0, F.round(d, 2))


def reconcile_price(store: Column, price: Column, original: Column, discount: Column) -> Column:
    """The selling price: for one store a discount not yet taken off the price is taken off."""
    untouched = (store == "fairprice") & (discount > 0) & (F.abs(price - original) <= 0.01)
    return F.when(F.coalesce(untouched, F.lit(False)), F.round(F.greatest(original - discount, F.lit(0.0)), 2)).otherwise(F.round(price, 2))


def clean_product_url(url: Column, store: Column) -> Column:
    """Absolute for the store that gives paths, without query and fragment for the one that tracks."""
    return (
        F.when(url.isNull() | (url == ""), F.lit(None))
        .when((store == "shengsiong") & F.startswith(url, F.lit("/")), F.concat(F.lit(RELATIVE_URL_BASE), url))
        .when(store == "redmart", F.regexp_replace(url, r"[?#].*$", ""))
        .otherwise(url)
    )


def clean_text(value: Column) -> Column:
    """White space squeezed and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def absolute_url(url: Column, base: str) -> Column:
    return (
        F.when(url.isNull() | (url == ""), F.lit(None))
        .when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url)
        .when(F.startswith(url, F.lit("//")), F.concat(F.lit(base.split("//")[0]), url))
        .when(F.startswith(url, F.lit("/")), F.concat(F.lit("/".join(base.split("/")[:3])), url))
        .otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/" if base.count("/") > 2 else base + "/"), url))
    )


def infer_brand_from_name(name: Column) -> Column:
    """The name's first word, or its first two after a prefix that is no brand alone."""
    parts = F.split(clean_text(name), " ")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when(F.lower(first).isin("a2", "dr", "mr") & second.isNotNull(), F.concat_ws(" ", first, second)).otherwise(first)


def compute_discount(price: Column, original: Column) -> Column:
    d = F.round(original - price, 2)
    return F.when(d > 0, d)


def unit_from_name(name: Column) -> Column:
    """The size at the end of a name, with what follows it."""
    return F.nullif(F.regexp_extract(name, r"(?i)([0-9]+(?:\.[0-9]+)?\s*(?:kg|g|mg|ml|l|cl|oz|lb|pcs?|pc|s|x[0-9]+).*)$", 1), F.lit(""))


def source_image_url(url: Column) -> Column:
    """The address that an image proxy's ``url`` parameter holds, else the address itself."""
    return F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract(url, r"[?&]url=([^&#]*)", 1), F.lit(""))), url)


def local_date(ts: Column) -> Column:
    """The date as written, without a shift of zones."""
    return F.to_date(ts)


def singapore_date(ts: Column) -> Column:
    """The date in Singapore of a time in UTC."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Singapore"))


def slugify(value: Column) -> Column:
    dashed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def number_fragment(value: Column) -> Column:
    """A number as part of a key: na, a whole number, or three places with p for the point."""
    whole = value == F.floor(value)
    rounded = F.regexp_replace(F.round(value, 3).cast("string"), r"\.", "p")
    return F.when(value.isNull(), "na").when(whole, F.floor(value).cast("string")).otherwise(rounded)


def sortable_time(ts: Column) -> Column:
    """A time, the earliest there is for null, so that rows without one sort first."""
    return F.coalesce(ts.cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, the value itself where it has none."""
    return F.coalesce(looked_up(value, labels), value)


def currency(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("$%.2f", value))


def title_case(value: Column) -> Column:
    """Upper case after each character that is no letter, as in titles."""
    squeezed = F.replace(F.trim(value), F.lit("  "), F.lit(" "))
    runs = F.regexp_extract_all(squeezed, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))), "")


def short_label(name: Column, store: Column) -> Column:
    return F.concat(F.substring(name, 1, 38), F.lit("... ("), store, F.lit(")"))


def with_size(name: Column, size: Column) -> Column:
    blank = size.isNull() | F.trim(size).isin("", "—")
    return F.when(blank, name).otherwise(F.concat(name, F.lit(" ("), F.trim(size), F.lit(")")))
