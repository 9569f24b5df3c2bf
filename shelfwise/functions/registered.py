r"""The functions of names, sizes and prices under names for SQL.

``register(spark)`` makes them known to a session:

    slug(text)                      key of a name
    normal_text(text)               lower case, letters, digits and points alone
    size_total(text)                grams, millilitres or pieces of ``6 x 200ml``, ``1.5l``, ``20 s``
    size_unit(text)                 g, ml or count
    weight_g(text)                  grams of ``2 x 500g`` or ``1.5 kg``
    unit_price(price, grams)        price of 100 g
    deal(difference, percent, limit)
    price_text(price)               price as shown
    name_ratio(a, b)                similarity of two names

All but the last are SQL functions, which Spark puts into the plan as expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text

_SYMBOLS = "replace(replace(lower(coalesce({0}, '')), '×', ' x '), '&', ' and ')"
_NORMAL = rf"trim(regexp_replace(regexp_replace({_SYMBOLS}, r'[^a-z0-9\.\s]', ' '), r'\s+', ' '))"
_LOOSE = rf"trim(regexp_replace(regexp_replace({_SYMBOLS}, r'[\(\)\[\],/+\-]', ' '), r'\s+', ' '))"
_MANY, _ONE, _PIECES = r"(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*(ml|l|g|kg)", r"(\d+(?:\.\d+)?)\s*(ml|l|g|kg)", r"(\d+)\s*s\b"
_MANY_GRAMS, _ONE_GRAMS = r"(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*(g|kg)", r"(\d+(?:\.\d+)?)\s*(g|kg)\b"


def _part(value: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({value}, r'{pattern}', {group}), '')"


def _base(number: str, unit: str) -> str:
    return f"CAST({number} AS DOUBLE) * CASE WHEN {unit} IN ('l', 'kg') THEN 1000 ELSE 1 END"


def _definitions() -> dict[str, str]:
    normal, loose = _NORMAL.format("t"), _LOOSE.format("t")
    many, one, pieces = (lambda g: _part(normal, _MANY, g)), (lambda g: _part(normal, _ONE, g)), _part(normal, _PIECES, 1)
    heavy, light = (lambda g: _part(loose, _MANY_GRAMS, g)), (lambda g: _part(loose, _ONE_GRAMS, g))
    kind = lambda unit: f"CASE WHEN {unit} IN ('l', 'ml') THEN 'ml' ELSE 'g' END"
    return {
        "slug(t STRING) RETURNS STRING": "coalesce(nullif(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), 'unknown')",
        "normal_text(t STRING) RETURNS STRING": normal,
        "size_total(t STRING) RETURNS DOUBLE": f"""CASE WHEN {many(1)} IS NOT NULL THEN round(CAST({many(1)} AS INT) * {_base(many(2), many(3))}, 2)
            WHEN {one(1)} IS NOT NULL THEN round({_base(one(1), one(2))}, 2) ELSE CAST({pieces} AS DOUBLE) END""",
        "size_unit(t STRING) RETURNS STRING": f"CASE WHEN {many(1)} IS NOT NULL THEN {kind(many(3))} WHEN {one(1)} IS NOT NULL THEN {kind(one(2))} WHEN {pieces} IS NOT NULL THEN 'count' END",
        "weight_g(t STRING) RETURNS DOUBLE": f"CASE WHEN {heavy(1)} IS NOT NULL THEN CAST({heavy(1)} AS DOUBLE) * {_base(heavy(2), heavy(3))} ELSE {_base(light(1), light(2))} END",
        "unit_price(price DOUBLE, grams DOUBLE) RETURNS DOUBLE": "round(price / nullif(grams, 0) * 100, 4)",
        "deal(difference DOUBLE, percent DOUBLE, most DOUBLE) RETURNS STRING": "CASE WHEN difference <= -most AND percent <= -5 THEN 'Good deal' WHEN difference >= most AND percent >= 5 THEN 'Overpriced' ELSE 'Normal price' END",
        "price_text(price DOUBLE) RETURNS STRING": "CASE WHEN price IS NULL THEN '—' ELSE format_string('$%.2f', price) END",
    }


def register(spark: SparkSession) -> None:
    """Make the functions known to the session by their names."""
    for head, body in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("name_ratio", text._indel_ratio)
