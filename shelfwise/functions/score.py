"""Scores of product pairs, as column expressions over two parsed products ``a`` and ``b``."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import vocabulary as V


@dataclass(frozen=True)
class Scoring:
    """Parameters of one kind of goods."""

    weights: tuple[float, ...]
    #: one brand missing, both missing
    no_brand: tuple[float, float]
    #: (largest relative difference, score), in order
    sizes: tuple[tuple[float, float], ...]
    #: pieces of a pack may differ by so much, if at all looked at
    piece_tolerance: float | None
    #: penalties: brand, size, variant and packaging conflicts, and a poor title below a limit
    penalties: tuple[float, float, float, float, float]
    poor_title: float
    strong: tuple[float, float]
    review: float
    least_size_ratio: float
    #: whether pairs need the same pack count, and two shared words unless the brands are equal
    strict: bool
    stopwords: tuple[str, ...]
    packaging: dict
    variants: list
    brands: dict
    prefixes: tuple[str, ...]
    counts: bool
    keep: str = ""


# Weights, limits and penalties of the two kinds of goods.
PACKAGED = Scoring(
    (0.30, 0.30, 0.25, 0.10, 0.05), (0.45, 0.3), ((0.02, 1.0), (0.05, 0.88), (0.12, 0.7)), 0.03, (0.25, 0.25, 0.2, 0.08, 0.12), 0.68, (0.93, 0.82), 0.80, 0.7, True,
    tuple(V.PACKAGED_STOPWORDS), V.PACKAGED_PACKAGING, V.PACKAGED_VARIANTS, V.PACKAGED_BRANDS, tuple(T.PACKAGED_PREFIXES), True,
)
MEAT = Scoring(
    (0.20, 0.30, 0.35, 0.10, 0.05), (0.5, 0.4), ((0.02, 1.0), (0.10, 0.85), (0.20, 0.65)), None, (0.20, 0.25, 0.25, 0.05, 0.15), 0.65, (0.90, 0.78), 0.78, 0.6, False,
    tuple(V.MEAT_STOPWORDS), V.MEAT_PACKAGING, V.MEAT_VARIANTS, V.MEAT_BRANDS, tuple(T.MEAT_PREFIXES), False, T.CHINESE,
)


def _overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def _differ(x: Column, y: Column) -> Column:
    """Difference relative to the larger."""
    return F.abs(x - y) / F.nullif(F.greatest(x, y), F.lit(0.0))


def brand_score(a, b, s: Scoring) -> Column:
    x, y = a("brand_key"), b("brand_key")
    return (
        F.when(x.isNull() & y.isNull(), s.no_brand[1])
        .when(x.isNull() | y.isNull(), s.no_brand[0])
        .when(x == y, 1.0)
        .when(_overlap(a("brand_words"), b("brand_words")), 0.8)
        .otherwise(0.0)
    )


def size_score(a, b, s: Scoring) -> Column:
    x, y = a("size.total"), b("size.total")
    packs = (a("size.count") != b("size.count")) & ((a("size.count") > 1) | (b("size.count") > 1)) & (a("size.count") > 0) & (b("size.count") > 0)
    out = F.when(x.isNull() | y.isNull(), 0.55).when(a("size.unit") != b("size.unit"), 0.0).when(packs, 0.0)
    if s.piece_tolerance is not None:
        each = _differ(a("size.each"), b("size.each"))
        out = out.when((F.greatest(a("size.each"), b("size.each")) == 0) | (each > s.piece_tolerance), 0.0)
    for most, score in s.sizes:
        out = out.when(_differ(x, y) <= most, score)
    return out.otherwise(0.0)


def title_from(tokens_a: Column, tokens_b: Column, ratio: Column, sorted_ratio: Column, plain: Column, weights=(0.45, 0.35, 0.20)) -> Column:
    """Title score of core tokens from ratios computed before; ``plain`` where a side has no tokens."""
    empty = (F.size(tokens_a) == 0) | (F.size(tokens_b) == 0)
    return F.when(empty, plain).otherwise(weights[0] * sorted_ratio + weights[1] * ratio + weights[2] * T.jaccard(tokens_a, tokens_b))


def variant_score(a, b) -> Column:
    x, y = a("variants"), b("variants")
    none_x, none_y = F.size(x) == 0, F.size(y) == 0
    return F.when(none_x & none_y, 0.7).when(none_x | none_y, 0.35).when(x == y, 1.0).when(_overlap(x, y), 0.6).otherwise(0.0)


def packaging_score(a, b) -> Column:
    x, y = a("packaging"), b("packaging")
    return F.when(x.isNull() & y.isNull(), 0.7).when(x.isNull() | y.isNull(), 0.5).when(x == y, 1.0).otherwise(0.0)


#: Penalties by the step of ``price_step``.
PRICE_PAYS = (0.0, 0.10, 0.18)


def price_step(a, b) -> Column:
    """1, or 2 or 3 for prices per size that differ by more than 2.5 or 4 times: places of PRICE_PAYS."""
    known = (a("price_sgd") != 0) & (b("price_sgd") != 0) & (a("size.total") != 0) & (b("size.total") != 0) & (a("size.unit") == b("size.unit"))
    x, y = a("price_sgd") / F.nullif(a("size.total"), F.lit(0.0)), b("price_sgd") / F.nullif(b("size.total"), F.lit(0.0))
    ratio = F.greatest(x, y) / F.nullif(F.least(x, y), F.lit(0.0))
    return F.when(known & (ratio > 4), 3).when(known & (ratio > 2.5), 2).otherwise(1)


def price_penalty(a, b) -> Column:
    return F.element_at(F.array(*map(F.lit, PRICE_PAYS)), price_step(a, b))


def variant_conflict(a, b) -> Column:
    return (F.size(a("variants")) > 0) & (F.size(b("variants")) > 0) & ~_overlap(a("variants"), b("variants"))


def likely(a, b, s: Scoring) -> Column:
    """Whether a pair of different stores is worth scoring; what costs least is asked first."""
    brand = brand_score(a, b, s)
    both = a("brand_key").isNotNull() & b("brand_key").isNotNull()
    x, y = a("size.total"), b("size.total")
    sized = F.coalesce((x != 0) & (y != 0) & (a("size.unit") == b("size.unit")), F.lit(False))
    far = sized & (F.least(x, y) / F.nullif(F.greatest(x, y), F.lit(0.0)) < s.least_size_ratio)
    shared = F.size(F.array_intersect(a("core"), b("core")))
    out = ~far & ~(both & (brand == 0))
    if s.strict:
        packs = sized & (a("size.count") != b("size.count")) & ((a("size.count") > 1) | (b("size.count") > 1)) & (a("size.count") > 0) & (b("size.count") > 0)
        return F.coalesce(out & ~F.coalesce(packs, F.lit(False)) & ((brand >= 1.0) | (shared >= 2)), F.lit(False))
    return F.coalesce(out & ((brand >= 0.8) | (shared > 0)), F.lit(False))


def size_cells(s: Scoring) -> tuple[Column, Column]:
    """Cells of a row as the first and as the second of a pair: pairs that can pass meet in just one.

    Two known sizes must have one unit and differ by no more than the last step of the size score, as a
    pair without any size score cannot reach the review limit: cells are bands of that width, and the
    first row stands in the neighbouring ones too. A row without a size meets all rows.
    """
    w, most = s.weights, s.sizes[-1][0]
    if w[0] + w[2] + w[3] + w[4] - s.penalties[1] >= s.review:
        return F.array(F.lit("*")), F.array(F.lit("*"))
    total, unit = F.col("size.total"), F.coalesce("size.unit", F.lit(""))
    # a little wider than needed, so that rounding moves no pair two bands apart
    band = F.floor(F.log(total) / (-math.log(1 - most) * 1.0001))
    cell = lambda step: F.concat_ws(":", unit, (band + step).cast("string"))
    first = F.when(total.isNull(), F.array(F.lit("unsized a"))).when(total > 0, F.array(cell(-1), cell(0), cell(1), F.lit("unsized b")))
    second = F.when(total.isNull(), F.array(F.lit("unsized a"), F.lit("unsized b"))).when(total > 0, F.array(cell(0), F.lit("unsized a"))).otherwise(F.array(F.lit("unsized a")))
    return F.coalesce(first, F.array(F.lit("unsized b"))), second


def penalties(s: Scoring, scores: dict[str, Column], sized: Column, variants_differ: Column, price: Column) -> list[tuple[str, Column]]:
    """What is taken off for each conflict; ``sized`` tells whether both sizes are known."""
    brand, size, variant, packaging, title = s.penalties
    pay = lambda when, value: F.when(when, value).otherwise(0.0)
    return [
        ("brand_conflict", pay(scores["brand"] == 0, brand)),
        ("size_conflict", pay((scores["size"] == 0) & sized, size)),
        ("variant_conflict", pay(variants_differ, variant)),
        ("packaging_conflict", pay(scores["packaging"] == 0, packaging)),
        ("low_title_similarity", pay(scores["title"] < s.poor_title, title)),
        ("unit_price_outlier", price),
    ]


def total(values) -> Column:
    out = None
    for v in values:
        out = v if out is None else out + v
    return out


def status(final: Column, title: Column, strong: tuple[float, float], review: float) -> Column:
    return F.when((final >= strong[0]) & (title >= strong[1]), "strong_match").when(final >= review, "review").otherwise("no_match")


def explanation(scores: list[tuple[str, Column]], pays: list[tuple[str, Column]]) -> Column:
    bits = [F.format_string(f"{name}=%.2f", value) for name, value in scores]
    paid = F.concat_ws(",", *[F.when(v > 0, F.format_string(f"{n}:%.2f", v)) for n, v in pays])
    return F.concat_ws("; ", *bits, F.when(paid != "", F.concat(F.lit("penalties="), paid)))
