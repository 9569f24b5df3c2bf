"""Names, brands, variants and sizes of listings, as column expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import vocabulary as V
from .clean import looked_up

NUMBER = r"^\d+(\.\d+)?$"
#: Words of units and noise that are no part of a name.
UNIT_WORDS = ["ml", "l", "g", "kg", "x", "s"]
PRODUCE_UNIT_WORDS = ["g", "kg", "ml", "l", "x", "pcs", "pc"]
PRODUCE_NOISE = ["fresh", "premium", "prepacked", "pack", "local", "imported", "pesticide", "free", "seedless", "organic", "bio", "natural", "reared", "sg"]
#: First words that are no brand without the second.
PACKAGED_PREFIXES, MEAT_PREFIXES = ["100", "old", "mr", "dr"], ["le", "mr", "st"]


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def _symbols(value: Column) -> Column:
    lower = F.lower(F.coalesce(value, F.lit("")))
    return F.replace(F.replace(lower, F.lit("×"), F.lit(" x ")), F.lit("&"), F.lit(" and "))


def normalize_text(value: Column, keep: str = "") -> Column:
    """Lower case; only ASCII letters, digits, points and ``keep`` stay; null becomes empty."""
    return squeeze(F.regexp_replace(_symbols(value), rf"[^a-z0-9\.\s{keep}]", " "))


def normalize_loose(value: Column) -> Column:
    """Lower case without brackets, slashes and the like; all other characters stay."""
    return squeeze(F.regexp_replace(_symbols(value), r"[\(\)\[\],/+\-]", " "))


#: Chinese characters, which names of meat keep.
CHINESE = "一-鿿"


def tokens_of(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def normalize_brand(brand: Column, name: Column, aliases: dict[str, str], prefixes: list[str], keep: str = "") -> Column:
    """The brand, or the name's first words where it is missing; aliases replaced; null if nothing is left."""
    words = tokens_of(normalize_text(name, keep))
    first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    guess = F.when(first.isin(prefixes) & second.isNotNull(), F.concat_ws(" ", first, second)).otherwise(first)
    own = F.coalesce(F.nullif(normalize_text(brand, keep), F.lit("")), guess)
    return F.coalesce(looked_up(own, aliases), own)


def _phrases(group: list[str]) -> str:
    return "|".join(re.escape(x).replace(r"\ ", " ").replace(r"\-", "-") for x in sorted(group, key=len, reverse=True))


def variants(normal: Column, groups: list[list[str]], boundary: bool = False) -> Column:
    """Sorted names of the groups with a phrase in the text; a group is named by its first phrase in order.

    Phrases stand between white space, or between word boundaries if ``boundary``.
    """
    edge = (r"\b", r"\b") if boundary else (r"(^|\s)", r"($|\s)")
    found = F.array(*[F.when(normal.rlike(f"{edge[0]}({_phrases(g)}){edge[1]}"), sorted(g)[0]) for g in groups])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def first_label(tokens: Column, labels: dict[str, list[str]]) -> Column:
    """The first label one of whose words is among the tokens."""
    return F.coalesce(*[F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, ws))), label) for label, ws in labels.items()])


def size_of(text: Column, counts: bool = True, keep: str = "") -> Column:
    """Size as struct (total, unit, count, display, each), in g and ml.

    Forms: ``6 x 200ml``, then ``1.5l``, then with ``counts`` also ``20 s``; else all fields are null.
    Nothing need end after the unit.
    """
    normal = normalize_text(text, keep)
    many = r"(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*(ml|l|g|kg)"
    one = r"(\d+(?:\.\d+)?)\s*(ml|l|g|kg)"
    pieces = r"(\d+)\s*s\b"
    pick = lambda pattern, i: F.nullif(F.regexp_extract(normal, pattern, i), F.lit(""))

    def sized(n: Column, value: Column, unit: Column, prefix: Column) -> Column:
        v = value.cast("double")
        base = F.when(unit.isin("l", "kg"), v * 1000).otherwise(v)
        plain = F.regexp_replace(v.cast("string"), r"\.0$", "")
        return F.struct(F.round(base * n, 2).alias("total"), F.when(unit.isin("l", "ml"), "ml").otherwise("g").alias("unit"), n.cast("int").alias("count"), F.concat(prefix, plain, unit).alias("display"), F.round(base, 2).alias("each"))

    n = pick(many, 1)
    k = pick(pieces, 1)
    none = F.struct(F.lit(None).cast("double").alias("total"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("int").alias("count"), F.lit(None).cast("string").alias("display"), F.lit(None).cast("double").alias("each"))
    counted = F.struct(k.cast("double").alias("total"), F.lit("count").alias("unit"), k.cast("int").alias("count"), F.concat(k.cast("int").cast("string"), F.lit("s")).alias("display"), F.lit(1.0).alias("each"))
    out = F.when(n.isNotNull(), sized(n.cast("int"), pick(many, 2), pick(many, 3), F.concat(n.cast("int").cast("string"), F.lit(" x "))))
    out = out.when(pick(one, 1).isNotNull(), sized(F.lit(1), pick(one, 1), pick(one, 2), F.lit("")))
    if counts:
        out = out.when(k.isNotNull(), counted)
    return out.otherwise(none)


def size_source(unit: Column, name: Column) -> Column:
    """The unit if there is one, even one that says nothing, else the name."""
    return F.coalesce(F.nullif(unit, F.lit("")), name)


def core_tokens(tokens: Column, brand: Column, stopwords: list[str], units: list[str] = UNIT_WORDS) -> Column:
    """Tokens without stop words, the brand's words, numbers and units; order and repeats stay."""
    drop = F.array(*[F.lit(x) for x in [*stopwords, *units]])
    own = F.split(F.coalesce(brand, F.lit("")), " ")
    return F.filter(tokens, lambda t: ~F.array_contains(drop, t) & ~F.array_contains(own, t) & ~t.rlike(NUMBER))


def strip_labels(normal: Column, labels: list[str] = V.PRIVATE_LABELS) -> Column:
    """The text without labels of single stores, taken out one by one, the longest first."""
    for label in sorted(labels, key=len, reverse=True):
        normal = F.regexp_replace(normal, rf"\b{label}\b", "")
    return squeeze(normal)


def first_match(text: Column, pairs: list[tuple[str, str]], contains: bool = False) -> Column:
    """The result of the first pair (pattern, result) that the text matches, or contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)) if contains else text.rlike(p), r) for p, r in pairs])


def origin_of(normal: Column) -> Column:
    """Origin by the longest word that tells one."""
    return first_match(normal, [(rf"\b{k}\b", V.ORIGINS[k]) for k in sorted(V.ORIGINS, key=lambda k: -len(k))])


def produce_type(normal: Column) -> Column:
    return first_match(normal, [(rf"\b({'|'.join(words)})\b", kind) for kind, words in V.PRODUCE_TYPES.items()])


def cut_of(normal: Column) -> Column:
    """The first cut, meats before produce, one of whose phrases is anywhere in the text."""
    return first_match(normal, [("|".join(words), cut) for cut, words in [*V.MEAT_CUTS.items(), *V.PRODUCE_CUTS.items()]])


def is_frozen(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(V.FROZEN_WORDS)), F.lit(False))


def weight_g(text: Column) -> Column:
    """Weight in grams of ``2 x 500g`` or ``1.5 kg``, null if none is told."""
    normal = normalize_loose(text)
    many, one = r"(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*(g|kg)", r"(\d+(?:\.\d+)?)\s*(g|kg)\b"
    pick = lambda pattern, i: F.nullif(F.regexp_extract(normal, pattern, i), F.lit(""))
    grams = lambda value, unit: value.cast("double") * F.when(unit == "kg", 1000.0).otherwise(1.0)
    return F.when(pick(many, 1).isNotNull(), pick(many, 1).cast("double") * grams(pick(many, 2), pick(many, 3))).otherwise(grams(pick(one, 1), pick(one, 2)))


def listing_weight_g(unit: Column, name: Column) -> Column:
    """The unit's weight, or the name's where that is missing or 0; null unless positive."""
    w = F.coalesce(F.nullif(weight_g(unit), F.lit(0.0)), weight_g(name))
    return F.when(w > 0, w)


@lru_cache(1 << 17)
def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the usual table as the bits of one number."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        met = row & at.get(x, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _rated(pair: tuple[str | None, str | None]) -> float | None:
    a, b = pair
    if a is None or b is None:
        return None
    return 1.0 if a == b else 2.0 * common_length(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a, b))
    rated = {x: _rated(x) for x in set(pairs)}
    return pd.Series([rated[x] for x in pairs], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    """Indel similarity from 0 to 1: twice the common subsequence over both lengths; 1 for two empty texts, null for null.

    No built-in function expresses it in time linear in one text, so it runs on Arrow batches, once for
    each distinct pair of a batch.
    """
    return _indel_ratio(a, b)


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens_of(text)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
