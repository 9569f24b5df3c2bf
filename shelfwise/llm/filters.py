"""How filters of texts interact, by looking up first failures.

Every document has a mask of the filters that it fails. In a given order of the filters it goes at the
first one that it fails, so a table with a row for each mask and a column for each order tells the step
at which it goes. Masks are looked up batch by batch and counted by part, order and step, apart for
labels; the counts of all tasks are then added.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, Scratch, batches_by_bytes, sha256_binary, table, text_bytes, words

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Step of the first failure of a mask (bit i: fails filter i) in an order; len(FILTERS) if it fails none.
FIRST = np.array([[next((s for s, f in enumerate(o) if m >> FILTERS.index(f) & 1), len(FILTERS)) for o in ORDERS] for m in range(1 << len(FILTERS))], np.int64)
COPY = 1 << FILTERS.index("E")

#: Fixed values of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"

#: Parts whose counts a task holds before it passes them on.
HELD = 256


def failures(texts: pa.Array) -> np.ndarray:
    """Mask of the filters A to D that each whole text fails; null counts as empty."""
    raw, at = text_bytes(texts)
    n = len(at) - 1
    coded, word_at, _ = words(raw, at, SPACED)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.diff(word_at)
    owner = np.repeat(np.arange(n), n_words)
    distinct = np.bincount(np.unique(owner * max(1, len(coded.dictionary)) + codes) // max(1, len(coded.dictionary)), minlength=n)

    def count(flags: np.ndarray) -> np.ndarray:
        out, some = np.zeros(n, np.int64), at[:-1] < at[1:]
        if some.any():
            out[some] = np.add.reduceat(flags, at[:-1][some], dtype=np.int64)
        return out

    capitals = count((raw >= ord("A")) & (raw <= ord("Z")))
    points = count((raw & 0xC0) != 0x80)
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    failed = [n_words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n_words, 100 * capitals > CAPITALS_PERCENT * points, count(symbols[raw]) > 0]
    return sum(f.astype(np.int64) << i for i, f in enumerate(failed))


def _masks(batches):
    for batch in batches_by_bytes(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("digest"), pa.array(failures(batch.column("text")), pa.int64())], ["doc_id", "part", "digest", "mask"])


COUNTS = ["removed", "good_lost", "toxic_lost", "failing", "unique_fails", "total"]


def _audit(batches):
    """Counts of a task by part, order and step: removed there, of these good and toxic, failing and failing only its filter."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        names = coded.dictionary.to_pylist()
        part = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mask = batch.column("mask").to_numpy()
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
        # alike rows are looked up once
        kinds, n = np.unique(((part * len(FIRST) + mask) * 2 + good) * 2 + toxic, return_counts=True)
        good, toxic, mask, part = kinds // 2 % 2, kinds % 2, kinds // 4 % len(FIRST), kinds // (4 * len(FIRST))
        for low in range(0, len(names), HELD):
            own = (part >= low) & (part < low + HELD)
            for name, counts in zip(names[low : low + HELD], _counted(part[own] - low, mask[own], good[own], toxic[own], n[own], min(HELD, len(names) - low))):
                held[name] = held[name] + counts if name in held else counts
            if len(held) > HELD:
                yield from _rows(held)
    yield from _rows(held)


def _counted(part, mask, good, toxic, n, parts: int) -> np.ndarray:
    """For each part an array (order, step, count) of COUNTS."""
    steps, orders = len(FILTERS), len(ORDERS)
    out = np.zeros((parts, orders, steps, len(COUNTS)), np.int64)
    at = ((part[:, None] * orders + np.arange(orders)) * (steps + 1) + FIRST[mask]).ravel()
    for i, weight in enumerate((n, n * good, n * toxic)):
        # sums of whole numbers below 2**53 are exact
        sums = np.bincount(at, np.repeat(weight, orders), minlength=parts * orders * (steps + 1)).reshape(parts, orders, steps + 1)
        out[..., i] = sums[..., :steps]
    letter = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    for i, f in enumerate(FILTERS):
        here = letter == i
        out[:, here, 3] = np.bincount(part, n * (mask >> i & 1), minlength=parts).astype(np.int64)[:, None]
        out[:, here, 4] = np.bincount(part, n * (mask == 1 << i), minlength=parts).astype(np.int64)[:, None]
    out[..., 5] = np.bincount(part, n, minlength=parts).astype(np.int64)[:, None, None]
    return out


def _rows(held: dict[str, np.ndarray]):
    """The held counts as rows; forgets them."""
    orders, steps = np.repeat(np.arange(len(ORDERS)), len(FILTERS)), np.tile(np.arange(len(FILTERS)), len(ORDERS))
    for name, counts in held.items():
        flat = counts.reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat), pa.string()), pa.array(orders, pa.int32()), pa.array(steps, pa.int32()), *(pa.array(flat[:, i]) for i in range(len(COUNTS)))], ["part", "order_no", "step_no", *COUNTS])
    held.clear()


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the five filters and step: what the filter of that step keeps, removes and costs.

    The filters: A under 100 words; B 100 * distinct words < 80 * words; C 100 * capitals (A-Z) > 10 *
    characters; D any of ``#$%&*|``; E equal to the text of a row with a smaller id, anywhere in the
    table and removed or not. Null texts count as empty (and equal each other), null parts as the empty
    string. A null id is neither smaller nor larger than any; rows with one id and text are no copies of
    each other. A document is good (toxic) if any of its labels has quality (toxic) 1; null labels and
    labels of no document do not count. Texts may be of any length. An empty table has no part and so no
    row; further columns are not read.
    """
    with Scratch(docs.sparkSession) as keep:
        read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        rows = keep(read.withColumn("digest", sha256_binary(F.col("text"))).mapInArrow(_masks, "doc_id long, part string, digest binary, mask long"), "filter-masks")
        # only texts with several ids have copies; a hot text is one row here
        copied = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
        copied = keep(copied, "copied-texts")  # a side of its own, so that a hot text's rows are split among tasks in the join
        marks = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        known = rows.join(copied, "digest", "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
        no = F.lit(False)
        known = known.select("part", (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), COPY).otherwise(0)).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
        partial = known.mapInArrow(_audit, "part string, order_no int, step_no int, " + ", ".join(f"{c} long" for c in COUNTS))
        total = partial.groupBy("part", "order_no", "step_no").agg(*[F.sum(c).alias(c) for c in COUNTS])
        orders = F.array(*map(F.lit, ORDERS))
        total = total.withColumn("filter_order", orders[F.col("order_no")]).withColumn("step", F.col("step_no") + 1)
        # parts times 600 rows from here on
        order = Window.partitionBy("part", "filter_order").orderBy("step")
        of_filter = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
        return keep.finish(
            total.select(
                "part",
                "filter_order",
                "step",
                (F.col("total") - F.sum("removed").over(order)).alias("kept"),
                "removed",
                (F.col("failing") - F.col("removed")).alias("redundant"),
                "unique_fails",
                "good_lost",
                "toxic_lost",
                F.sum("removed").over(of_filter).alias("shapley"),
            ),
            "filter-audit",
        )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by language, with the given labels."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 100,
          'B': 100 * len(list_distinct(w)) < 80 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false)} AS f
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), masks AS (
  SELECT part, good, toxic, concat(if(f.A, 'A', ''), if(f.B, 'B', ''), if(f.C, 'C', ''), if(f.D, 'D', ''), if(f.E, 'E', '')) AS m, count(*) AS n
  FROM fails GROUP BY ALL
), perms(o) AS (
  SELECT '' UNION ALL
  SELECT o || f FROM perms, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before
  FROM perms, range(1, 6) r(s) WHERE length(o) = 5
), counted AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (translate(m, before || f, '') = m) AS kept,
         sum(n) FILTER (contains(m, f) AND translate(m, before, '') = m) AS removed,
         sum(n) FILTER (contains(m, f) AND translate(m, before, '') <> m) AS redundant,
         sum(n) FILTER (m = f) AS unique_fails,
         sum(n) FILTER (contains(m, f) AND translate(m, before, '') = m AND good) AS good_lost,
         sum(n) FILTER (contains(m, f) AND translate(m, before, '') = m AND toxic) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM counted
"""
