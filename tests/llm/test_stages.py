"""Every pipeline stage on awkward tables: nulls, repeats, long texts, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import exact_dedup, minhash
from shelfwise.llm.common import without_rows

CLASHES = "_n _digest _own_digest _keep_id _own_key _keep_key uid row key left word bits p n kept doc_key text_key id".split()
LONG = " ".join(f"w{i % 997}" for i in range(30000))


def tables(spark, folder, rows, labels=((1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None)), items=((1, "ten words that no text here has at all ever"), (2, None), (None, "b"))):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "one two three four five six seven", "a"), (4, "one two  three four five six seven", "a"), (4, "one two  three four five six seven", "b"),
    (None, "one two three four five six seven", "a"), (None, "only here without an id", "a"), (None, "only here without an id", "a"), (5, LONG, "a"), (6, LONG + " more", "a"),
    (7, LONG, "a"), (8, "ok", None), (8, "ok", None), (9, "x b y", "a"), (None, None, None),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, tmp_path, name, stage):
    docs = tables(spark, tmp_path, ROWS)
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    ids = sorted((x.doc_id is None, x.doc_id or 0) for x in got)
    of = lambda *x: sorted((i is None, i or 0) for i in x)
    if name == "bpe":
        assert ids == of(*[r[0] for r in ROWS])
        return
    assert out.columns == docs.columns
    assert all(x[c] == f"own {c}" for x in got for c in CLASHES)
    if name == "exact_dedup":
        assert ids == of(1, 3, None, 5, 6, 8, 9)
    elif name == "near_dedup":
        assert ids == of(1, 2, 3, None, None, 5, 8, 9)
    elif name == "decontamination":
        assert ids == of(*[r[0] for r in ROWS if r[0] != 9])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, tmp_path, name, stage):
    docs = tables(spark, tmp_path, [], [], [])
    out = stage(spark, docs, str(tmp_path))
    assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_whole_pipeline_on_awkward_rows(spark, tmp_path):
    tables(spark, tmp_path, ROWS)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == [(False, 1), (False, 3), (False, 5), (False, 8), (True, 0)]


def test_full_maps_drop_no_other_row(spark, monkeypatch):
    """With a map of 64 bits nearly every row is asked for, and still only the named ones go."""
    from shelfwise.llm import common

    monkeypatch.setattr(common, "DROP_BITS", 64)
    docs = spark.createDataFrame([(i % 300 if i % 7 else None, f"text {i % 250}", i) for i in range(900)], "doc_id long, text string, n int")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), (F.col("n") % 3 == 0).alias("kept"))
    want = {}
    for x in docs.collect():
        want.setdefault((x.doc_id, x.text), []).append(x.n % 3 == 0)
    want = sorted((k[0] is None, k[0] or 0, k[1]) for k, v in want.items() for _ in range(len(v) if all(v) else min(1, sum(v))))
    got = sorted((x.doc_id is None, x.doc_id or 0, x.text) for x in without_rows(docs, rows, "doc_id", "text").collect())
    assert got == want


def test_extra_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, "other words", 7)], "doc_id long, text string, _n int")
    for drop in (exact_dedup.drop_exact, minhash.drop_near):
        assert sorted(map(tuple, drop(docs).collect())) == [(1, "a b c d e f", 5), (3, "other words", 7)]
