"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts its digests into a run with one entry per text. Runs then travel in rounds of
a binomial exchange: in round r the partitions whose numbers differ in digit r alone swap parts of
their runs, each keeping the digests that share its own digit. Every receiver merges the incoming
runs and retains the smallest identifier, so a text that fills a third of the corpus is one entry
per partition from the first step on, and after the last round each entry stands in one partition
only. No partition ever holds more than its share of the distinct digests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sha256_binary, table, without_rows

#: Partitions that exchange runs with each other in one round.
FAN = 8

RUN = "digest binary, n_bytes long, check long, keep_doc long, keep_uid long, group_size long"


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a key of the text as it stands, uid and the fingerprint of each row's normalised text."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), text.alias("t")).select(
        "doc_id",
        "text_key",
        F.monotonically_increasing_id().alias("uid"),
        sha256_binary(F.col("t")).alias("digest"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def _fold(batches):
    """Merge sorted entries: equal neighbours become one, the first (the smallest id) stays."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)  # without flags such as not null
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        digest = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint64).reshape(-1, 4)
        check = np.column_stack([digest, *(rows.column(c).to_numpy().view(np.uint64) for c in ("n_bytes", "check"))])
        first = np.flatnonzero(np.r_[True, (check[1:] != check[:-1]).any(axis=1)])
        sizes = np.add.reduceat(rows.column("group_size").to_numpy(), first)
        out = rows.take(pa.array(first))
        out = out.set_column(out.schema.get_field_index("group_size"), "group_size", pa.array(sizes, pa.int64())).combine_chunks()
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).to_batches()
        held = out.slice(out.num_rows - 1).combine_chunks().to_batches()[0]
    if held is not None:
        yield held


def merged_runs(prints: DataFrame) -> DataFrame:
    """One entry per text: its fingerprint, the smallest (doc_id, uid) and the number of rows.

    An entry is merged only with one of the same SHA-256, length and second hash, at every level.
    """
    order = ["digest", "n_bytes", "check", F.asc_nulls_last("keep_doc"), "keep_uid"]
    run = prints.select("digest", "n_bytes", "check", F.col("doc_id").alias("keep_doc"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("group_size"))
    run = run.sortWithinPartitions(*order).mapInArrow(_fold, RUN)
    wanted, rounds = max(prints.rdd.getNumPartitions(), prints.sparkSession.sparkContext.defaultParallelism), 2
    while FAN**rounds < wanted:
        rounds += 1
    places = FAN**rounds
    for r in range(rounds):
        step = FAN**r
        own = F.pmod(F.spark_partition_id(), F.lit(places))
        digit = F.floor(F.pmod("check", F.lit(places)) / step) % FAN
        there = own - (F.floor(own / step) % FAN) * step + digit * step
        run = run.withColumn("there", there.cast("int")).repartitionById(places, "there").drop("there")
        run = run.sortWithinPartitions(*order).mapInArrow(_fold, RUN)
    return run


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: Scratch, how: str) -> DataFrame:
    prints = keep(fingerprints(docs, id_col, text_col), "digests")
    several = keep(merged_runs(prints).filter("group_size > 1"), "copies")
    # a hot text's rows meet one entry here, which adaptive execution splits among tasks
    return prints.join(several, ["digest", "n_bytes", "check"], how).select(
        "doc_id",
        "text_key",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_doc")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        "digest",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every row, dropped ones too.

    Texts are equal when identical after replacing each run of ASCII white space by one space; null
    counts as empty. Texts may be of any length. Of equal texts the row with the smallest doc_id stays
    (null ids come last). If that row is repeated, one of the copies stays. An empty table gives an
    empty result; columns of ``docs`` other than the two named are not read.
    """
    with Scratch(docs.sparkSession) as keep:
        return keep.finish(_grouped(docs, id_col, text_col, keep, "left").drop("text_key"), "exact-groups")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; equal texts as in ``exact_groups``.

    Columns may have any names. Of rows with one id and text one stays if their group keeps it,
    whichever of them (their other columns may differ). All null and empty texts are one group. An
    empty table stays empty.
    """
    with Scratch(docs.sparkSession) as keep:
        rows = keep.finish(_grouped(docs, id_col, text_col, keep, "inner").select("doc_id", "text_key", "kept"), "exact-copies")
    return without_rows(docs, rows, id_col, text_col)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
"""
