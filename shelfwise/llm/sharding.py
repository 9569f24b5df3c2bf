"""Balanced shards by longest-processing-time scheduling of groups that stay together.

Groups are sorted by size, largest first, and each goes to the least loaded shard, which a heap
finds. Groups of one size are interchangeable, so the scheduler reads them as (size, count) classes
and hands each shard a run of them: exactly the steps of the plain heap, taken together. A class is
cut at the borders of the range partitions that sort the groups, so neither a group nor a size that
fills a third of the corpus has to be ranked in one task, and the scheduler's memory is the heap.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sha256_binary, table

#: Parts of a shard that are numbered on their own; bounds the table of their sizes.
CELLS = 64


def take_class(heap: list[tuple[int, int]], size: int, count: int) -> list[int]:
    """Give ``count`` groups of ``size`` to the least loaded shards; returns how many each one got.

    ``heap`` holds (load, shard). Equal loads go to the smaller shard number.
    """
    shards = len(heap)
    got = [0] * shards
    while count:
        load, shard = heap[0]
        if count >= shards and max(heap)[0] - load < size:
            # from here each shard is served once a round, in the same order
            rounds = count // shards
            heap[:] = [(at + rounds * size, s) for at, s in heap]
            got = [n + rounds for n in got]
            count -= rounds * shards
            continue
        turns = count
        if shards > 1:
            next_load, next_shard = min(heap[1:3])
            ahead = next_load - load
            turns = (ahead if shard < next_shard else ahead - 1) // size + 1
        turns = min(count, max(1, turns))
        heapq.heapreplace(heap, (load + turns * size, shard))
        got[shard] += turns
        count -= turns
    return got


def _schedule(shards: int):
    def run(frames):
        heap = [(0, s) for s in range(shards)]
        for frame in frames:
            ends = []
            for size, count in zip(frame["bytes"].tolist(), frame["n"].tolist()):
                total, row = 0, []
                for n in take_class(heap, size, count):
                    total += n
                    row.append(total)
                ends.append(row)
            yield pd.DataFrame({"bytes": frame["bytes"], "part": frame["part"], "ends": ends})

    return run


def lpt_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Size is the text's UTF-8 bytes plus 1. Rows of equal text share a shard (null and empty texts
    count as equal); the sizes of the shards are as near as longest-processing-time scheduling gets.
    Slots number a shard's rows from 0 without gaps, in no particular order. Repeated rows each get a
    slot. Null ids are kept. An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), sha256_binary(text).alias("digest"), F.monotonically_increasing_id().alias("uid")),
        "sizes",
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("bytes"), F.asc("digest")]
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "groups")
    classes = groups.groupBy("bytes", "part").agg(F.count("*").alias("n"))
    runs = classes.repartition(1).sortWithinPartitions(F.desc("bytes"), "part").mapInPandas(_schedule(shards), "bytes long, part int, ends array<long>")
    at = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("digest"))
    placed = materialize(
        groups.withColumn("_at", at).join(runs, ["bytes", "part"]).select("digest", F.size(F.filter("ends", lambda x: x < F.col("_at"))).alias("shard")),
        "placed",
    )
    cell = F.pmod(F.xxhash64("uid", "doc_id"), F.lit(CELLS)).cast("int").alias("cell")
    rows = materialize(rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard", "uid", cell), "sharded")
    sizes = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    sizes = sizes.select("shard", "cell", before.alias("base"))  # at most shards * CELLS rows
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("uid")) - 1
    return rows.withColumn("number", number).join(F.broadcast(sizes), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number")).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
