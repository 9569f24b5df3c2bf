"""Listings and events as streams. The batch marts need none of this; it keeps them fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.listings import RAW, unify
from ..sources.sinks import missing
from ..sources.versions import Table


def unified_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New raw files of a folder in the unified schema, each listing once within a day's delay."""
    raw = spark.readStream.schema(RAW).option("multiLine", True).json(folder)
    timed = unify(raw).withColumn("scraped_at", F.col("scraped_at").try_cast("timestamp"))
    return timed.withWatermark("scraped_at", "1 day").dropDuplicatesWithinWatermark(["name", "store", "scraped_at"])


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Insert what the table (``sources.versions``) lacks, for all files there are now.

    A micro-batch adds one version with its new rows alone; one that is tried again adds none twice.
    """

    def insert(batch: DataFrame, _: int) -> None:
        new = lambda known: missing(known, batch, ["name", "store", "scraped_at"], ["product_url"])
        Table(batch.sparkSession, table).append(new, batch.schema)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per day and type, by a tumbling window; works on streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")
