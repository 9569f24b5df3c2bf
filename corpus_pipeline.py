"""Corpus preparation in stages, each an operator of shelfwise.llm.

Toxic documents go first; of equal and of near-equal documents one stays; documents that hold a
benchmark passage go; what remains is encoded and decoded. Each stage works on all that the one before
kept, and all but the last keep the columns of ``documents``. ``run`` writes every stage's result to
the shared folder and reads it again, so no stage is computed twice; a stage's table goes once the next
one is written.

All stages take null texts and ids, texts of any length, repeated rows, further columns of any name and
empty tables. A null text counts as empty: it has no toxic word, no benchmark passage and no token, all
null and empty texts are one group of exact copies, and none is a near copy. Of a group the smallest
doc_id stays, a null id only if the group has no other; of rows with one id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import bpe, decontaminate, exact_dedup, minhash, toxicity
from shelfwise.llm.common import Scratch, bounded_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model is fitted on the labelled documents given.

    Null labels and labels of no document are left out; without labels of both kinds nothing is
    rejected. Rows are judged one by one.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one with the smallest doc_id (null ids last)."""
    bounded_batches(spark)
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of five-word shingles, the one with the smallest doc_id.

    Texts of fewer words are one shingle; texts without words all stay.
    """
    bounded_batches(spark)
    return minhash.drop_near(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item, or a whole item of fewer words.

    Null and empty items have no window; with an empty benchmark all documents stay.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of ids and decoded text, a row for each row; null texts have no tokens."""
    bounded_batches(spark)
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: The stages are no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as keep:
        for name, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.clear(but=1)
        name, stage = STAGES[-1]
        return keep.finish(stage(spark, docs, sf_dir), f"stage-{name}")
