"""Near-duplicates: MinHash signatures, banding, verification and connected components.

Every text becomes its set of word shingles and a signature of many universal hash minima. Bands of
the signature are bucket keys. Inside a bucket each set meets only the bucket's most central set, so
a bucket costs as many pairs as it has rows; the pairs whose signatures allow the wanted similarity are
then verified on the full sets. Components of the verified links come from alternating large-star and
small-star rounds. An exact search by rare shingles then finds every pair of sets in different
components that may still be similar, and these are verified too, so no candidate pair goes untested;
pairs inside a component can change nothing and are never formed.

Copies of one set take part once. All intermediate results are tables in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAP_BITS, SPACED_LOWER, Scratch, batches_by_bytes, table, text_bytes, trim, without_rows, words

#: Bands and minima per band: a pair of similarity 0.8 shares no band once in 20 million.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Slots of the table of shingle counts, which is broadcast.
SLOTS = 1 << 21
#: Pieces of the table of counts.
CHUNKS = 64
#: Standard deviations of the signatures' agreement that a pair may lack before it is dropped.
SLACK = 6.0

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each row's distinct shingles of ``width`` words as sorted 64-bit hashes.

    Fewer words make one shingle, none make an empty set.
    """
    raw, rows = text_bytes(texts)
    coded, at, _ = words(raw, rows, SPACED_LOWER)
    hashes = pd.util.hash_array(np.array(coded.dictionary.to_pylist() or [b""], object), categorize=False)
    seq = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    whole = np.zeros(max(0, len(seq) - width + 1), np.uint64)
    for j in range(width):
        whole += seq[j : j + len(whole)] * _PLACE[j]
    whole = mixed(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        n = b - a
        if n >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif n:
            out.append(mixed((seq[a:b] * _PLACE[width : width + n]).sum(keepdims=True) + _PLACE[2 * width + n]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA minima of each non-empty set, as 32-bit numbers; rows of empty sets hold zeros."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), MINIMA), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([sets[i] for i in some.tolist()])
        first = np.r_[0, np.cumsum(sizes[some])[:-1]]
        for k in range(MINIMA):
            out[some, k] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def _prints(width: int):
    def run(batches):
        for batch in batches_by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            marks = [x.tobytes() if n else None for x, n in zip(signatures(sets), map(len, sets))]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("text_key"), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())], ["uid", "doc_id", "text_key", "n_shingles", "set_key", "signature"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a key of the text; with the id it finds the row again."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))


def prints_of(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    rows = keyed(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    return rows.mapInArrow(_prints(width), "uid long, doc_id long, text_key long, n_shingles long, set_key binary, signature binary")


def band_rows(prints: DataFrame) -> DataFrame:
    """A row per document and band: bucket, uid, and a number that equal sets share."""
    bands = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    rows = prints.filter("n_shingles > 0").select("uid", "signature", F.xxhash64("set_key").alias("own"), bands)
    part = F.substring(F.col("signature"), F.col("band") * (ROWS * 4) + 1, F.lit(ROWS * 4))
    return rows.select(F.xxhash64("band", part).alias("bucket"), "uid", "own")


def star_pairs(prints: DataFrame, copies: DataFrame, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of sets: each set of a bucket with the bucket's most central one.

    Central is what meets most others, over all its buckets: in a group of near copies the text that
    they come from, which is more like each of them than they are like each other.
    """
    found = band_rows(prints).groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high"))
    buckets = keep(found.filter("low <> high").select("bucket"), "buckets")
    rows = keep(band_rows(prints).join(buckets, "bucket").select("bucket", "uid"), "band-rows")
    rows = keep(rows.join(copies, "uid", "left").select("bucket", F.coalesce("node", "uid").alias("node")).distinct(), "members")
    sizes = keep(rows.groupBy("bucket").agg(F.count("*").alias("size")), "bucket-sizes")
    central = keep(rows.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("met")), "central")
    pivots = keep(rows.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("pivot")), "pivots")
    pairs = rows.join(pivots, "bucket").filter("node <> pivot")
    return keep(pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """uid, n, set and signature of the wanted rows (uid, doc_id, text_key), from their texts.

    A bitmap of fixed size with the wanted keys goes to all tasks, so that only few other texts are
    turned into sets; a join then finds the rows exactly.
    """
    spark = docs.sparkSession
    key = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(MAP_BITS))
    bits = wanted.select(key.alias("k")).groupBy(F.shiftright("k", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(k % 64 as int)))").alias("bits"))
    bits = bits.toArrow()  # MAP_BITS / 64 rows at most
    words_ = np.zeros(MAP_BITS >> 6, np.uint64)
    words_[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(words_)

    def sets(batches):
        for batch in batches_by_bytes(batches, "text"):
            k = batch.column("k").to_numpy()
            some = (shared.value[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) > 0
            batch = batch.filter(pa.array(some))
            found = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([x.tobytes() for x in signatures(found)], pa.binary())], ["doc_id", "text_key", "n", "set", "signature"])

    rows = keyed(docs, id_col, text_col).withColumn("k", key).mapInArrow(sets, "doc_id long, text_key long, n int, set binary, signature binary")
    own = wanted.select("uid", F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"))
    out = rows.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("text_key").eqNullSafe(F.col("own_key")))
    # rows stored twice have one key; one of them is enough
    at = Window.partitionBy("own_key", "own_id", "uid").orderBy(F.lit(1))
    return out.withColumn("_n", F.row_number().over(at)).filter("_n = 1").select("uid", "n", "set", "signature")


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int], use_signatures: bool) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as wanted."""
    p, q = similarity
    t = p / q
    least = MINIMA * t - SLACK * (MINIMA * t * (1 - t)) ** 0.5 if use_signatures else -1

    def check(batches):
        for batch in batches:
            x, y, sx, sy, mx, my = (c.to_pylist() for c in batch.columns)
            ok = np.zeros(batch.num_rows, bool)
            agree = (np.frombuffer(b"".join(mx), np.uint32) == np.frombuffer(b"".join(my), np.uint32)).reshape(-1, MINIMA).sum(axis=1)
            for i in np.flatnonzero(agree >= least).tolist():
                u, v = np.frombuffer(sx[i], np.uint64), np.frombuffer(sy[i], np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok[i] = q * both >= p * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))
        trim()

    one = sets.select(F.col("uid").alias("a"), F.col("set").alias("set_a"), F.col("signature").alias("sig_a"))
    two = sets.select(F.col("uid").alias("b"), F.col("set").alias("set_b"), F.col("signature").alias("sig_b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b", "sig_a", "sig_b")
    return rows.mapInArrow(check, "a long, b long")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each slot: a table of SLOTS counts, whatever the number of sets.

    Each task sends its table in CHUNKS pieces, which are added up apart from each other.
    """
    size = SLOTS // CHUNKS

    def tables(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, np.frombuffer(x, np.uint64) & np.uint64(SLOTS - 1), 1)
        some = [c for c in range(CHUNKS) if total[c * size : c * size + size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[c * size : c * size + size].tobytes() for c in some], pa.binary())], ["chunk", "counts"])
        trim()

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[c] = total.get(c, 0) + np.frombuffer(data, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])
        trim()

    schema = "chunk int, counts binary"
    found = sets.select("set").mapInArrow(tables, schema).repartition("chunk").mapInArrow(added, schema).toArrow()  # CHUNKS rows at most
    out = np.zeros(SLOTS, np.int32)
    for c, data in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[c * size : c * size + size] = np.minimum(np.frombuffer(data, np.int64), np.iinfo(np.int32).max)
    return out


def cross_pairs(sets: DataFrame, labels: DataFrame, similarity: tuple[int, int], keep: Scratch) -> DataFrame:
    """All pairs of different components that may be as similar as wanted.

    Exact prefix filtering: in any common order of shingles, two sets of enough overlap share a
    shingle early in both, at places that the two sizes allow. Rare shingles come first, by counts in
    a table of fixed size. Shingles that only one component has in its prefixes go before anything is
    joined, so what makes up a large group of near copies costs nothing. The rest meet by shingle, where
    rows of the component that has it most often are compared with those of others alone: a large group
    that shares a shingle with a few outsiders costs its rows times theirs. Adaptive execution splits
    the rows of a hot shingle among tasks.
    """
    spark = sets.sparkSession
    p, q = similarity
    shared = spark.sparkContext.broadcast(shingle_counts(sets))

    def prefixes(batches):
        for batch in batches:
            uid, group, sets_ = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for i, data in enumerate(sets_):
                s = np.frombuffer(data, np.uint64)
                n = len(s)
                seen = shared.value[s & np.uint64(SLOTS - 1)]
                first = np.lexsort((s, seen))[: n - (p * n + q - 1) // q + 1]
                place = np.flatnonzero(seen[first] > 1)  # counted once: no other set has it
                out.append((np.full(len(place), uid[i]), np.full(len(place), group[i]), s[first[place]].view(np.int64), n - place, np.full(len(place), n)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["uid", "label", "shingle", "rest", "n"])
        trim()

    rows = sets.join(labels, sets["uid"] == labels["node"], "left").select("uid", F.coalesce("label", "uid").alias("label"), "set")
    rows = keep(rows.mapInArrow(prefixes, "uid long, label long, shingle long, rest long, n long"), "prefixes")
    held = rows.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    several = held.groupBy("shingle").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    rows = keep(rows.join(several, "shingle"), "shared-prefixes")
    # x is the larger set of a pair; only rows whose own place leaves enough overlap can be the smaller one
    main = F.col("label") == F.col("most")
    small = rows.filter(F.col("n") * (2 * p) <= F.col("rest") * (p + q))
    fits = "(x.n > y.n or x.n = y.n and x.uid < y.uid) and {p} * x.n <= {q} * y.n and {p} * (x.n + y.n) <= {both} * x.rest and {p} * (x.n + y.n) <= {both} * y.rest"
    meet = F.expr("x.shingle = y.shingle and x.label <> y.label and " + fits.format(p=p, q=q, both=p + q))
    found = [x.alias("x").join(y.alias("y"), meet).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")) for x, y in ((rows, small.filter(~main)), (rows.filter(~main), small.filter(main)))]
    return keep(found[0].unionAll(found[1]).distinct(), "cross")


def components(links: DataFrame, keep: Scratch) -> DataFrame:
    """node and label, the least node of its component, for the nodes of ``links`` (a, b) but the least.

    Alternating large-star and small-star: each round hangs nodes on the least neighbour they or
    their neighbours know, until every component is one star. Edges stay in tables all the time.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = keep(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = large.join(least, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = keep(small.distinct(), "edges")
        before, now = now, state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_groups(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Rows are linked if their sets
    of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more, and grouped with
    all they reach. A text with fewer words is one shingle; a null, empty or blank text has none and
    is linked with nothing. ``component_id`` is the group's smallest doc_id (null ids come last), and
    the row that has it is kept, one of them if it is repeated. An empty table gives an empty result;
    columns other than the two named are not read.
    """
    with Scratch(docs.sparkSession) as keep:
        prints = keep(prints_of(docs, width, id_col, text_col), "signatures")
        classes = keep(prints.filter("n_shingles > 0").groupBy("set_key").agg(F.min("uid").alias("node"), F.count("*").alias("n")).filter("n > 1").drop("n"), "classes")
        copies = keep(prints.select("uid", "set_key").join(classes, "set_key").select("uid", "node"), "copies")
        pairs = star_pairs(prints, copies, keep)
        nodes = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
        wanted = keep(prints.select("uid", "doc_id", "text_key").join(nodes, "uid"), "wanted")
        sets = keep(full_sets(docs, wanted, width, id_col, text_col), "sets")
        links = keep(verified(pairs, sets, similarity, True), "links")
        labels = components(links, keep)
        more = keep(verified(cross_pairs(sets, labels, similarity, keep), sets, similarity, False), "links")
        if not more.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left").select(F.coalesce("la", "a"), F.coalesce("lb", "b"))), keep)
        rows = prints.select("uid", "doc_id", "text_key", "n_shingles").join(copies, "uid", "left").withColumn("node", F.coalesce("node", "uid"))
        rows = keep(rows.join(labels, "node", "left").select("uid", "doc_id", "text_key", "n_shingles", F.coalesce("label", "node").alias("part")), "parts")
        first = F.min_by(F.struct("doc_id", "uid"), F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))
        groups = rows.groupBy("part").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
        groups = keep(groups.select("part", F.col("first.doc_id").alias("first_id"), F.col("first.uid").alias("first_uid")), "groups")
        alone = F.col("first_uid").isNull()
        out = rows.join(groups, "part", "left").select("doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"), (alone | (F.col("uid") == F.col("first_uid"))).alias("kept"))
        return keep.finish(out, "near-groups")


def drop_near(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, all columns as they are; groups as in ``near_groups``.

    Columns may have any names. Rows without words all stay. Of rows with one id and text one stays
    if their group keeps it, whichever of them (their other columns may differ). Null ids come last.
    An empty table stays empty. Texts may be of any length: whole texts are read.
    """
    rows = near_groups(docs, width, similarity, id_col, text_col).filter("n_shingles > 0")
    return without_rows(docs, rows.select("doc_id", "text_key", "kept"), id_col, text_col)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), 4, (80, 100)).drop("text_key")
