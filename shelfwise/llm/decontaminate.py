"""Benchmark decontamination with suffix arrays of the training texts.

The corpus is cut into shards of some megabytes. Each shard gets a suffix array over its words:
suffixes are sorted by the first few words packed into one integer, then by prefix doubling, down to
the length of the longest benchmark item, beyond which no comparison ever looks. Every benchmark
suffix is binary-searched in every shard. The search narrows a range of the array block by block, so
it yields the longest verbatim match and its places, and for each window of an item the range of all
its occurrences. A document's words never continue in the next document.

The benchmark is cut into blocks of bounded size, files of the shared folder. A shard's array is built
once and searched for each block in turn, so neither side is ever shuffled. A worker keeps blocks while
they fit into a bounded memory and reads the others again for every shard, so a benchmark of any size
is searched whole. Words are compared as bytes, not as hashes.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, batches_by_bytes, estimated_bytes, ragged, shared_dir, table, text_bytes, words
from .files import opened, own_name

#: Consecutive words that make a verbatim copy; a shorter item counts as a whole.
WINDOW = 10

#: Text bytes of one block of the benchmark, and items at most.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 100_000
#: Text bytes of a shard where documents are only kept or dropped, beside the workers of other stages.
FILTER_BYTES = 4 << 20
#: Bytes of blocks that a worker keeps.
HELD_BYTES = 128 << 20


class Block:
    """Word ids of some benchmark items: ids from 1 in ``vocabulary``, item after item."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int):
        self.window = window
        raw, offsets = text_bytes(pa.array([t for _, t in rows], pa.large_string()))
        coded, at, _ = words(raw, offsets, ALNUM)
        self.names = [None if i is None else str(i) for i, _ in rows]
        self.vocabulary = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        sizes = np.diff(at)
        self.item = np.repeat(np.arange(len(rows)), sizes)
        self.position = np.arange(len(self.ids)) - at[:-1][self.item]
        self.left = sizes[self.item] - self.position
        self.depth = int(sizes.max(initial=0))
        #: words of the window that starts here, 0 where none does
        span = np.minimum(sizes, window)[self.item]
        self.span = np.where(self.left >= span, span, 0)


@dataclass(frozen=True)
class Blocks:
    """The benchmark as files of pickled blocks; ``depth`` is the length of its longest item in words."""

    folder: str
    files: tuple[str, ...]
    depth: int

    def __iter__(self):
        """The blocks one after another, from memory or from their files."""
        if _held.get("folder") != self.folder:
            _held.clear()
            _held.update(folder=self.folder, bytes=0)
        fs, root = opened(self.folder)
        for file in self.files:
            if (block := _held.get(file)) is None:
                with fs.open_input_stream(f"{root}/{file}") as f:
                    data = f.read()
                block = pickle.loads(data)
                if _held["bytes"] + len(data) <= HELD_BYTES:
                    _held["bytes"] += len(data)
                    _held[file] = block
            yield block


#: Blocks that this process keeps, by file, with their folder and bytes.
_held: dict = {}


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Blocks:
    """The benchmark in blocks, written by executors; the driver sees their names."""
    spark = benchmark.sparkSession
    folder, most, items = shared_dir(spark, "benchmark-blocks"), BLOCK_BYTES, BLOCK_ITEMS
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)

    def run(batches):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        rows, held, made = [], 0, []

        def close():
            block = Block(rows, window)
            made.append((own_name("block", len(made), ".pickle"), block.depth))
            with fs.open_output_stream(f"{root}/{made[-1][0]}", compression=None) as f:
                f.write(pickle.dumps(block))

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((item, text))
                held += len((text or "").encode())
                if held >= most or len(rows) >= items:
                    close()
                    rows, held = [], 0
        if rows:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.string()), pa.array([d for _, d in made], pa.int64())], ["file", "depth"])

    # as many tasks as there are parts of some blocks by Spark's estimate, so that small input files share a block
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col))
    if size := estimated_bytes(benchmark):
        rows = rows.coalesce(1 + size // (8 * BLOCK_BYTES))
    found = rows.mapInArrow(run, "file string, depth long").collect()  # a row per block
    return Blocks(folder, tuple(sorted(r.file for r in found)), max((r.depth for r in found), default=0))


class Shard:
    """The suffix array of some documents' words, sorted as deep as the longest item, in words.

    Word ids are the shard's own, so that one array serves all blocks.
    """

    def __init__(self, column: pa.Array, depth: int):
        raw, offsets = text_bytes(column)
        coded, self.rows, _ = words(raw, offsets, ALNUM)
        self.words = coded.dictionary
        # 32 bits hold all ids and places: a shard has less than 2^31 bytes
        self.ids = coded.indices.to_numpy(zero_copy_only=False) + np.int32(1)
        n = len(self.ids)
        self.left = np.repeat(self.rows[1:].astype(np.int32), np.diff(self.rows))
        self.left -= np.arange(n, dtype=np.int32)
        #: bits of a word id, or of that of an unknown word, and words in a packed key
        self.bits = max(1, int(len(self.words) + 1).bit_length())
        self.pack = 62 // self.bits
        self.key = self.packed(self.ids, self.left)
        self.array = self.sorted(depth)

    def known(self, block: Block) -> np.ndarray:
        """The block's words by this shard's ids; words that it has not share one that no text has."""
        if not len(block.ids):
            return block.ids
        found = pc.index_in(block.vocabulary, value_set=self.words).fill_null(len(self.words))
        return (found.to_numpy(zero_copy_only=False).astype(np.int64) + 1)[block.ids - 1]

    def packed(self, ids: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The first words of each suffix in one integer, 0 where the text has ended."""
        key = np.zeros(len(ids), np.int64)
        for j in range(self.pack):
            key <<= self.bits
            if j < len(ids):
                key[: len(ids) - j] |= np.where(left[: len(ids) - j] > j, ids[j:], 0)
        return key

    def sorted(self, depth: int) -> np.ndarray:
        n = len(self.ids)
        order = np.argsort(self.key).astype(np.int32)
        held = self.key[order]
        start = np.r_[True, held[1:] != held[:-1]][:n]
        del held
        width = self.pack
        places, none = np.arange(n, dtype=np.int32), np.int32(0)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(start, places, none))
        while width < depth:
            # suffixes that still share their place with another
            alone = start & np.r_[start[1:], True][:n]
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            own = order[at]
            after = np.where(self.left[own] > width, rank[np.minimum(own.astype(np.int64) + width, n - 1)] + 1, 0)
            new = (rank[own].astype(np.int64) << 32) | after
            by = np.argsort(new)
            order[at], new = own[by], new[by]
            start[at[1:]] |= new[1:] != new[:-1]
            rank[order[at]] = np.maximum.accumulate(np.where(start, places, none))[at]
            width *= 2
        return order

    def _bound(self, lo, hi, skip, want, upper: bool, mask_bits) -> np.ndarray:
        """Per query the first place in [lo, hi) whose key, ``skip`` words in, reaches ``want``."""
        lo, hi = lo.copy(), hi.copy()
        n = len(self.ids)
        while (going := lo < hi).any():
            mid = (lo + hi) >> 1
            at = self.array[np.minimum(mid, n - 1)].astype(np.int64)
            key = np.where(self.left[at] > skip, self.key[np.minimum(at + skip, n - 1)], 0) >> mask_bits
            low = (key <= want) if upper else (key < want)
            lo = np.where(going & low, mid + 1, lo)
            hi = np.where(going & ~low, mid, hi)
        return lo

    def narrow(self, lo, hi, skip, key, length) -> tuple[np.ndarray, np.ndarray]:
        """The part of [lo, hi) that agrees with ``key`` in ``length`` words from word ``skip`` on."""
        shift = (self.pack - length) * self.bits
        want = key >> shift
        return self._bound(lo, hi, skip, want, False, shift), self._bound(lo, hi, skip, want, True, shift)

    def search(self, block: Block):
        """For every benchmark suffix its longest match and one place; for every window its range.

        Returns (length, place, lo, hi): words matched, a word's place in the shard (-1: none), and
        the array range of the window that starts at the suffix.
        """
        m, n = len(block.ids), len(self.ids)
        length, place = np.zeros(m, np.int64), np.full(m, -1)
        first, last = np.zeros(m, np.int64), np.zeros(m, np.int64)
        if not n or not m:
            return length, place, first, last
        keys = self.packed(self.known(block), block.left)
        live = np.arange(m)
        lo, hi, done = np.zeros(m, np.int64), np.full(m, n), 0
        while len(live):
            want = np.minimum(block.left[live] - done, self.pack)
            key = keys[live + done]
            # a window that ends within this block of words
            span = block.span[live] - done
            ends = (span > 0) & (span <= self.pack)
            if ends.any():
                a, b = self.narrow(lo[ends], hi[ends], done, key[ends], span[ends])
                first[live[ends]], last[live[ends]] = a, b
            a, b = self.narrow(lo, hi, done, key, want)
            found = a < b
            length[live[found]] = done + want[found]
            place[live[found]] = self.array[a[found]]
            # where the whole block fails, its longest beginning
            miss = np.flatnonzero(~found)
            for size in range(self.pack - 1, 0, -1):
                if not len(miss):
                    break
                some = miss[want[miss] > size]
                x, y = self.narrow(lo[some], hi[some], done, key[some], np.full(len(some), size))
                ok = x < y
                length[live[some[ok]]] = done + size
                place[live[some[ok]]] = self.array[x[ok]]
                miss = np.setdiff1d(miss, some[ok], assume_unique=True)
            keep = found & (block.left[live] - done > self.pack)
            live, lo, hi = live[keep], a[keep], b[keep]
            done += self.pack
        return length, place, first, last

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words lie in an occurrence of a window, and the (row, item) pairs with one."""
        _, _, lo, hi = self.search(block)
        some = np.flatnonzero(hi > lo)
        counts = (hi - lo)[some]
        at = self.array[ragged(lo[some], counts)] if len(some) else np.zeros(0, np.int64)
        n = len(self.ids)
        edge = np.bincount(at, minlength=n + 1) - np.bincount(at + np.repeat(block.span[some], counts), minlength=n + 1)
        row = np.searchsorted(self.rows, at, side="right") - 1
        pairs = np.unique(row * max(1, len(block.names)) + np.repeat(block.item[some], counts))
        return np.cumsum(edge)[:n] > 0, *np.divmod(pairs, max(1, len(block.names)))


def _scan(held: Blocks):
    def run(batches):
        for batch in batches_by_bytes(batches, "text"):
            shard = Shard(batch.column("text"), held.depth)
            hit, named = np.zeros(len(shard.ids), bool), [set() for _ in range(batch.num_rows)]
            for block in held:
                some, rows, items = shard.hits(block)
                hit |= some
                for r, i in zip(rows.tolist(), items.tolist()):
                    if block.names[i] is not None:
                        named[r].add(block.names[i])
            named = [sorted(x) for x in named]
            sums = np.r_[0, np.cumsum(hit)]
            n_hit = sums[shard.rows[1:]] - sums[shard.rows[:-1]]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
            columns = [batch.column("doc_id"), np.diff(shard.rows), n_hit, [len(x) for x in named], digests, n_hit > 0, named]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Per document its words, the words inside copied windows and the items they come from.

    A word is a run of ASCII digits and letters (A-Z lower-cased) and of characters beyond ASCII. A
    window is ``window`` consecutive words of an item, or the whole item if that has fewer. Null and
    wordless texts have no words and no hits; a wordless item has no window. An item without an id
    marks words but is not named or counted; items of one id count once. Repeated documents each get
    their row; an empty benchmark finds nothing. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(blocks(benchmark, item_col, "text", window)), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay as they are."""
    held = blocks(benchmark, item_col, "text", window)

    def run(batches):
        for batch in batches_by_bytes(batches, text_col, FILTER_BYTES):
            shard, clean = Shard(batch.column(text_col), held.depth), np.ones(batch.num_rows, bool)
            for block in held:
                _, rows, _ = shard.hits(block)
                clean[rows] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """For every benchmark suffix the longest verbatim match in the corpus, in words, and one place.

    Of equally long matches the smallest doc_id wins, then the earliest word. A suffix whose first
    word never occurs has no row.
    """
    held = blocks(benchmark, item_col, "text", WINDOW)

    def run(batches):
        for batch in batches_by_bytes(batches, "text"):
            shard = Shard(batch.column("text"), held.depth)
            for block in held:
                length, place, _, _ = shard.search(block)
                some = np.flatnonzero(length)
                row = np.searchsorted(shard.rows, place[some], side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.names[i] for i in block.item[some]], pa.string()), pa.array(block.position[some]), pa.array(length[some]), batch.column("doc_id").take(pa.array(row)), pa.array(place[some] - shard.rows[row])],
                    ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "item_id string, item_word long, n_words long, doc_id long, doc_word long")
    top = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word")))
    return out.groupBy("item_id", "item_word").agg(top.alias("top")).select("item_id", "item_word", "top.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, row_number() OVER () AS bid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, wl, array_to_string(ws[p:p + wl - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(len(ws), 10) AS wl, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d
), dn AS (
  SELECT rid, pos, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS nxt FROM dw
), hit AS (
  SELECT dn.rid, dn.pos, bw.wl, bw.item_id
  FROM dn JOIN (SELECT DISTINCT wl FROM bw) l ON len(dn.nxt) >= l.wl
  JOIN bw ON bw.wl = l.wl AND bw.win = array_to_string(dn.nxt[1:l.wl], ' ')
), marked AS (
  SELECT rid, count(DISTINCT word_no) AS n_hit
  FROM (SELECT rid, unnest(range(pos, pos + wl)) AS word_no FROM hit) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(m.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked m USING (rid) LEFT JOIN named n USING (rid)
"""
