"""Token ids in files compressed by Re-Pair grammars.

A shard is a few million consecutive ids with a grammar of its own: pairs of neighbouring symbols
that occur often are replaced by new symbols, again and again; the rules and the length of what each
expands to are stored with the rest. A round replaces each pair that is the most frequent one where it
stands, and rounds go on until no pair of the shard is frequent; each counts only pairs that are new
or were frequent before, as others cannot become so. First rounds work on the distinct pieces of text,
weighted by how often each occurs, which counts the same pairs in a fraction of the time; later rounds
join neighbouring pieces. No pair crosses a document's end, so any document
can be decoded alone, from any position, by the expansion lengths.

File format (little-endian): shards one after another, each

    magic "RPG1", uint32 rules, uint32 documents, uint32 symbols, uint32 first rule's symbol
    rules: uint32 left[], uint32 right[], uint32 expansion length[]
    documents: int64 id[], uint8 has id[], uint32 first symbol[], int64 ids before it in the shard[]
    symbols: 3 bytes each
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import END, Encoded, WordBpe, load, tokenizer_path
from .common import batches_by_bytes, estimated_bytes, materialize, ragged, shared_dir, table, trim
from .files import opened, own_name

#: Text bytes of one shard of a file.
SHARD_BYTES = 8 << 20
#: Input bytes of one file, as they are stored.
FILE_BYTES = 128 << 20
#: A rule must save more than it costs: it is three numbers, and each use saves one.
USES = 4
#: Ids that a symbol kept expanded while decoding stands for, at most.
SHORT = 16
#: Symbols have 3 bytes.
SYMBOLS = 1 << 24
#: Distinct words whose ids a worker remembers.
REMEMBERED = 600_000
#: Bits of the hashes of pairs that a round counts first, and what mixes them.
HASH_BITS, MIX = 20, np.uint64(0x9E3779B97F4A7C15)
END_ID = 2
MAGIC = b"RPG1"


def replace_round(seq: np.ndarray, live: np.ndarray, weight: np.ndarray | None, next_symbol: int):
    """One round of pair replacement.

    ``live`` has the places in ``seq`` whose pair with the next element may be frequent, ascending.
    Returns the kept elements' mask, the new sequence, its live places and the new rules, or None
    where no pair occurs often enough. ``weight`` is that of each live place.
    """
    if len(live) > len(seq) // 2:  # a pair is no more frequent than either of its symbols
        often = np.bincount(seq[live], weights=weight)[seq[live]] >= USES
        live, weight = live[often], None if weight is None else weight[often]
    if not len(live):
        return None
    pair = seq[live].astype(np.int64)
    pair <<= 32
    pair |= seq[live + 1]
    # a pair is no more frequent than its hash: most rare ones go before they are told apart
    bits = min(HASH_BITS, len(live).bit_length())
    place = (pair.view(np.uint64) * MIX >> np.uint64(64 - bits)).view(np.int64)
    often = (np.bincount(place, weights=weight) >= USES)[place]
    del place
    live, pair, weight = live[often], pair[often], None if weight is None else weight[often]
    if not len(live):
        return None
    codes, pairs = pd.factorize(pair)
    del pair
    # of a run of one symbol every second pair counts, as pairs must not overlap
    apart = _every_second(np.r_[False, (live[1:] == live[:-1] + 1) & (codes[1:] == codes[:-1])])
    count = np.bincount(codes[apart], weights=None if weight is None else weight[apart], minlength=len(pairs)).astype(np.int64)
    often = (count >= USES)[codes]
    if not often.any():
        return None
    live, codes, weight = live[often], codes[often], None if weight is None else weight[often]
    # the most frequent pair where it stands; of equally frequent ones a hash tells, so a round halves long repeats
    n, mixed = count[codes], (pairs.view(np.uint64) * MIX)[codes]
    alone = live[1:] != live[:-1] + 1
    best = np.r_[True, alone | (n[1:] > n[:-1]) | (n[1:] == n[:-1]) & (mixed[1:] >= mixed[:-1])]
    best &= np.r_[alone | (n[1:] < n[:-1]) | (n[1:] == n[:-1]) & (mixed[1:] <= mixed[:-1]), True]
    chosen = best.copy()
    chosen[best] = _every_second(np.r_[False, np.diff(live[best]) == 1])
    used = np.bincount(codes[chosen], weights=None if weight is None else weight[chosen], minlength=len(pairs)) >= USES
    used &= np.cumsum(used) <= SYMBOLS - next_symbol
    if not used.any():
        return None
    chosen &= used[codes]
    symbol = next_symbol + np.cumsum(used) - 1
    at = live[chosen]
    seq[at] = symbol[codes[chosen]]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    # only pairs around new symbols are new; of the others only frequent ones can be so again
    again = np.zeros(len(seq) + 1, bool)
    again[live] = True
    again[at] = True
    before = at - 1
    before -= ~keep[before]
    again[before[at > 0]] = True
    rules = pairs[used]
    return keep, seq[keep], np.flatnonzero(again[:-1][keep]), np.stack([rules >> 32, rules & 0xFFFFFFFF])


def _every_second(joined: np.ndarray) -> np.ndarray:
    """The first, third, ... of each run; ``joined`` tells of each element whether it continues the one before."""
    index = np.arange(len(joined), dtype=np.int32)
    return (index - np.maximum.accumulate(np.where(joined, np.int32(0), index))) & 1 == 0


@dataclass
class Shard:
    """A compressed run of documents."""

    first: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    doc_ids: np.ndarray
    has_id: np.ndarray
    starts: np.ndarray
    before: np.ndarray
    symbols: np.ndarray

    def pack(self) -> bytes:
        head = np.array([len(self.left), len(self.doc_ids), len(self.symbols), self.first], "<u4")
        parts = [head, *(x.astype("<u4") for x in (self.left, self.right, self.lengths)), self.doc_ids.astype("<i8"), self.has_id.astype("u1"), self.starts.astype("<u4"), self.before.astype("<i8")]
        return MAGIC + b"".join(x.tobytes() for x in parts) + self.symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        rules, docs, n, first = np.frombuffer(data, "<u4", 4, 4).tolist()
        at, out = 20, []
        for kind, count in (("<u4", rules), ("<u4", rules), ("<u4", rules), ("<i8", docs), ("u1", docs), ("<u4", docs), ("<i8", docs)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        wide = np.zeros((n, 4), np.uint8)
        wide[:, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        return cls(first, *out, wide.view("<u4").reshape(n))

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        rule = symbols >= self.first
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.lengths[symbols[rule] - self.first]
        return out

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each document's start in them (n + 1 offsets); rules are opened where they stand."""
        size = np.r_[np.ones(self.first, np.int64), self.lengths.astype(np.int64)]
        # short symbols are copied from a pool of their expansions, long ones opened until they are short
        short = np.flatnonzero(size[self.first :] <= SHORT)
        pool = np.r_[np.arange(self.first), self._opened(short + self.first, size)].astype(np.uint32)
        start = np.arange(len(size))
        start[self.first + short] = self.first + np.cumsum(size[self.first + short]) - size[self.first + short]
        sizes = size[self.symbols]
        # what this puts where a long symbol stands is overwritten below
        ids = pool.take(ragged(start[self.symbols], sizes), mode="clip") if len(sizes) else np.zeros(0, np.uint32)
        open_ = np.flatnonzero(sizes > SHORT)
        place, symbol = (np.cumsum(sizes) - sizes)[open_], self.symbols[open_].astype(np.int64)
        del sizes
        while len(symbol):
            own = symbol - self.first
            left = self.left[own].astype(np.int64)
            place, symbol = np.r_[place, place + size[left]], np.r_[left, self.right[own]].astype(np.int64)
            long = size[symbol] > SHORT
            at, own = place[~long], symbol[~long]
            ids[ragged(at, size[own])] = pool[ragged(start[own], size[own])]
            place, symbol = place[long], symbol[long]
        return ids, np.r_[self.before, len(ids)]

    def _opened(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of these symbols, one after another."""
        ends = np.cumsum(size[symbols])
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        place = ends - size[symbols]
        while len(symbols):
            rule = symbols >= self.first
            out[place[~rule]] = symbols[~rule]
            place, own = place[rule], symbols[rule] - self.first
            left = self.left[own].astype(np.int64)
            place, symbols = np.r_[place, place + size[left]], np.r_[left, self.right[own]].astype(np.int64)
        return out

    def slice(self, doc: int, start: int = 0, count: int | None = None) -> np.ndarray:
        """Some ids of one document; only the symbols that hold them are expanded."""
        end = self.starts[doc + 1] if doc + 1 < len(self.starts) else len(self.symbols)
        own = self.symbols[self.starts[doc] : end]
        ends = np.cumsum(self.sizes(own))
        stop = int(ends[-1]) if count is None else min(start + count, int(ends[-1]))
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        stack, out = own[a:b][::-1].tolist(), []
        while stack:
            s = stack.pop()
            if s < self.first:
                out.append(s)
            else:
                stack += [int(self.right[s - self.first]), int(self.left[s - self.first])]
        skip = start - (int(ends[a - 1]) if a else 0)
        return np.array(out[skip : skip + max(0, stop - start)], np.uint32)


def compress(found: Encoded, doc_ids: pa.Array, first: int, end_id: int = END_ID) -> Shard:
    """Build a shard's grammar. ``first`` is greater than any id."""
    # symbols and places of a shard fit 4 bytes, half as much memory as 8
    seq = found.ids.astype(np.int32)
    weight = np.bincount(found.pieces, minlength=len(found.sizes))
    owner = np.repeat(np.arange(len(found.sizes), dtype=np.int32), found.sizes)
    rules, next_symbol = [], first
    live = np.flatnonzero(owner[1:] == owner[:-1])
    while (done := replace_round(seq, live, weight[owner[live]], next_symbol)) is not None:
        keep, seq, live, made = done
        owner = owner[keep]
        live = live[owner[live] == np.r_[owner, -1][live + 1]]
        rules.append(made)
        next_symbol += made.shape[1]
    # the documents' symbols, each document closed by the end id
    sizes = np.bincount(owner, minlength=len(found.sizes))
    begin = np.cumsum(sizes) - sizes
    del owner, live
    docs = len(found.rows) - 1
    pieces = np.insert(found.pieces, found.rows[1:], len(sizes))
    piece_sizes = np.r_[sizes, 1][pieces]
    edges = np.r_[0, np.cumsum(piece_sizes)][np.r_[0, found.rows[1:] + np.arange(1, docs + 1)]]
    stream = np.r_[seq, np.int32(end_id)][ragged(np.r_[begin, len(seq)][pieces], piece_sizes)]
    del pieces, piece_sizes, seq
    live = np.arange(len(stream))
    while True:
        inner = np.ones(len(stream), bool)
        inner[edges[1:] - 1] = False
        live = live[inner[live]]
        if (done := replace_round(stream, live, None, next_symbol)) is None:
            break
        keep, stream, live, made = done
        edges -= np.searchsorted(np.flatnonzero(~keep), edges)
        rules.append(made)
        next_symbol += made.shape[1]
    left, right = np.concatenate(rules, axis=1) if rules else np.zeros((2, 0), np.int64)
    lengths = np.ones(next_symbol, np.int64)
    at = first
    for made in rules:  # a rule's parts are older than it
        lengths[at : at + made.shape[1]] = lengths[made[0]] + lengths[made[1]]
        at += made.shape[1]
    before = np.r_[0, np.cumsum(lengths[stream])][edges[:-1]]
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    return Shard(first, left, right, lengths[first:], doc_ids.fill_null(0).to_numpy(), known, edges[:-1], before, stream)


class LibraryWords:
    """Ids of distinct words by the tokenizers library; a worker remembers those it has seen."""

    def __init__(self, model: WordBpe):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = model
        # words are normal and cut already, so the library need only merge them
        self.merging = Tokenizer.from_str(model.library.to_str())
        self.merging.normalizer = normalizers.Sequence([])
        self.merging.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: the last token of each word says so
        self.ends = np.array([t.endswith(END) for t in model.tokens])
        self.known, self.ids, self.starts = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def library(self, words: list[str], together: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and where each one's end: many words a call, told apart by their last tokens."""
        ids, ends = [], []
        calls = [words[i : i + together] for i in range(0, len(words), together)]
        for call, found in zip(calls, self.merging.encode_batch_fast([" ".join(x) for x in calls], add_special_tokens=False)):
            flat = np.array(found.ids, np.uint32)
            at = np.flatnonzero(self.ends[flat]) + 1
            if len(at) != len(call) or "" in call:  # a word that is empty or more than one to the library
                parts = [self.model.library.encode(x, add_special_tokens=False).ids for x in call]
                flat, at = np.array([i for x in parts for i in x], np.uint32), np.cumsum([len(x) for x in parts])
            ids.append(flat)
            ends.append(at)
        base = np.cumsum([0, *(len(x) for x in ids)])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *(x + n for x, n in zip(ends, base))])

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(words, value_set=self.known)
        unseen = at.is_null()
        fresh = words.filter(unseen)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        ids, ends = self.library(fresh.to_pylist())
        at[unseen.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        pool, starts = np.r_[self.ids, ids], np.r_[self.starts, len(self.ids) + ends]
        if len(self.known) + len(fresh) <= REMEMBERED:
            self.known, self.ids, self.starts = pa.concat_arrays([self.known, fresh]), pool, starts
        sizes = np.diff(starts)[at]
        return pool[ragged(starts[:-1][at], sizes)], np.r_[0, np.cumsum(sizes)]


_libraries: dict[str, LibraryWords] = {}


def write_ids(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write their ids below ``folder`` in ascending id order.

    Returns the index, a table of the shared folder with a row per shard: file, offset, length, and
    the number of ids in all shards before it. Null texts count as empty: they hold the end id alone.
    Null ids come last; rows of one id are ordered by text. An empty table writes nothing.
    """
    schema = "file_no int, shard_no int, file string, offset long, length long, n_docs long, n_ids long"

    def packed(model, library, batch):
        shard = compress(model.encode(batch.column("text"), library), batch.column("doc_id"), len(model.tokens))
        return shard.pack(), int(shard.before[-1] + shard.sizes(shard.symbols[shard.starts[-1] :]).sum())

    def run(batches):
        name = path or tokenizer_path()
        model = load(name)
        library = _libraries.get(name) or _libraries.setdefault(name, LibraryWords(model))
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        file, out, at, rows = own_name("ids", 0, ".rpg"), None, 0, []
        for number, batch in enumerate(batches_by_bytes(batches, "text", SHARD_BYTES)):
            data, n_ids = packed(model, library, batch)
            out = out or fs.open_output_stream(f"{root}/{file}", compression=None)
            out.write(data)
            rows.append((TaskContext.get().partitionId(), number, file, at, len(data), batch.num_rows, n_ids))
            at += len(data)
            del data
            trim()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4])], [x.split()[0] for x in schema.split(", ")])

    spark = docs.sparkSession
    # as many files as the input has parts of FILE_BYTES by Spark's estimate, and no fewer than tasks
    size = estimated_bytes(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"), "text")
    index = materialize(rows.mapInArrow(run, schema), "ids-index")
    files = index.groupBy("file_no").agg(F.sum("n_ids").alias("n"))  # a row per file
    files = files.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("base"))
    inner = F.sum("n_ids").over(Window.partitionBy("file_no").orderBy("shard_no")) - F.col("n_ids")
    return index.withColumn("inner", inner).join(files, "file_no").select(*index.columns, (F.col("base") + F.col("inner")).alias("start"))


def read_ids(index: DataFrame, folder: str, full: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files; ``full`` adds the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * full

    def decoded(shard, start):
        ids, at = shard.decode()
        data, edges = memoryview(ids.astype("<u4", copy=False)).cast("B"), (at * 4).tolist()
        out = [
            pa.array(shard.doc_ids, pa.int64(), mask=shard.has_id == 0),
            pa.array(start + at[:-1], pa.int64()),
            pa.array(np.diff(at), pa.int64()),
            pa.array([zlib.crc32(data[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.int64()),
        ]
        if full:
            out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
        return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    def run(batches):
        fs, root = opened(folder)
        for batch in batches:
            for file, offset, length, start in zip(*(batch.column(c).to_pylist() for c in range(4))):
                with fs.open_input_file(f"{root}/{file}") as f:
                    f.seek(offset)
                    shard = Shard.unpack(f.read(length))
                yield decoded(shard, start)
                del shard
                trim()

    spark = index.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return index.select("file", "offset", "length", "start").repartition(parts, "file", "offset").mapInArrow(run, schema)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "ids")
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder), folder)
