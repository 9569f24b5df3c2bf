"""BPE encoding by speculation and verification, and decoding.

For a BPE vocabulary with word ends, lower case and no white space tokens. Text is cut at ASCII white
space, which no token crosses, and only a step's distinct pieces are encoded. A greedy longest match
down a trie, for all distinct words at once, proposes tokens. The proposal is what merging yields if
every token would itself be kept whole and every adjacent pair is compatible: no merge across their
border would have come before the merges that built the two. Both are tested for all pairs at once on
the merge ranks. Only words that fail are merged pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, batches_by_bytes, ragged, table, text_bytes, words

#: Words of more bytes are merged exactly at once: the vectorised match would take a step a token.
LONG_WORD = 200
#: Text bytes encoded in one step, which takes some 20 times as much memory.
STEP = 2 << 20
#: Bytes of pieces that are cut into words at once.
CUT_BYTES = 1 << 18
#: Words whose exact merging a task remembers.
REMEMBERED = 200_000
END = "</w>"
FAR = np.int64(1) << 40
#: The steps around merging that this module does itself (fixed values of the file format).
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Characters below are cut here; pieces with any other go through the library's own steps. Lower-casing
#: leads from none of them to a letter beyond (from U+0181 on it does).
LATIN_END = 0x180


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Tables of one tokenizer file. Symbols: a byte, or a byte + 256 as the last one of a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model = read["model"]
        other = [k for k, v in STEPS.items() if read.get(k) != v] + [k for k, v in MODEL.items() if model.get(k, v) != v]
        other += [t["content"] for t in read["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].count("|") < 2]
        if other:
            raise ValueError(f"{path} is no tokenizer of this kind: {other}")
        vocab = model["vocab"]
        self.letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in read["added_tokens"]}
        top = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * top
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.token_texts = pa.array(self.tokens, pa.string())
        self._trie(vocab)
        self._merges(vocab, model["merges"], top)
        self.valid = self._whole()
        self.merged: dict[bytes, tuple[int, ...]] = {}
        latin = [chr(c) for c in range(0x80, LATIN_END)]
        letters = re.escape("".join(c for c in latin if unicodedata.category(c)[0] == "L"))
        numbers = re.escape("".join(c for c in latin if unicodedata.category(c)[0] == "N"))
        self.cut = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z{letters}]+|[0-9{numbers}]|[^\t-\r \x85\xa0a-zA-Z0-9{letters}{numbers}]+")
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")

    def symbols(self, token: str) -> list[int]:
        body = token[: -len(END)] if token.endswith(END) and token != END else token
        out = [self.letters[c] for c in body]
        if body is not token and out:
            out[-1] += 256
        return out

    def _trie(self, vocab) -> None:
        children: dict[int, int] = {}
        token_at = [-1]
        self.base = np.full(512, -1)
        for token, i in vocab.items():
            node, path = 0, self.symbols(token)
            for s in path:
                key = node * 512 + s
                if key not in children:
                    children[key] = len(token_at)
                    token_at.append(-1)
                node = children[key]
            token_at[node] = i
            if len(path) == 1:
                self.base[path[0]] = i
        self.edge = np.array(sorted(children), np.int64)
        self.child = np.array([children[k] for k in self.edge.tolist()], np.int64)
        self.token_at = np.array(token_at, np.int64)

    def _merges(self, vocab, merges, top: int) -> None:
        self.left, self.right = np.full(top, -1), np.full(top, -1)
        self.rank = np.full(top, -1)
        self.join: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.join.setdefault((x, y), (r, made))
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, r
        keys = np.array([x * top + y for x, y in self.join], np.int64)
        ranks = np.array([r for r, _ in self.join.values()], np.int64)
        by = np.argsort(keys)
        self.pair, self.pair_rank, self.top = keys[by], ranks[by], top

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.top + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], FAR)

    def _apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of tokens a and b precedes those inside them.

        Goes back through the merges that built both, the latest first, down the right edge of a and
        the left edge of b. A merge of the two parts that face each other is due if its rank is less
        than that of the merge that takes the left one away, and at most that which takes the right
        one (equal pairs merge from the left).
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        gone_a, gone_b = until.copy(), until.copy()
        while len(live):
            due = self._pair_rank(a, b)
            bad = (due < gone_a) & ((due <= gone_b) & (due < FAR)) & ~((due == gone_b) & (gone_b == until[live]))
            out[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            going = ~bad & ((ra >= 0) | (rb >= 0))
            back_a = going & (ra > rb)
            back_b = going & ~back_a
            gone_a, gone_b = np.where(back_a, ra, gone_a), np.where(back_b, rb, gone_b)
            a, b = np.where(back_a, self.right[a], a), np.where(back_b, self.left[b], b)
            live, a, b, gone_a, gone_b = live[going], a[going], b[going], gone_a[going], gone_b[going]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._apart(a, b, np.full(len(a), FAR))

    def _whole(self) -> np.ndarray:
        """Tokens that merging their own bytes yields."""
        made = np.flatnonzero(self.rank >= 0)
        ok = np.zeros(self.top, bool)
        ok[self.base[self.base >= 0]] = True
        fine = self._apart(self.left[made], self.right[made], self.rank[made])
        by = np.argsort(self.rank[made])
        for i, good in zip(made[by].tolist(), fine[by].tolist()):
            ok[i] = good and ok[self.left[i]] and ok[self.right[i]]
        return ok

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact merging of one word: the lowest rank first, from the left."""
        if (known := self.merged.get(word)) is not None:
            return known
        ids = [int(self.base[s]) for s in word[:-1]] + [int(self.base[word[-1] + 256])]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        due = [(j[0], i, j[1], ids[i], ids[i + 1]) for i in range(n - 1) if (j := self.join.get((ids[i], ids[i + 1])))]
        heapq.heapify(due)
        while due:
            _, i, made, x, y = heapq.heappop(due)
            k = after[i] if ids[i] == x else -1
            if k < 0 or ids[k] != y:
                continue
            ids[i], ids[k] = made, -1
            after[i] = after[k]
            if after[k] >= 0:
                before[after[k]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (j := self.join.get((ids[p], ids[q]))):
                    heapq.heappush(due, (j[0], p, j[1], ids[p], ids[q]))
        out = tuple(x for x in ids if x >= 0)
        if len(word) <= LONG_WORD:
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            self.merged[word] = out
        return out

    def greedy(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches from the left. Returns (word, number in the word, token)."""
        live, at = np.flatnonzero(starts < ends), starts[starts < ends].copy()
        found = []
        k = 0
        while len(live):
            token, size = np.full(len(live), -1), np.zeros(len(live), np.int64)
            going, node, depth = np.arange(len(live)), np.zeros(len(live), np.int64), 0
            while len(going):
                key = node * 512 + symbols[at[going] + depth]
                i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                ok = self.edge[i] == key
                going, node = going[ok], self.child[i[ok]]
                depth += 1
                ends_here = self.token_at[node] >= 0
                token[going[ends_here]] = self.token_at[node[ends_here]]
                size[going[ends_here]] = depth
                more = at[going] + depth < ends[live[going]]
                going, node = going[more], node[more]
            found.append((live, np.full(len(live), k), token))
            at += size
            more = at < ends[live]
            live, at = live[more], at[more]
            k += 1
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct words, and each word's start in them (n + 1 offsets)."""
        raw, at = text_bytes(texts)
        n = len(at) - 1
        symbols = raw.astype(np.int64)
        sizes = np.diff(at)
        symbols[at[1:][sizes > 0] - 1] += 256
        brief = sizes <= LONG_WORD
        word, number, token = self.greedy(symbols, np.where(brief, at[:-1], 0), np.where(brief, at[1:], 0))
        counts = np.bincount(word, minlength=n)
        starts = np.r_[0, np.cumsum(counts)]
        ids = np.empty(len(token), np.int64)
        ids[starts[word] + number] = token
        owner = np.repeat(np.arange(n), counts)
        bad = ~brief & (sizes > 0)
        bad[owner[~self.valid[ids]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(ids[inner] * self.top + ids[inner + 1], return_inverse=True)
        apart = self.compatible(pairs // self.top, pairs % self.top)
        bad[owner[inner[~apart[back]]]] = True
        failed = np.flatnonzero(bad)
        if not len(failed):
            return ids, starts
        data = raw.tobytes()
        fixed = [self.merge(data[at[i] : at[i + 1]]) for i in failed.tolist()]
        lengths = np.array([len(x) for x in fixed], np.int64)
        pool = np.r_[ids, np.fromiter((i for x in fixed for i in x), np.int64, int(lengths.sum()))]
        begin = starts[:-1].copy()
        begin[failed] = len(ids) + np.cumsum(lengths) - lengths
        counts[failed] = lengths
        return pool[ragged(begin, counts)], np.r_[0, np.cumsum(counts)]

    def slow_pieces(self, piece: str) -> list[str]:
        """Words of a piece with letters beyond Latin, or a special token (returned with a line feed before it)."""
        out = []
        for part in self.special.split(piece):
            if part in self.specials:
                out.append("\n" + part)
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    out.append(bytes(self.letters[c] for c in word).decode("utf-8", "surrogateescape"))
        return out

    def encode_pieces(self, pieces: pa.Array, encode_words=None) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct pieces without ASCII white space, and each piece's start in them.

        ``encode_words`` does the same for distinct words; by default ``self.encode_words``.
        """
        raw, at = text_bytes(pieces.cast(pa.large_string()))
        n = len(at) - 1
        odd = np.r_[0, np.cumsum(raw >= 0xC0 + (LATIN_END >> 6))]
        slow = (odd[at[1:]] - odd[at[:-1]]) > 0
        # no special token is without this byte
        bars = np.r_[0, np.cumsum(raw == ord("|"))]
        piece = lambda i: raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")
        for i in np.flatnonzero(bars[at[1:]] - bars[at[:-1]] > 1).tolist():
            slow[i] |= self.special.search(piece(i)) is not None
        late = np.flatnonzero(slow).tolist()
        slow_words = [self.slow_pieces(piece(i)) for i in late]
        # all other pieces with a line feed between
        sizes = np.diff(at)
        kept = ~np.repeat(slow, sizes)
        sizes[slow] = 0
        joined = np.full(int(sizes.sum()) + max(0, n - 1), ord("\n"), np.uint8)
        joined[ragged(np.cumsum(sizes + 1) - sizes - 1, sizes)] = raw[kept]
        del kept, odd, bars
        # some pieces at a time, as a list of words takes many times their bytes
        data, parts, a = joined.tobytes(), [], 0
        while a < len(data):
            b = data.find(b"\n", a + CUT_BYTES) + 1 or len(data)
            parts.append(pa.array(self.cut.findall(data[a:b].decode("utf-8", "replace").lower()), pa.large_string()))
            a = b
        count = sum(map(len, parts))
        parts.append(pa.array([word for x in slow_words for word in x], pa.large_string()))
        coded = pa.chunked_array(parts, pa.large_string()).combine_chunks().dictionary_encode()
        del parts, data, joined
        code = coded.indices.to_numpy()
        line = pc.index(coded.dictionary, pa.scalar("\n", pa.large_string())).as_py()
        marks = np.r_[-1, np.flatnonzero(code[:count] == line), count] if n else np.zeros(1, np.int64)
        begin, size = marks[:-1] + 1, np.diff(marks) - 1
        if late:
            lengths = np.array([len(x) for x in slow_words], np.int64)
            begin[late], size[late] = count + np.cumsum(lengths) - lengths, lengths
        distinct = coded.dictionary
        own = distinct.to_pylist() if late else []
        if late:
            distinct = pa.array(["" if x[0] == "\n" else x for x in own], pa.large_string())
        ids, starts = (encode_words or self.encode_words)(distinct)
        if any(x[0] == "\n" and len(x) > 1 for x in own):
            pool, extra = ids, []
            starts_at, sizes = starts[:-1].copy(), np.diff(starts)
            for i, x in enumerate(own):
                if x[0] == "\n" and len(x) > 1:
                    starts_at[i], sizes[i] = len(pool) + len(extra), 1
                    extra.append(self.specials[x[1:]])
            ids = np.r_[pool, np.array(extra, np.int64)]
        else:
            starts_at, sizes = starts[:-1], np.diff(starts)
        word = code[ragged(begin, size)]
        per_word = sizes[word]
        edges = np.r_[0, np.cumsum(per_word)]
        ends = np.cumsum(size)
        return ids[ragged(starts_at[word], per_word)], np.r_[0, edges[ends]] if n else np.zeros(1, np.int64)

    def encode(self, texts: pa.Array, encode_words=None) -> Encoded:
        """Ids of whole texts; null counts as empty."""
        raw, rows = text_bytes(texts)
        coded, at, _ = words(raw, rows, SPACED)
        ids, starts = self.encode_pieces(coded.dictionary, encode_words)
        return Encoded(self, ids.astype(np.uint32), starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at)


class Encoded:
    """Rows as pieces, pieces as token ids."""

    def __init__(self, model: WordBpe, ids, starts, pieces, rows):
        self.model, self.ids, self.starts, self.pieces, self.rows = model, ids, starts, pieces, rows
        self.sizes = np.diff(starts)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids and each row's start in them (n + 1 offsets)."""
        sizes = self.sizes[self.pieces]
        ends = np.r_[0, np.cumsum(sizes)]
        return self.ids[ragged(self.starts[:-1][self.pieces], sizes)], ends[self.rows]

    def decoded(self) -> pa.Array:
        """What the ids stand for: their texts with one space between, as the library's decode without a decoder."""
        texts = self.model.token_texts.take(pa.array(self.ids))
        piece = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), texts), " ")
        some = self.sizes[self.pieces] > 0
        kept = np.r_[0, np.cumsum(some)][self.rows]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), piece.take(pa.array(self.pieces[some]))), " ")


@lru_cache(4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Per row its token count and the SHA-256 of its ids and of the decoded text; ``full`` adds both.

    Ids are hashed as little-endian unsigned 32-bit integers. Null counts as empty and has no tokens.
    Repeated rows and null ids are kept; an empty table gives an empty result. Columns other than the
    two named are not read. ``path`` names the tokenizer file, which every executor must have; by
    default each finds its own copy.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def run(batches):
        model = load(path or tokenizer_path())
        for batch in batches_by_bytes(batches, "text", STEP):
            found = model.encode(batch.column("text"))
            ids, at = found.flat()
            data, edges = memoryview(ids.astype("<u4")).cast("B"), (at * 4).tolist()
            decoded = found.decoded()
            out = [
                batch.column("doc_id"),
                pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:])], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded.cast(pa.binary()).to_pylist()], pa.string()),
            ]
            if full:
                out += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), decoded]
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])
        # workers live on beside those of other stages
        model.merged.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
