"""Token counts by compiling a byte-level BPE tokenizer to finite-state transducers.

Two transducers in a row. The first reads characters by class and marks where words (the units that no
token crosses) start; its states are the ways in which a word may still go on. Every class is a map of
states to states, and the maps that classes generate under composition are few, so they are numbered
and their products tabled. Chunks of text reduce to one such number each, all chunks at once; a
parallel prefix scan of products gives every chunk the state it starts in, and then all chunks mark
their words at once.

The second transducer reads a word's bytes and emits on every transition by how much the token count
of what it has read changes. Merging has a unique result, told by pairs of neighbours, so the last
token of a prefix is the one token among its suffixes that fits the last token of what precedes it. A
state is the place in an automaton of all tokens together with, for every suffix that a token could
still start with, the last token before it and the count there. States and transitions are compiled
when they are first met. Each word starts it anew, so chunks need no maps of this transducer.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import FAR, WordBpe, byte_letters
from .common import batches_by_bytes, table, text_bytes

#: Characters of a chunk.
CHUNK = 256
#: Text bytes of one step; a longer text makes a step of its own.
STEP = 4 << 20
#: Transitions of the second transducer that a process keeps (some 200 bytes each); beyond, all are forgotten and compiled again.
KEPT = 600_000
#: Added to changes of the count, which may be negative.
SHIFT = 1 << 15

#: The steps around merging that this module does itself (fixed values of the file format).
STEPS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "post_processor": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: Classes of characters; letters that end an English contraction stand apart.
CLASSES = ["blank", "space", "letter", "number", "quote", "other", "stmd", "r", "v", "l", "e"]
SPACES, LETTERS = {"blank", "space"}, {"letter", "stmd", "r", "v", "l", "e"}
#: States: what the open word is so far. "border": none is open. "blanks" and "spaces": two spaces or more, by the last.
STATES = ["border", "blank", "space", "blanks", "spaces", "letter", "number", "other", "quote", "'r", "'v", "'l"]
UNKNOWN = 255


def _opened(c: str) -> str:
    return "letter" if c in LETTERS else c


def _next(state: str, c: str) -> tuple[str, set[int]]:
    """The state after a character of class c, and the words that now turn out to start: there (0) or a character before (1)."""
    if state in ("'r", "'v", "'l"):
        if c == {"'r": "e", "'v": "e", "'l": "l"}[state]:
            return "border", set()
        after, marks = _next("letter", c)  # the quote was a word by itself
        return after, marks | {1}
    if state == "quote":
        if c == "stmd":
            return "border", set()
        if c in ("r", "v", "l"):
            return "'" + c, set()
        state = "other"
    if state in ("blank", "space", "blanks", "spaces") and c in SPACES:
        return c + "s", set()
    if state in ("blank", "blanks"):
        # the last blank belongs to what follows it; a quote behind it is no contraction
        return "other" if c == "quote" else _opened(c), {1} if state == "blanks" else set()
    if state == "spaces":
        return _opened(c), {0, 1}
    if state == "letter" and c in LETTERS or state == "number" == c or state == "other" and c in ("other", "quote"):
        return state, set()
    return _opened(c), {0}


class WordMarks:
    """The first transducer, its maps' products and the class of every character met so far."""

    def __init__(self, library):
        self.library = library
        n = len(STATES)
        step = [[_next(s, c) for s in STATES] for c in CLASSES]
        # the first character of a text ends what went before and starts from a border
        first = [[("border", {1} if s[0] == "'" else set()) for s in STATES] for _ in CLASSES]
        first = [[(step[c][0][0], step[c][0][1] | first[c][s][1]) for s in range(n)] for c in range(len(CLASSES))]
        both = step + first
        self.after = np.array([[STATES.index(x[0]) for x in row] for row in both], np.uint8)
        self.marks = np.array([[sum(1 << m for m in x[1]) for x in row] for row in both], np.uint8)
        self._products()
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        for c in range(0xD800, 0xE000):  # no characters
            self.classes[c] = CLASSES.index("other")

    def _products(self) -> None:
        """Number the maps that the classes generate (0: the identity) and table all products."""
        maps = {bytes(range(len(STATES))): 0}
        found = [np.arange(len(STATES), dtype=np.uint8)]
        for m in found:
            for g in self.after:
                product = g[m]
                if product.tobytes() not in maps:
                    maps[product.tobytes()] = len(found)
                    found.append(product)
        self.maps = np.array(found)
        self.product = np.array([[maps[b[a].tobytes()] for b in found] for a in found], np.uint16)
        self.generator = np.array([maps[g.tobytes()] for g in self.after], np.uint16)

    def classify(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[points]
        if (out == UNKNOWN).any():
            new = np.unique(points[out == UNKNOWN])
            self.classes[new] = [self._class_of(chr(c)) for c in new.tolist()]
            out = self.classes[points]
        return out

    def _class_of(self, c: str) -> int:
        """A character's class, as the library cuts around it."""
        if c in "'":
            name = "quote"
        elif c == " ":
            name = "blank"
        elif c in "stmdrvle":
            name = "stmd" if c in "stmd" else c
        else:
            cut = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text)) == 1
            name = "letter" if cut("b" + c) else "number" if cut("0" + c) else "other" if cut("!" + c) else "space"
        return CLASSES.index(name)

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of the characters with which words start; ``first`` are the first characters of texts."""
        n = len(points)
        rows = n // CHUNK + 1
        # a column for each chunk; what follows the last text is the start of another
        grid = np.full(rows * CHUNK, CLASSES.index("other") + len(CLASSES), np.uint8)
        grid[:n] = self.classify(points)
        grid[first] += len(CLASSES)
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        whole = np.zeros(rows, np.uint16)
        for kinds in grid:
            whole = self.product[whole, self.generator[kinds]]
        state = self.maps[self._before(whole), STATES.index("border")]
        marks = np.empty((CHUNK, rows), np.uint8)
        for i, kinds in enumerate(grid):
            marks[i] = self.marks[kinds, state]
            state = self.after[kinds, state]
        marks = marks.T.ravel()
        return np.flatnonzero((marks[:n] & 1 > 0) | (marks[1 : n + 1] & 2 > 0))

    def _before(self, maps: np.ndarray) -> np.ndarray:
        """The product of all maps before each, by doubling: a parallel prefix scan."""
        out = np.r_[np.uint16(0), maps[:-1]]
        reach = 1
        while reach < len(out):
            out = np.r_[out[:reach], self.product[out[:-reach], out[reach:]]]
            reach *= 2
        return out


class ByteBpe(WordBpe):
    """Merge tables of a byte-level tokenizer file and its second transducer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model, self.letters = read["model"], byte_letters()
        other = [k for k, v in STEPS.items() if read.get(k) != v] + [k for k, v in MODEL.items() if model.get(k, v) != v]
        other += [t["content"] for t in read["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        other += [f"byte {b}" for c, b in self.letters.items() if c not in model["vocab"]]
        if other:
            raise ValueError(f"{path} is no tokenizer of this kind: {other}")
        self.special = [t["content"].encode() for t in read["added_tokens"]]
        vocab = model["vocab"]
        self.base = np.full(512, -1)
        for c, b in self.letters.items():
            self.base[b] = vocab[c]
        self._merges(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], max(vocab.values()) + 1)
        # plain lists: one pair at a time is tested
        self.parts = list(zip(self.rank.tolist(), self.left.tolist(), self.right.tolist()))
        whole = self._whole()  # a token that merging its own bytes does not yield stands in no result
        self._automaton({t: i for t, i in vocab.items() if whole[i]})
        self.words = WordMarks(self.library)
        self.forget()

    def _automaton(self, vocab) -> None:
        """All tokens' prefixes as nodes, with the longest proper suffix of each that is a node too."""
        self.child: list[dict[int, int]] = [{}]
        self.token, self.parent = [-1], [-1]
        for token, i in vocab.items():
            node = 0
            for c in token:
                b = self.letters[c]
                if b not in (down := self.child[node]):
                    down[b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.parent.append(node)
                node = down[b]
            self.token[node] = i
        self.suffix = [0] * len(self.child)
        level = [*self.child[0].values()]
        while level:
            for node in level:
                for b, to in self.child[node].items():
                    self.suffix[to] = self.step(self.suffix[node], b)
            level = [to for node in level for to in self.child[node].values()]

    def step(self, node: int, b: int) -> int:
        while node and b not in self.child[node]:
            node = self.suffix[node]
        return self.child[node].get(b, 0)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves the border of two tokens: undoes the merges that made them, the latest first."""
        known = self.fitting.get((a, b))
        if known is None:
            x, y, gone_x, gone_y = a, b, FAR, FAR
            known = True
            while True:
                due = self.join.get((x, y), (FAR,))[0]
                if due < gone_x and due <= gone_y and due < FAR:
                    known = False
                    break
                (rx, _, right), (ry, left, _) = self.parts[x], self.parts[y]
                if rx < 0 and ry < 0:
                    break
                if rx > ry:
                    x, gone_x = right, rx
                else:
                    y, gone_y = left, ry
            self.fitting[a, b] = known
        return known

    def forget(self) -> None:
        """Start over with the first state alone."""
        self.fitting: dict[tuple[int, int], bool] = {}
        # a state: a node and, for each of its suffixes that go on, the last token before and the count there less the count now
        self.states = [(0, ((-1, 0),))]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def suffixes(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(node)
            node = self.suffix[node]
        return out

    def compile(self, state: int, b: int) -> int:
        """The transition of a state by a byte: the next state and the change of the count, as one number."""
        node, before = self.states[state]
        known = dict(zip([v for v in self.suffixes(node) if self.child[v]] + [0], before))
        to = self.step(node, b)
        last, change, kept = -1, 0, []
        for v in self.suffixes(to):
            t, n = known[self.parent[v]]
            if last < 0 <= self.token[v] and (t < 0 or self.fits(t, self.token[v])):
                last, change = self.token[v], n + 1
            if self.child[v]:
                kept.append((t, n))
        after = (to, tuple([(t, n - change) for t, n in kept] + [(last, 0)]))
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        move = self.moves[state << 8 | b] = self.numbers[after] << 16 | (change + SHIFT)
        return move

    def count(self, word: bytes) -> int:
        state, n, moves = 0, 0, self.moves
        for b in word:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self.compile(state, b)
            state = move >> 16
            n += (move & 0xFFFF) - SHIFT
        if len(moves) > KEPT:
            self.forget()
        return n

    def without_specials(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts without special tokens: bytes, offsets, where texts or what follows a special token start, and how many each text had."""
        n_special, gone, data = np.zeros(len(at) - 1, np.int64), [], raw.tobytes()
        cut = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        rows = {int(np.searchsorted(at, m.start(), side="right")) - 1 for m in cut.finditer(data)} if self.special else ()
        for i in rows:
            for m in cut.finditer(data, at[i], at[i + 1]):
                n_special[i] += 1
                gone.append(m.span())
        if not gone:
            return raw, at, at[:-1], n_special
        kept = np.ones(len(raw), bool)
        for a, b in gone:
            kept[a:b] = False
        place = np.r_[0, np.cumsum(kept)]
        return raw[kept], place[at], np.sort(np.r_[place[at[:-1]], place[[b for _, b in gone]]]), n_special

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of whole texts; null counts as empty."""
        raw, at = text_bytes(texts)
        n_bytes = np.diff(at)
        raw, at, begin, n_special = self.without_specials(raw, at)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.unique(np.searchsorted(place, begin[begin < len(raw)]))
        starts = place[self.words.starts(points, first)]
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        per_word = np.fromiter(map(self.count, found.dictionary.to_pylist()), np.int64, len(found.dictionary))
        upto = np.r_[0, np.cumsum(per_word[found.indices.to_numpy()])]
        word_at = np.searchsorted(starts, at)
        return n_bytes, upto[word_at[1:]] - upto[word_at[:-1]] + n_special


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its UTF-8 bytes, its tokens and whether these are more than ``limit``.

    Tokens are those of the tokenizers library without added special tokens; a special token's string in
    a text is one token, as the library has it. Null counts as empty and has none. Texts may be of any
    length. Rows are counted one by one, so repeated rows and null ids stay; an empty table gives an empty
    result; columns other than the two named are not read. ``path`` names the tokenizer file (byte-level
    BPE without normalizer; others are refused), which every executor must have; by default each finds
    its own copy.
    """

    def run(batches):
        model = load(path or tokenizer_path())
        for batch in batches_by_bytes(batches, "text", STEP):
            n_bytes, n_tokens = model.counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary of 50,257, with the limit of 512."""
    return token_counts(table(spark, sf_dir, "documents"))
