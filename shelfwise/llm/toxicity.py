"""Toxic passages: maximum-scoring segments of token log-odds with extreme-value calibration.

Labelled texts give, for each word and for its prefixes of several lengths, how many toxic and other
texts hold it. The log-odds of a word come from Dirichlet priors in a chain: each prefix's share of
toxic texts is drawn to that of the next shorter one, the shortest to the share over all texts. A
linear scan finds all maximal segments of a text's word scores (each less a constant drift). The best
segment of a harmless text of n words follows an extreme-value law with parameters lambda and K, fitted
to harmless labelled texts; it turns segment scores into comparable excesses over what length alone
explains, and a logistic curve over these gives the score. Scores of labelled texts used in fitting
leave the text's own counts out.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Scratch, batches_by_bytes, ragged, table, text_bytes, words

#: Labelled rows that the model is fitted on, about, chosen by a hash of doc_id.
SAMPLE = 40_000
#: Texts that must hold a word or prefix for it to count.
LEAST_TEXTS = 3
#: Prefix lengths in bytes, and the bytes that make up a word's own key together with its length; those of longer words have a digest as well.
PREFIXES, KEY_BYTES = (3, 4, 5, 6, 7, 8, 10, 12), 24
#: Letters of scripts that put no spaces between words: Thai, Lao, Burmese, Khmer and their kin, kana, bopomofo, Han.
UNSPACED = [
    (0x0E01, 0x0E4E), (0x0E81, 0x0ECE), (0x0EDC, 0x0EDF), (0x1000, 0x103F), (0x1050, 0x109F), (0x1780, 0x17DD), (0x1950, 0x19C9), (0x1A20, 0x1A7C), (0x1B00, 0x1B4C),
    (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9C0), (0xA9E0, 0xA9EF), (0xAA60, 0xAA7F),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x323AF),
]
#: Characters of the overlapping pieces that stand for words there.
GRAM = 4
#: Weight of a prior in texts, and what each word's log-odds lose.
PRIOR, DRIFT = 3.0, 1.0
#: Shares are at least this far from 0 and 1: with many texts they would round to these.
LEAST_SHARE = 1e-5
BINS = np.arange(-12, 12.001, 0.05)


@dataclass
class Model:
    """Counts by key, and the calibration."""

    keys: np.ndarray
    toxic: np.ndarray
    other: np.ndarray
    share: float
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)


def chains(dictionary: pa.Array) -> np.ndarray:
    """Keys of each word's prefixes, short to long, then of the word; 0 where the word is too short."""
    raw, at = text_bytes(dictionary)
    sizes = np.diff(at)
    key = np.full(len(sizes), 0x9E3779B97F4A7C15, np.uint64)
    out = np.zeros((len(PREFIXES) + 1, len(sizes)), np.uint64)
    for j in range(KEY_BYTES):
        live = np.flatnonzero(sizes > j)
        if not len(live):
            break
        x = (key[live] ^ raw[at[live] + j]) * np.uint64(0xBF58476D1CE4E5B9)
        key[live] = x ^ (x >> np.uint64(29))
        if j + 1 in PREFIXES:
            longer = live[sizes[live] > j + 1]
            out[PREFIXES.index(j + 1), longer] = key[longer] | np.uint64(1)
    for i in np.flatnonzero(sizes > KEY_BYTES).tolist():
        key[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(raw[at[i] : at[i + 1]].tobytes(), digest_size=8).digest(), "little"))
    x = (key ^ (sizes.astype(np.uint64) << np.uint64(8))) * np.uint64(0x94D049BB133111EB)
    out[-1] = (x ^ (x >> np.uint64(31))) & ~np.uint64(1)
    return out


@lru_cache(1)
def _character_classes() -> np.ndarray:
    """Of each character beyond ASCII: 0 separates words, 1 is part of words, 2 of runs without spaces, 3 of runs of symbols."""
    out = np.ones(0x110000, np.uint8)
    for c in range(0x80, 0x20000):
        kind = unicodedata.category(chr(c))
        # joiners stand within words, other marks of format at their edges
        out[c] = 0 if kind[0] in "PZ" or kind == "Cc" or kind == "Cf" and c not in (0x200C, 0x200D) else 3 if kind[0] == "S" else 1
    out[0xFE00:0xFE10] = 3
    out[0xE0000:0xE0080] = 0
    for a, b in UNSPACED:
        out[a : b + 1][out[a : b + 1] == 1] = 2
    return out


def _tokens(raw: np.ndarray, rows: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of bytes, as ``common.words`` with ``ALNUM`` has them but parted at all Unicode punctuation and spaces.

    Symbols make words of their own. In scripts without spaces every character starts a word of up to
    GRAM characters. Returns the dictionary-encoded words and the word offsets of the rows (n + 1).
    """
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return words(raw, rows, ALNUM)[:2]
    padded = np.r_[raw, np.zeros(3, np.uint8)]
    first = raw[lead].astype(np.uint32)
    one, two, three = (padded[lead + i].astype(np.uint32) & 0x3F for i in (1, 2, 3))
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = np.where(size == 2, (first & 0x1F) << 6 | one, np.where(size == 3, (first & 0x0F) << 12 | one << 6 | two, (first & 0x07) << 18 | one << 12 | two << 6 | three))
    kind = _character_classes()[np.minimum(code, 0x10FFFF)]
    kinds = ALNUM[0].astype(np.uint8)[raw]
    kinds[lead] = kind
    for i in (1, 2, 3):
        at = lead + i
        some = (size > i) & (padded[at] & 0xC0 == 0x80)  # bytes that are no UTF-8 stay as they are
        kinds[at[some]] = kind[some]
    edge = np.r_[True, kinds[1:] != kinds[:-1]]
    edge[rows[:-1][rows[:-1] < len(raw)]] = True
    starts = edge & (kinds != 0)
    grams = bool((kind == 2).any())
    if grams:
        starts[lead[kind == 2]] = True
    begin, runs = np.flatnonzero(starts), np.flatnonzero(edge)
    ends = np.r_[runs[1:], len(raw)][np.searchsorted(runs, begin, "right") - 1]
    if grams:
        later = np.r_[begin[GRAM:], np.full(min(GRAM, len(begin)), len(raw))]
        ends = np.where(kinds[begin] == 2, np.minimum(ends, later), ends)
    kept = ALNUM[1][raw[ragged(begin, ends - begin)] if grams else raw[kinds != 0]]
    offsets = np.r_[0, np.cumsum(ends - begin)].astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return array.dictionary_encode(), np.searchsorted(begin, rows)


def _coded(column: pa.Array):
    """Each text's words as numbers of distinct words: (numbers, offsets, keys of the distinct words)."""
    raw, rows = text_bytes(column)
    coded, at = _tokens(raw, rows)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, chains(coded.dictionary)


def word_scores(model: Model, keys: np.ndarray, less: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Log-odds of words less the drift; ``less`` is taken off all counts (a text's own)."""
    share = np.full(keys.shape[1], model.share)
    live = np.arange(keys.shape[1])
    for level in keys:
        some = level[live] != 0
        if not len(model.keys):
            break
        i = np.minimum(np.searchsorted(model.keys, level[live]), len(model.keys) - 1)
        found = some & (model.keys[i] == level[live])
        a = np.maximum(model.toxic[i[found]] - less[0], 0)
        b = np.maximum(model.other[i[found]] - less[1], 0)
        at = live[found]
        share[at] = (a + PRIOR * share[at]) / (a + b + PRIOR)
        live = live[found | ~some]  # past an unknown prefix nothing is known
        if not len(live):
            break
    share = np.clip(share, LEAST_SHARE, 1 - LEAST_SHARE)
    return np.log(share / (1 - share)) - np.log(model.share / (1 - model.share)) - DRIFT


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    A candidate is a segment with the sums before it and through its end; a new positive value joins
    the nearest candidate that starts from a lower sum, unless that one already ends higher. Each
    candidate links to the nearest one before it that starts from a lower sum, and a new one follows
    these links; a link once followed is passed over by later ones, so all searches together take a
    number of steps in proportion to the values.
    """
    found: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        low, start, j = before, i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((low, total, start, i + 1, j))
                break
            low, start = found[j][0], found[j][2]
            link = found[j][4]
            del found[j:]
            j = link
    return [(a, b, high - low) for low, high, a, b, _ in found]


def segments_of(scores: np.ndarray, at: np.ndarray):
    """Yields (row, first words, last words + 1, scores) of the rows with segments.

    Neighbouring scores of one sign act as one, so the scan takes a step for each run of them.
    """
    if not len(scores):
        return
    positive = scores > 0
    edge = np.r_[True, positive[1:] != positive[:-1]]
    edge[at[:-1][at[:-1] < len(scores)]] = True
    starts = np.flatnonzero(edge)
    sums = np.add.reduceat(scores, starts)
    row_runs = np.searchsorted(starts, at)
    ends = np.r_[starts[1:], len(scores)]
    any_positive = np.r_[0, np.cumsum(sums > 0)]
    for row in np.flatnonzero(any_positive[row_runs[1:]] > any_positive[row_runs[:-1]]).tolist():
        a, b = row_runs[row], row_runs[row + 1]
        found = maximal_segments(sums[a:b].tolist())
        yield row, starts[[a + x[0] for x in found]] - at[row], ends[[a + x[1] - 1 for x in found]] - at[row], np.array([x[2] for x in found])


def statistics(model: Model, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: words, best segment, its excess, and the excesses of all significant segments."""
    sizes = np.diff(at)
    out = np.zeros((len(sizes), 4))
    out[:, 0] = np.maximum(sizes, 1)
    expected = np.log(model.k * out[:, 0])
    out[:, 2] = -expected
    for row, _, _, found in segments_of(scores, at):
        excess = model.lam * found - expected[row]
        out[row, 1:] = found.max(), excess.max(), np.log1p(excess[excess > 0].sum())
    return out


def probability(model: Model, stats: np.ndarray) -> np.ndarray:
    a, b, c = model.weights
    return 1 / (1 + np.exp(-np.clip(a + b * np.clip(stats[:, 2], -30, 30) + c * stats[:, 3], -35, 35)))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression on two columns by Newton steps."""
    z = np.column_stack([np.ones(len(x)), np.clip(x[:, 0], -30, 30), x[:, 1]])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-9)) @ z + 0.1 * np.eye(3), z.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _lambda(counts: np.ndarray) -> float:
    """The positive root of E exp(lambda s) = 1 over a histogram of scores."""
    middle, p = (BINS[:-1] + BINS[1:]) / 2, counts / max(1, counts.sum())
    if (p * middle).sum() >= 0 or p[middle > 0].sum() == 0:
        return 1.0
    low, high = 0.0, 1.0
    grow = lambda t: (p * np.exp(t * middle)).sum() - 1
    while grow(high) < 0 and high < 50:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 0 else (low, mid)
    return high


def in_fifth(column) -> F.Column:
    """crc32 of the id as text modulo 5; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the model on labelled rows whose crc32(doc_id) mod 5 is not 0.

    Labels of one id count as toxic if one of them is; null labels and ids are left out. If the
    labels are all alike the model knows nothing and gives every text their share.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").filter(in_fifth("doc_id") != 0).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    total = known.count()
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, total)) * (1 << 20)))
    with Scratch(spark) as keep:
        # about ``sample`` rows of two numbers
        rows = keep(docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(known), "_id").select("text", "_toxic"), "labelled")
        n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
        empty = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), (toxic + 0.5) / (n + 1))
        empty.weights = (float(np.log(empty.share / (1 - empty.share))), 0.0, 0.0)
        if not 0 < toxic < n:
            return empty

        def count(batches):
            held = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
            for batch in batches_by_bytes(batches, "text"):
                seq, at, keys = _coded(batch.column("text"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                pair = np.unique(row * max(1, keys.shape[1]) + seq)
                row, word = np.divmod(pair, max(1, keys.shape[1]))
                kind = batch.column("_toxic").to_numpy()
                all_keys, flags = [held[0]], [held[1]]
                for level in keys:
                    k, some = level[word], level[word] != 0
                    # a text counts once for each key
                    order = np.lexsort((k[some], row[some]))
                    k, r = k[some][order], row[some][order]
                    first = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])][: len(k)]
                    t = kind[r[first]]
                    all_keys.append(k[first])
                    flags.append(np.column_stack([t, 1 - t]))
                merged, back = np.unique(np.concatenate(all_keys), return_inverse=True)
                both = np.concatenate(flags)
                held = merged, np.column_stack([np.bincount(back, weights=both[:, c], minlength=len(merged)) for c in (0, 1)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1][:, 0]), pa.array(held[1][:, 1])], ["key", "a", "b"])

        counts = rows.mapInArrow(count, "key long, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= LEAST_TEXTS)
        counts = keep(counts, "token-counts")
        share = toxic / n
        read = counts.toArrow()  # all keys: words of ``sample`` texts and their prefixes
        keys = read.column("key").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        model = Model(keys[by], read.column("a").to_numpy()[by], read.column("b").to_numpy()[by], share)

        def scored(batch, model):
            """Scores of all words with the text's own counts left out."""
            seq, at, keys = _coded(batch.column("text"))
            kind = np.repeat(batch.column("_toxic").to_numpy(), np.diff(at))
            return np.where(kind == 1, word_scores(model, keys, (1, 0))[seq], word_scores(model, keys, (0, 1))[seq]), at, kind

        def histogram(batches):
            total = np.zeros(len(BINS) - 1, np.int64)
            for batch in batches_by_bytes(batches, "text"):
                scores, _, kind = scored(batch, shared.value)
                total += np.histogram(np.clip(scores[kind == 0], BINS[0], BINS[-1] - 1e-9), BINS)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["bin", "n"])

        def measure(batches):
            for batch in batches_by_bytes(batches, "text"):
                scores, at, _ = scored(batch, shared.value)
                stats = statistics(shared.value, scores, at)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("_toxic").to_numpy(), pa.int32()), *(pa.array(stats[:, c]) for c in range(4))], ["t", "n", "best", "excess", "all"])

        shared = spark.sparkContext.broadcast(model)
        bins = rows.mapInArrow(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
        weight = np.zeros(len(BINS) - 1)
        weight[bins.column("bin").to_numpy()] = bins.column("n").to_numpy()
        model.lam = _lambda(weight)
        shared = spark.sparkContext.broadcast(model)
        schema = "t int, n double, best double, excess double, all double"
        first = rows.mapInArrow(measure, schema).filter("t = 0").agg(F.count("*"), F.sum(F.col("n") * F.exp(-model.lam * F.col("best")))).first()
        model.k = float(first[0] / first[1])
        shared = spark.sparkContext.broadcast(model)
        got = rows.mapInArrow(measure, schema).select("t", "excess", "all").toArrow()  # about ``sample`` rows
        model.weights = _fit_logistic(np.column_stack([got.column("excess").to_numpy(), got.column("all").to_numpy()]), got.column("t").to_numpy())
        if not np.isfinite([model.lam, model.k, *model.weights]).all():
            raise ArithmeticError(f"no calibration was found: {model.lam}, {model.k}, {model.weights}")
        return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from the whole text.

    Null, empty and wordless texts get the score of a text without a toxic word. Very long texts are
    read whole, in time proportional to their length. Repeated rows and
    null ids are kept (a null id is not held out); an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches_by_bytes(batches, "text"):
            seq, at, keys = _coded(batch.column("text"))
            p = probability(shared.value, statistics(shared.value, word_scores(shared.value, keys)[seq], at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(in_fifth(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", expected: float = 0.01) -> DataFrame:
    """Every segment that a harmless text of the same length would hold less than ``expected`` times.

    Returns doc_id, first_word, end_word, score and the expected number; words as in the scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, first_word long, end_word long, score double, expected double"

    def run(batches):
        for batch in batches_by_bytes(batches, "text"):
            seq, at, keys = _coded(batch.column("text"))
            ids, out, m = batch.column("doc_id").to_pylist(), [], shared.value
            for row, a, b, found in segments_of(word_scores(m, keys)[seq], at):
                e = m.k * max(1, at[row + 1] - at[row]) * np.exp(-m.lam * found)
                out += [(ids[row], *x) for x in zip(a[e < expected].tolist(), b[e < expected].tolist(), found[e < expected].tolist(), e[e < expected].tolist())]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, all columns as they are.

    A model that knows no word (no labels, or all alike) rejects nothing. Null, empty and very long
    texts are scored as in ``scores``; repeated rows and null ids stay or go by their texts alone; an
    empty table stays empty.
    """
    if not len(model.keys):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches_by_bytes(batches, text_col):
            seq, at, keys = _coded(batch.column(text_col))
            p = probability(shared.value, statistics(shared.value, word_scores(shared.value, keys)[seq], at))
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
