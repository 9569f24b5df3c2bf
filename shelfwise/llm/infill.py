"""Fill-in-the-middle texts by overlapping chunks.

A text is cut at two of its unit borders into prefix, middle and suffix. A border lies between two
neighbouring characters and is told by these two alone, so texts are laid out in chunks of a fixed
size, each of which also sees the character before it. All chunks count their borders at once; prefix
sums over the counts of a text's chunks give each chunk the number of its first border, by which the
two wanted borders are routed to the chunks that own them; only these are read again for the place.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_bytes, ragged, table, text_bytes

#: Bytes of a chunk.
CHUNK = 4096
#: Text bytes of one step; a longer text makes a step of its own.
STEP = 4 << 20
#: What marks the parts in an output (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LINE_END = ord("\n")


def after_line_end(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether a line starts between two neighbouring bytes. Line ends are single bytes in UTF-8."""
    return before == LINE_END


class Chunks:
    """Chunks of the texts laid end to end in ``raw``; text i is raw[at[i]:at[i + 1]].

    ``border`` tells for pairs of neighbours whether a unit starts between them. A chunk owns the pairs
    whose second byte it holds; the first pair's other byte is the overlap with the chunk before.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, border=after_line_end, size: int = CHUNK):
        self.raw, self.at, self.border = raw, at, border
        lengths = np.diff(at)
        per_text = -(-lengths // size)
        self.first = np.r_[0, np.cumsum(per_text)]
        number = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        text_start, text_end = np.repeat(at[:-1], per_text), np.repeat(at[1:], per_text)
        self.start = text_start + number * size
        self.end = np.minimum(self.start + size, text_end)
        # a text's first byte has no neighbour before it
        self.own = self.start + (number == 0)
        flags = np.zeros(len(raw), bool)
        if len(raw):
            flags[1:] = border(raw[:-1], raw[1:])
            flags[at[:-1][lengths > 0]] = False
        self.counts = np.add.reduceat(flags, self.start, dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
        self.upto = np.r_[0, np.cumsum(self.counts)]
        borders = self.upto[self.first[1:]] - self.upto[self.first[:-1]]
        self.units = np.where(lengths > 0, borders + 1, 0)

    def cut(self, rank: np.ndarray) -> np.ndarray:
        """Where the first ``rank`` units of each text end (a place in ``raw``)."""
        out = self.at[:-1].copy()
        out[rank >= self.units] = self.at[1:][rank >= self.units]
        inner = np.flatnonzero((rank > 0) & (rank < self.units))
        if not len(inner):
            return out
        # the border that ends unit r is number r - 1 of its text
        wanted = self.upto[self.first[inner]] + rank[inner] - 1
        owner = np.searchsorted(self.upto, wanted, side="right") - 1
        chunks, back = np.unique(owner, return_inverse=True)
        sizes = self.end[chunks] - self.own[chunks]
        places = ragged(self.own[chunks], sizes)
        hits = places[self.border(self.raw[places - 1], self.raw[places])]
        found = np.r_[0, np.cumsum(self.counts[chunks])[:-1]]
        out[inner] = hits[found[back] + wanted - self.upto[owner]]
        return out


def drawn(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits that depend on seed and id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    if form == "spm":
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return prefix + middle + suffix


def restored(form: str, output: bytes) -> bytes:
    """The text behind an output; a text that holds a mark itself is only ever plain, so marks are where they first occur."""
    if form == "plain":
        return output
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    parts, rest = {}, output.removeprefix(marks[0])
    for mark, after in zip(marks, marks[1:]):
        parts[mark], _, rest = rest.partition(after)
    return parts[PREFIX] + rest + parts[SUFFIX]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _step(batch: pa.RecordBatch, seed: int, rate: int, spm: int, texts: bool) -> pa.RecordBatch:
    raw, at = text_bytes(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    chunks = Chunks(raw, at)
    h = np.array([drawn(i, seed) for i in ids], np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (chunks.units + 1), h[:, 1] % (chunks.units + 1)
    one, two = chunks.cut(np.minimum(a, b)), chunks.cut(np.maximum(a, b))
    data = memoryview(raw)
    forms, lengths, outputs, sums, backs = [], [], [], [], []
    for i, (s, x, y, e) in enumerate(zip(at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist())):
        text = bytes(data[s:e])
        if not text or h[i, 2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            form = "plain"
        else:
            form = "spm" if h[i, 3] % 100 < spm else "psm"
        prefix, middle, suffix = text[: x - s], text[x - s : y - s], text[y - s :]
        output = arranged(form, prefix, middle, suffix)
        forms.append(form)
        lengths.append((None, None) if form == "plain" else (len(prefix.decode()), len(middle.decode())))
        sums.append(hashlib.sha256(output).hexdigest())
        backs.append(hashlib.sha256(restored(form, output)).hexdigest())
        if texts:
            outputs.append(output.decode())
    columns = [
        batch.column("doc_id"),
        pa.array(chunks.units, pa.int64()),
        pa.array(forms, pa.string()),
        pa.array([x for x, _ in lengths], pa.int64()),
        pa.array([x for _, x in lengths], pa.int64()),
        pa.array(sums, pa.string()),
        pa.array(backs, pa.string()),
    ]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(columns + [pa.array(outputs, pa.string())] * texts, names + ["output"] * texts)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per row its number of lines, form, part lengths and the SHA-256 of the output and of the text restored from it.

    ``rate`` percent of the documents are transformed, of these ``spm`` percent with the suffix first;
    ``texts`` adds the output itself. A text that is empty, null or holds a mark stays plain (null counts
    as empty), its part lengths are null. A null id draws as an empty one does. Rows are judged one by
    one, so repeated rows give equal results; texts may be of any length, each is in memory with its
    output. An empty table gives an empty result; columns other than the two named are not read.
    """

    def run(batches):
        yield from map(partial(_step, seed=seed, rate=rate, spm=spm, texts=texts), batches_by_bytes(batches, "text", STEP))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA + ", output string" * texts)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with seed 7, all of them transformed, half with the suffix first."""
    return fill_in_middle(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents
), h AS (
  SELECT doc_id, t, units, len(units) AS n,
         CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(units) + 1) AS a,
         CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
         CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS c,
         CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS s
  FROM d
), parts AS (
  SELECT doc_id, t, n,
         array_to_string(units[1:least(a, b)], '') AS p,
         array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(units[greatest(a, b) + 1:n], '') AS e,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 100 THEN 'plain'
              WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m
                        ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
