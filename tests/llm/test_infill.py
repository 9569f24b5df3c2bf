"""Fill-in-the-middle texts against a plain rule, whatever the size of a chunk."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import infill
from shelfwise.llm.common import text_bytes
from tests.conftest import canonical
from tests.llm.test_corpus import TEXTS, empty, frame


def plain_rule(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made(r):
    return "".join(r.choices(["\n", "\r", "a", "é", "日", "𝄞", "<", "P", ">", " ", "\n\n"], k=r.randint(0, 60)))


@pytest.mark.parametrize("given", [{}, {"seed": 3, "rate": 60, "spm": 20}])
def test_same_as_the_rule(spark, given):
    r = random.Random(5)
    texts = [*TEXTS, "<P>", "a\n<M>b\n", "\n", "\n\n", "no line end", *[made(r) for _ in range(300)]]
    docs = frame(spark, texts)
    got = infill.fill_in_middle(docs, texts=True, **given).collect()
    want = [plain_rule(x.doc_id, x.text, **given) for x in docs.select("doc_id", "text").collect()]
    assert canonical([x[:5] + (x.output,) for x in got]) == canonical(want)
    by_id = {x.doc_id: x.text or "" for x in docs.select("doc_id", "text").collect()}
    for x in got:
        assert x.output_sha256 == hashlib.sha256(x.output.encode()).hexdigest()
        assert x.restored_sha256 == hashlib.sha256(by_id[x.doc_id].encode()).hexdigest()
    assert {x.form for x in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 4096])
def test_cuts_do_not_depend_on_chunks(size):
    r = random.Random(size)
    texts = [made(r) for _ in range(80)]
    raw, at = text_bytes(pa.array(texts))
    chunks = infill.Chunks(raw, at, size=size)
    units = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in texts]
    assert chunks.units.tolist() == [len(u) for u in units]
    for _ in range(20):
        rank = np.array([r.randint(0, len(u)) for u in units])
        want = [len("".join(u[:k]).encode()) for u, k in zip(units, rank.tolist())]
        assert (chunks.cut(rank) - at[:-1]).tolist() == want


def test_marks_beside_angle_brackets_are_found():
    for form in ("psm", "spm"):
        for parts in ((b"a<", b"<", b"S>"), (b"", b">", b"<"), (b"P><", b"<S", b"M>"), (b"<<P", b"", b"<")):
            assert infill.restored(form, infill.arranged(form, *parts)) == b"".join(parts)


def test_empty_table(spark):
    assert infill.fill_in_middle(empty(spark)).collect() == []
