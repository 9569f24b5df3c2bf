"""The audit of filters against plain counting over every order."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest

from shelfwise.llm import filters
from tests.conftest import canonical
from tests.llm.test_corpus import TEXTS

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = ["A"] if len(ws) < 100 else []
    found += ["B"] if 100 * len(set(ws)) < 80 * len(ws) else []
    found += ["C"] if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else []
    return found + (["D"] if re.search(r"[#$%&*|]", text) else [])


def plain_audit(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, lang in docs:
        f = failed(text or "") + (["E"] if i is not None and i > least[text or ""] else [])
        parts[lang or ""].append((f, i in good, i in toxic))
    rows = []
    for part, found in parts.items():
        shapley, own = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(here)
                redundant = sum(f in x[0] for x in found) - len(here)
                own.append((part, order, step, len(left), len(here), redundant, sum(x[0] == [f] for x in found), sum(x[1] for x in here), sum(x[2] for x in here), f))
        rows += [(*x[:-1], shapley[x[-1]]) for x in own]
    return rows


def made(r):
    return " ".join(r.choices(["a", "Bc", "d#", "É", "\t", *[f"w{i}" for i in range(90)]], k=r.choice([3, 60, 130])))


@pytest.mark.parametrize("held", [2, 256])
def test_same_as_plain_counting(spark, monkeypatch, held):
    monkeypatch.setattr(filters, "HELD", held)
    r = random.Random(6)
    texts = [*TEXTS, *[made(r) for _ in range(60)], "AAA b", "x | y"]
    texts += r.choices(texts, k=80) + ["hot"] * 60
    docs = [(r.choice([None, 7, *range(200)]) if i % 9 == 0 else i, t, r.choice([None, "", "en", "de", "日"])) for i, t in enumerate(texts)]
    docs.append(docs[20])
    labels = [(r.choice([None, *range(250)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(200)]
    frame = spark.createDataFrame([(i, t, p, p, 3) for i, t, p in docs], "doc_id long, text string, lang string, part string, mask int")
    given = spark.createDataFrame([(i, q, t, 1) for i, q, t in labels], "doc_id long, quality int, toxic int, good int")
    got = filters.filter_audit(frame, given).select(COLUMNS).collect()
    assert canonical(got) == canonical(plain_audit(docs, labels))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "A", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.filter_audit(docs.limit(0), labels).collect() == []
    got = filters.filter_audit(docs, labels).collect()
    assert len(got) == 600 and sum(x.good_lost + x.toxic_lost for x in got) == 0


def test_masks_of_long_texts():
    texts = ["A b " * 200_000, " ".join(map(str, range(200_000))), ""]
    assert filters.failures(pa.array(texts)).tolist() == [0b0110, 0b0000, 0b0001]
