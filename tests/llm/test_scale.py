"""Work that must not grow with the square of its input, and passages of very long texts."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfwise.llm import minhash, toxicity
from shelfwise.llm.htmltree import Forest
from tests.conftest import DATA


@pytest.mark.parametrize("pattern", [[1, -2], [1, -0.5], [2, -1, 1, -3], [1, -1.5, 1.2, -1]])
def test_a_million_runs_are_scanned_in_seconds(pattern):
    began = time.perf_counter()
    found = toxicity.maximal_segments(pattern * (1_000_000 // len(pattern)))
    assert found and time.perf_counter() - began < 20


def test_segments_of_falling_sums_are_all_found():
    found = toxicity.maximal_segments([1, -2] * 5000)
    assert found == [(2 * i, 2 * i + 1, 1) for i in range(5000)]
    rows = list(toxicity.segments_of(np.array([1.0, -2.0] * 5000), np.array([0, 10000])))
    assert len(rows) == 1 and len(rows[0][3]) == 5000


def edited(copies, seed=1):
    """Copies of one text of 200 words with a word changed, and a few unlike texts that hold half of it."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    out = []
    for i in range(copies):
        words = list(base)
        words[r.randrange(200)] = f"own{i}"
        out.append(" ".join(words))
    return out + [" ".join(base[:160] + [f"x{j}-{i}" for i in range(50)]) for j in range(3)]


def test_rows_of_a_group_of_near_copies_meet_only_once(spark):
    """Rows of every step grow with the copies, not with their square."""
    counts = []
    for copies in (200, 800):
        docs = spark.createDataFrame(list(enumerate(edited(copies))), "doc_id long, text string")
        found = {}

        class Counted(minhash.Scratch):
            def __call__(self, df, label):
                out = super().__call__(df, label)
                found[label] = max(found.get(label, 0), out.count())
                return out

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(minhash, "Scratch", Counted)
            got = minhash.near_groups(docs).collect()
        assert len({x.component_id for x in got if x.doc_id < copies}) == 1 and sum(x.kept for x in got) == 4
        counts.append(found)
    few, many = counts
    for label in many:
        assert many[label] <= 4.5 * few[label] + 40, label


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_every_link_of_the_documents_is_found(spark):
    """Recall against brute force: every document whose id is divisible by 20, against all."""
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/documents.parquet")
    part = {x.doc_id: x.component_id for x in minhash.near_groups(docs, 4).collect()}
    sets = {x.doc_id: shingles(x.text) for x in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    links = 0
    for i in sets:
        if i % 20 == 0:
            both = Counter(j for x in sets[i] for j in holders[x])
            linked = [j for j, n in both.items() if j != i and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)]
            links += len(linked)
            assert all(part[j] == part[i] for j in linked)
    assert links > 20


@pytest.mark.parametrize("make", [lambda n: "<b>" * n + "<p>x</p>" * n, lambda n: "<div>" * n + "</x>" * n, lambda n: "<span>" * n + "<li>x" * n])
def test_parser_does_not_look_through_open_elements(make):
    def seconds(n):
        page, t = make(n), time.process_time()
        Forest().add(page)
        return time.process_time() - t

    seconds(1000)
    assert seconds(80_000) < 30 * max(seconds(8_000), 0.02)  # ten times the markup; a square would be a hundred times
