"""Token counts against the library, whatever the sizes of chunks and of the compiled tables."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import token_counts
from tests.llm.test_corpus import TEXTS, empty, frame

PIECES = ["'", "s", "re", "r", "v", "e", "ve", "l", "ll", " ", "  ", "\n", "a", "B", "1", "2", "!", "é", "日", "\xa0", "　", "<|endoftext|>", "<|", "\t", "'s", "٣", "²", "x"]
NEAR = [*range(32, 127)] * 3 + [*range(0x80, 0x250)] * 2 + [9, 10, 13, 0, 0x1C, 0x1F, 0x85, 0x300, 0x301, 0x200D, 0x1680, 0x180E, 0x2028]
FAR = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def model():
    return token_counts.load(token_counts.tokenizer_path())


def different(model, texts):
    n = model.counts(pa.array(texts, pa.string()))[1].tolist()
    return [(t, a) for t, a, x in zip(texts, n, model.library.encode_batch_fast(texts, add_special_tokens=False)) if a != len(x.ids)]


def odd(r, n):
    return ["".join(r.choices(PIECES, k=r.randint(0, 12))) for _ in range(n)]


def test_borders_contractions_and_specials(model):
    assert different(model, odd(random.Random(1), 40_000)) == []


def test_random_strings_of_all_planes(model):
    r = random.Random(2)
    assert different(model, ["".join(chr(r.choice(NEAR if r.random() < 0.8 else FAR)) for _ in range(r.randint(0, 14))) for _ in range(40_000)]) == []


@pytest.mark.parametrize("form", ["a{}b", " {}1", "!{}", "'{}e"])
def test_every_character(model, form):
    assert different(model, [form.format(chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]) == []


def test_runs_and_long_texts(model):
    runs = [unit * k for unit in ("a", "ab", " ", "=", "\n ", "日", "0") for k in range(0, 300, 3)]
    assert different(model, [*runs, "日本語" * 3000, "x" * 100_000, " ".join(map(str, range(50_000)))]) == []


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_words_do_not_depend_on_chunks(model, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    assert different(model, odd(random.Random(chunk), 2000)) == []


def test_tables_that_are_forgotten(model, monkeypatch):
    texts = odd(random.Random(9), 300) + ["<|endoftext|>" * 5, "<|endoftext|"]
    want = model.counts(pa.array(texts))[1].tolist()
    monkeypatch.setattr(token_counts, "KEPT", 3)
    model.forget()
    assert model.counts(pa.array(texts))[1].tolist() == want
    model.forget()


def test_changes_of_the_count_add_up(model):
    """Every prefix of a word has the count that its transitions lead to."""
    for word in ("internationalisation", "aaaaaaaaaaaa", " unbelievably", "-------=="):
        library = [len(model.library.encode(word[:k], add_special_tokens=False).ids) for k in range(1, len(word) + 1)]
        assert [model.count(word[:k].encode()) for k in range(1, len(word) + 1)] == library


def test_words_are_those_of_the_pattern(model):
    """ASCII words as a plain pattern cuts them."""
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choices("'srevlmd  \n\ta1!", k=r.randint(1, 20)))
        starts = model.words.starts(np.array([ord(c) for c in text], np.uint32), np.array([0]))
        assert starts.tolist() == [m.start() for m in pattern.finditer(text)]


def test_query(spark):
    docs = frame(spark, TEXTS + ["w " * 512, "w " * 511, "<|endoftext|>"])
    got = {(x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts.token_counts(docs).collect()}
    library = token_counts.load(token_counts.tokenizer_path()).library
    want = set()
    for x in docs.select("doc_id", "text").collect():
        n = len(library.encode(x.text or "", add_special_tokens=False).ids)
        want.add((x.doc_id, len((x.text or "").encode()), n, n > 512))
    assert got == want
    assert token_counts.token_counts(empty(spark)).collect() == []


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"model": {"ignore_merges": True}}, {"pre_tokenizer": None}])
def test_other_tokenizers_are_refused(tmp_path, change):
    with open(token_counts.tokenizer_path(), encoding="utf-8") as f:
        read = json.load(f)
    for key, value in change.items():
        read[key] = read[key] | value if isinstance(value, dict) and isinstance(read[key], dict) else value
    path = tmp_path / "other.json"
    path.write_text(json.dumps(read), encoding="utf-8")
    with pytest.raises(ValueError, match="no tokenizer of this kind"):
        token_counts.ByteBpe(str(path))
