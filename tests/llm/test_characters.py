"""Token ids of every character, alone and within words, as the library has them."""

import json
import random

import pyarrow as pa
import pytest

from shelfwise.llm import bpe

POINTS = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def model():
    return bpe.load(bpe.tokenizer_path())


def different(model, texts):
    ids, at = model.encode(pa.array(texts)).flat()
    want = [x.ids for x in model.library.encode_batch_fast(texts, add_special_tokens=False)]
    return [t for i, t in enumerate(texts) if ids[at[i] : at[i + 1]].tolist() != want[i]]


@pytest.mark.parametrize("form", ["a{}b", " {}b", "{}"])
def test_every_character(model, form):
    assert different(model, [form.format(chr(c)) for c in POINTS]) == []


def test_capitals_that_become_letters_far_away(model):
    assert different(model, ["Ɗan", "Ɓauna", "Ɔman", "Ɖeka", "ƏLİ", "İstanbul", "ŸÝŽ", "Ʃ1Ʋ"]) == []


def test_random_strings_of_all_planes(model):
    r = random.Random(11)
    near = [*range(0x20, 0x7F)] * 3 + [*range(0x80, 0x250)] * 2 + [9, 10, 13, 0, 0x1C, 0x1F, 0x300, 0x301, 0x3A3, 0x200D, 0xFE0F, 0x1E9E, 0x212A]
    far = [*POINTS, *range(0x10000, 0x110000, 7)]
    texts = ["".join(chr(r.choice(near if r.random() < 0.8 else far)) for _ in range(r.randint(0, 14))) for _ in range(100_000)]
    assert different(model, texts) == []


@pytest.mark.parametrize("change", [{"normalizer": None}, {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}, {"model": {"end_of_word_suffix": None}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        read = json.load(f)
    for key, value in change.items():
        read[key] = read[key] | value if isinstance(value, dict) and isinstance(read[key], dict) else value
    path = tmp_path / "other.json"
    path.write_text(json.dumps(read), encoding="utf-8")
    with pytest.raises(ValueError, match="no tokenizer of this kind"):
        bpe.WordBpe(str(path))
