"""Words cut before signs, and texts without blanks, against the library."""

import random
import tracemalloc

import pytest
import sentencepiece

from dialogweave.llm import sentencepiece_codec
from dialogweave.llm.queries import tokenizer


@pytest.fixture(scope="module")
def model():
    return tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


def _same(codec, library, text):
    ids = library.encode(text)
    assert codec.encode_joined(text) == (",".join(map(str, ids)), library.decode(ids)), text[:200]


def test_words_before_signs(model, library):
    codec, r = sentencepiece_codec.PieceCodec(model), random.Random(3)
    signs, letters = ".,;:!?)_\'\"-", "abeghinorstéüßÇñ²ø中😀\0\u2581"
    for _ in range(6000):
        text = "".join(r.choice(signs if r.random() < 0.3 else letters + "aeinrst \n\t" * 3) for _ in range(r.randrange(1, 40)))
        _same(codec, library, text)
    for text in ("www.example.com, e.g. this...", "a_, b__; c²., d", "wait!!! what?!", "x\0y, \0", "nan", " ", "\n", ",", "end."):
        _same(codec, library, text)


def test_small_windows(model, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "WINDOW", 40)
    codec, r = sentencepiece_codec.PieceCodec(model), random.Random(4)
    for _ in range(300):
        _same(codec, library, "".join(r.choice("aeinrsthl.=/é中😀") for _ in range(r.randrange(30, 400))))
    _same(codec, library, "a" * 5000 + "=" * 3000)


def test_memory_of_a_text_without_blanks(model):
    codec, r = sentencepiece_codec.PieceCodec(model), random.Random(5)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(500_000))
    codec.encode_joined(text[:2000])
    tracemalloc.start()
    codec.encode_joined(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * len(text) + (60 << 20)


def test_memo_is_bounded(model, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMO_BYTES", 20_000)
    codec = sentencepiece_codec.PieceCodec(model)
    for i in range(3000):
        codec.encode_joined(f"word{i} another{i}! {'x' * 70}{i}")
    assert codec.whole.size <= 20_400 and len(codec.whole) + len(codec.whole.older) < 300
