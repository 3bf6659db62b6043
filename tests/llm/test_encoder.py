"""Token ids of pieces: those that came before are not encoded again, and the others equal the library's in any neighbourhood."""

from __future__ import annotations

import random
from itertools import islice, product

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracemill.llm import tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(TOKENIZER)


class Watched:
    """A tokenizer, and its model, that count what they are asked."""

    def __init__(self, tokenizer):
        self.own, self.model, self.asked = tokenizer, self, 0

    def tokenize(self, letters):
        self.asked += 1
        return self.own.model.tokenize(letters)

    def encode(self, *given):
        self.asked += 1
        return self.own.encode(*given)


def ids_of(texts, own, most=tokens.BYTES_AT_ONCE):
    got = []
    for _, ids, begins in tokens.encoded(pa.array(texts, pa.string()), own, most):
        got += [ids[a:b].tolist() for a, b in zip(begins.tolist(), begins[1:].tolist())]
    return got


def expected(texts):
    return [x.ids for x in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def test_pieces_of_earlier_runs_are_not_encoded_again():
    """Three runs of 270,000 words each; after two of them the words of the first had been forgotten."""
    own = tokens.Encoder(TOKENIZER)
    own.tokenizer = watched = Watched(own.tokenizer)
    words = ["".join(x) for x in islice(product("abcdefghijklmnopqrst", repeat=5), 810_000)]
    for k in range(0, len(words), 270_000):
        own.encode(pa.array([" ".join(words[k : k + 270_000])]))
    assert watched.asked == len(words)
    again = " ".join(words[:1000])
    assert ids_of([again], own) == expected([again]) and watched.asked == len(words)


def test_parts_reach_the_model_once():
    own = tokens.Encoder(TOKENIZER)
    own.tokenizer = watched = Watched(own.tokenizer)
    text = " ".join(f"{word}{mark}" for word in ("Stone", "élan", "naïve", "2024") for mark in ("", ".", ",", "!!", ".\nThe", "(x)"))
    assert ids_of([text] * 3, own) == expected([text] * 3)
    # The first word without a space, the four with one, and . , !! \n The ( x ) without one
    assert watched.asked == 1 + 4 + 8


@pytest.mark.parametrize("known", [0, 40, 1_000_000])
@pytest.mark.parametrize("signs", [
    ["a", "Bc", " ", " ", " ", "\n", ".", ",", "12", "é", "!!", "The"],
    ["a", " ", "'", "s", "re", "'ll", "don't", "\n", "я", "ẞ", " ", "​", "º", "µ", "×", "ǂ", "٣", "\0", "中文", "\x1c", "<|endoftext|>"],
])
def test_any_neighbours(monkeypatch, known, signs):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", known)
    rng, own = random.Random(known), tokens.Encoder(TOKENIZER)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(2000)]
    assert ids_of(texts, own, 3000) == expected(texts) == ids_of(texts, own)


def test_long_pieces():
    """Texts without any space, and lines that end within many pieces."""
    own = tokens.Encoder(TOKENIZER)
    texts = ["中文" * 9000, "é" * 9999 + "中 " + "b中" * 10_001 + " c中", "", "x" * 30_000 + ".", " ".join(f"к{k}" for k in range(5000))]
    assert ids_of(texts, own) == expected(texts)
