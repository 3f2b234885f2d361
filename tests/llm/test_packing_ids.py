"""Ids of whole texts against the tokenizer's library, with few calls for the new stretches of a text."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchlake.llm import packing

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ENDS = ["", " ", "  ", "\n", " \n", "\t ", "\x1c ", "\x85", "\xa0 ", "​ ", "'s", "<|endoftext|>", "<|", "é", "ǻ ", "漢字 ", "!? ", "\x00 "]


@pytest.mark.parametrize("remembered", [3, 100_000])
def test_ids_are_the_library_s(monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    library, pick = Tokenizer.from_file(PATH), random.Random(5)
    library.no_truncation()
    library.no_padding()
    encoder = packing.Encoder(PATH, RANKS)
    words = ["a", "Word", "word,", "it's", "x" * 40, "naïve", "Straße", "9,99", "...", "(b)", "日本", "z\ny", "\ny", "_", "we'll"]
    texts = [*ENDS, *["a" + x + "b" + x for x in ENDS]]
    texts += ["".join(pick.choice(words) + pick.choice([" ", " ", " ", *ENDS]) for _ in range(pick.randrange(1, 60))) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_stretches_of_a_text_are_encoded_together():
    encoder, calls = packing.Encoder(PATH, RANKS), []

    class Counted:
        def encode_ordinary(self, text, own=encoder.ranked):
            calls.append(text)
            return own.encode_ordinary(text)

    encoder.ranked = Counted()
    encoder.ids(" ".join(f"word{i}, {i}" for i in range(500)))
    assert len(calls) <= 3
