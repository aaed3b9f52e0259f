"""The encoder's memo, special tokens, and how token ids hold on odd texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmark.llm import encoding


def ids(encoder, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special_text", [True, False])
def test_strings_of_special_tokens(name, special_text):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = special_text
    own = encoding.Encoder(path, special_text=special_text)
    rng = random.Random(3)
    bits = ["<|endoftext|>", "<|startoftext|>", " ", "a word", "x", "<|", "\n", "Ünïcode "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(200)]
    assert ids(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_switch_is_the_librarys_default_when_off():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)  # no switch set
    own = encoding.Encoder(path, special_text=False)
    texts = ["end<|endoftext|>", "plain words only", ""]
    assert ids(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_memo_that_overflows_keeps_its_bound_and_the_ids(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    own = encoding.Encoder(path, memo_chunks=50)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß漢1.,") for _ in range(rng.randrange(1, 9)))
    for _ in range(20):
        texts = [" ".join(word() for _ in range(rng.randrange(80))) for _ in range(6)]
        assert ids(own, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
        memo = own._memo
        assert len(memo._chunks) <= 50 and len(memo.starts) == len(memo._chunks) + 1 and memo.starts[-1] == len(memo.ids)
