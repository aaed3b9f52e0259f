"""Long words go through the recursive queries and come out as tiktoken has them."""

import random
import time

import public_tokenizers
import pytest
import tiktoken

from quillmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABETS = ["a", "ab", "ACGT", "0123456789", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "日本語漢字東京", "-=_", "aé", "xX"]


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_words_of_all_lengths(own, library):
    rng = random.Random(9)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS for n in [1, 2, 63, 64, 65, 66, 200, 1023, 1024, 1025, 5000]]
    texts += ["".join(rng.choice(["the", "ing", "ab", "aba", "ba", "x"]) for _ in range(n)) for n in (20, 300, 2000)]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_both_queries_and_the_heap_agree(own):
    rng = random.Random(10)
    words = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 150))) for alphabet in (b"ab", b"aAbB", b"etaoin", b"\xc3\xa9\xe6\x97") for _ in range(60)]
    short = [x.tolist() for x in own._contract(words)]
    assert short == [x.tolist() for x in own._contract(words, bpe.CONTRACT_LONG, 32)] == [own._heap(w) for w in words]
    assert short == [x.tolist() for x in own._contract_all(words)]


def test_parts_are_never_joined(own):
    rng = random.Random(11)
    for _ in range(200):
        word = bytes(rng.choice(b"qxzjkvw-ab\xe6\x97\xa5") for _ in range(rng.randrange(1, 120)))
        parts = own.cut(word)
        assert b"".join(parts) == word and all(parts)
        assert [t for p in parts for t in own._heap(p)] == own._heap(word)


def test_many_long_words_take_little_time(own, library):
    rng = random.Random(12)
    own.encode(["warm up"])
    words = ["".join(rng.choice(ALPHABETS[5]) for _ in range(1000)) for _ in range(200)] + ["".join(rng.choice("ACGT") for _ in range(50_000)), "b" * 100_000]
    start = time.process_time()
    got = own.encode(words)
    assert time.process_time() - start < 5
    assert [x.tolist() for x in got] == [library.encode_ordinary(w) for w in words]


def test_parts_beyond_a_query_take_the_heap(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "HEAP_BYTES", 100)
    text = "a" * 300 + " " + "ab" * 400
    assert own.encode([text])[0].tolist() == library.encode_ordinary(text)
