"""Words looked up by hash give the ids of the tokenizer."""

import random

import numpy as np
import pytest
import public_tokenizers

from runloom.llm.tokens import WordEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!",
          "\x85", "x's", "I'll", "\x1c", "\r\n", "œ", "中", "don't", "''s", " '", "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(PATH)


def test_same_ids_as_whole_texts(encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder(texts)] == want


def test_without_the_fast_merges_and_with_a_full_memory(monkeypatch):
    from runloom.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN", 3)
    slow = WordEncoder(PATH)
    slow.merger = None
    texts = ["some words, some more", "", "words again\n\nand  more"]
    for _ in range(3):
        got = slow(texts)
    assert [x.tolist() for x in got] == [
        slow.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(x.dtype == np.uint32 for x in got)


def test_added_tokens_are_found_as_in_a_fresh_tokenizer(encoder):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|>", "a <|endoftext|>b", "中<|endoftext|>", "<|endoftext|", "plain"]
    got = [x.tolist() for x in encoder(texts)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [50256]
