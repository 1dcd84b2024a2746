"""Pieces of texts that the encoder remembers: ids as the library's, a word once whatever follows it, none that is long."""

import random

import numpy as np
import pytest

from kilnflow.llm import token_files
from kilnflow.llm.tokenizer_path import default_tokenizer

LETTERS = [*"abZéßÉ×÷ªµñжҁ҂Ωώ漢", "the", "naïve", "слово", "\U0001df00", "ꟲ"]
OTHERS = [*".,;:!?*$%&#|()\"'-_/09²½…“🙂\x00\x01\x02\x03​﻿", "'s", "<|endoftext|>"]
SPACES = [*" \n\t\r\x0b\x1c\x85\xa0　", "\n\n", " \n", "  "]


@pytest.mark.parametrize("seed", range(4))
def test_ids_of_odd_texts(seed):
    from tokenizers import Tokenizer

    some = random.Random(seed)
    encoder, plain = token_files.Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    for _ in range(150):
        pool = some.sample(LETTERS, 4) + some.sample(OTHERS, 3) + some.sample(SPACES, 2) + [" ", " ", "\n", "."]
        texts = ["".join(some.choices(pool, k=some.randint(0, 60))) for _ in range(some.randint(0, 20))]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_a_word_is_learnt_once():
    encoder = token_files.Encoder(default_tokenizer())
    encoder.encode(["x stemword, stemword. stemword!\nstemword\nNext (stemword)"])
    assert [w for w in encoder.known if "stemword" in w and w.strip("\x01(") != "stemword"] == []


def test_long_pieces_are_not_remembered():
    encoder = token_files.Encoder(default_tokenizer())
    texts = ["z" * 5000, "a " + "7" * 5000 + " b", "漢字" * 500]
    assert encoder.encode(texts) == encoder.encode(texts)
    assert max(map(len, encoder.known)) <= 64


def test_new_generations(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50 * 210)
    encoder = token_files.Encoder(default_tokenizer())
    texts = [" ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} again, and" for i in range(k, k + 60)) for k in range(0, 600, 30)]
    fresh = [token_files.Encoder(default_tokenizer()).encode([t])[0] for t in texts[:2]]
    assert [encoder.encode([t])[0] for t in texts][:2] == fresh
    assert len(encoder.known) + len(encoder.old) < 400
