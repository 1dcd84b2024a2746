"""Pieces that recur in the texts at hand are looked up once, and the library gets a bounded number of characters at a time."""

import random

import numpy as np

from kilnflow.llm import token_files
from kilnflow.llm.tokenizer_path import default_tokenizer


class Counted(dict):
    gets = 0

    def get(self, *args):
        self.gets += 1
        return super().get(*args)


def test_a_piece_is_looked_up_once():
    encoder = token_files.Encoder(default_tokenizer())
    texts = [" ".join(["some", "words", "that", "recur,"] * 500), "", "words that\nrecur"]
    encoder.known = Counted()
    first = encoder.encode(texts)
    encoder.known.gets = 0
    assert encoder.encode(texts) == first == token_files.Encoder(default_tokenizer()).encode(texts)
    assert encoder.known.gets < 30  # of 2,500 pieces


def test_distinct_pieces():
    words, which = token_files.distinct(np.frombuffer("b ß  b ß c ".encode(), np.uint8))
    assert words == ["b", "ß", "", "c"] and which.tolist() == [0, 1, 2, 0, 1, 3]


def test_whole_texts_go_to_the_library_a_slab_at_a_time(monkeypatch):
    monkeypatch.setattr(token_files, "_SLAB", 100)
    encoder, some = token_files.Encoder(default_tokenizer()), random.Random(1)
    texts = ["".join(some.choices(["a  b", "\x01", " \n", "é. "], k=some.randint(0, 30))) for _ in range(200)]
    expected, sizes, library = [e.ids for e in encoder.encode_all(texts, add_special_tokens=False)], [], encoder.encode_all

    def seen(held, **kw):
        sizes.append(sum(map(len, held)) - len(held[-1]))
        return library(held, **kw)

    encoder.encode_all = seen
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == expected
    assert max(sizes) < 100
