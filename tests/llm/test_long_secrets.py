"""All spans of the secret scan by brute force, and runs that are long or many."""

import time
from collections import Counter

import brute
import numpy as np
import pytest

from kilnflow.llm import secrets

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def text(name):
    r = np.random.default_rng(11)
    draw = lambda letters, n: "".join(r.choice(list(letters), n))
    return {
        "hyphens": lambda: "a-" * 100_000 + "1",
        "paths": lambda: "ab/12_" * 50_000,
        "random": lambda: draw(ALNUM, 1_000_000),
        "many": lambda: " ".join(draw(ALNUM, 24) for _ in range(5000)),
        "many hex": lambda: "_".join(draw("0123456789abcdef", 33) for _ in range(3000)),
        "keys": lambda: "".join(f"password={draw(ALNUM, 9)} {draw(ALNUM, 20)}7+{draw(ALNUM, 19)}\n" for _ in range(2000)),
    }[name]()


def test_all_spans(all_docs):
    got = Counter((r.doc_id, r.spans) for r in secrets.summarise(secrets.scan(all_docs)).collect())
    assert got == Counter((r.doc_id, brute.spans(r.text)) for r in all_docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", ["hyphens", "paths", "random", "many", "many hex", "keys"])
def test_long_texts_end_soon(spark, name):
    t = text(name)
    began = time.time()
    row = secrets.summarise(secrets.scan(spark.createDataFrame([(1, t)], "doc_id long, text string"))).first()
    assert time.time() - began < 60
    assert row.spans == brute.spans(t)
    assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256) == brute.secrets(t)


def test_redaction_of_many_spans(spark):
    t = text("keys")
    out = secrets.redact(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().text
    assert out == "[secret] [secret]\n" * 2000
