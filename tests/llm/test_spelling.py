"""Spelling variants against comparing all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kilnflow.llm import spelling


def plain_counts(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    """By all single edits of the longer word, not by the operator's comparison."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(n):
    by_rest = {}
    for w in n:  # words an edit apart share the word without some code point, or are it
        for i in range(len(w)):
            by_rest.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        by_rest.setdefault(w, set()).add(w)
    others = {w: set() for w in n}
    for ws in by_rest.values():
        for a in ws:
            others[a] |= {b for b in ws if b not in others[a] and near(a, b)}
    form = {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(rows, key=lambda r: r[0])


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_whole_table_and_odd_rows(all_docs):
    want = plain(plain_counts([(r.doc_id, r.text) for r in all_docs.collect()]))
    assert rows(spelling.variants(all_docs)) == want and sum(r[1] is not None for r in want) > 10


def test_words_of_all_documents_at_a_lower_bound(spark, documents):
    docs = documents.filter("length(text) < 3000").limit(40)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == plain_counts(texts)


def test_pairs_in_slices_and_of_dense_words(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(600)} | {"aaaaa", "aaaaaa", "aaaaaaa", "ÿÀ×÷ß", "ÿÀ×÷"})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    for block in (3, 50, spelling.BLOCK):
        got = [tuple(r) for r in spelling.near_pairs(table, block).collect()]
        assert len(got) == len(set(got)) and set(got) == {(min(p), max(p)) for p in want}


def test_roots_follow_long_ways(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(70)] + [("x", "w70"), ("y", "x")]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w70" for w, _ in chain}


def test_ties_forms_and_empty_tables(spark, no_docs):
    texts = [(1, "baker " * 4 + "maker " * 4 + "laker " * 3 + "taker " * 8), (None, None), (2, ""), (2, "bakér " * 3 + "tāker tak"), (3, "taker " * 8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select("*", F.lit(1).alias("word"), F.lit(2).alias("n"))
    assert rows(spelling.variants(docs)) == plain(plain_counts(texts))
    assert spelling.variants(no_docs).count() == 0
    assert spelling.variants(docs.filter("text = ''")).count() == 0
