"""Documents that are a benchmark item less some words."""

from pyspark.sql import functions as F
import pytest

import brute
from kilnflow.llm import decontaminate


def whole_document_leaks(rows, items, similarity=0.8):
    """For documents of fewer words than the item, which brute.leaks leaves out."""
    import re
    from collections import Counter

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    out = {}
    for doc, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        for item, it in items:
            x = re.findall(r"\w+", (it or "").lower())
            if w and len(w) < len(x):
                a, b = grams(x), grams(w)
                shared = sum((a & b).values())
                if (s := shared / (sum(a.values()) + sum(b.values()) - shared)) >= similarity:
                    out[doc, item] = max(s, out.get((doc, item), 0))
    return out


def test_documents_shorter_than_an_item(spark, all_docs, benchmark_items):
    items = [(r.item_id, r.text) for r in benchmark_items.collect()]
    planted = []
    for k, (_, text) in enumerate(items[:6]):
        w = text.split()
        planted += [(6_000_000 + 10 * k, " ".join(w[:-1])), (6_000_001 + 10 * k, " ".join(w[3:])), (6_000_002 + 10 * k, " ".join(["other", *w[2:-2]])), (6_000_003 + 10 * k, " ".join(w[: len(w) // 2])), (6_000_004 + 10 * k, text)]
    docs = all_docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    short = whole_document_leaks(rows, items)
    assert sum(i >= 6_000_000 and i % 10 == 0 for i, _ in short) >= 6 and not any(i and i >= 6_000_000 and i % 10 == 3 for i, _ in short)
    want = brute.leaks(rows, items) | short
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, benchmark_items).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert decontaminate.drop_leaks(docs, benchmark_items).filter(F.col("doc_id") == 6_000_000).isEmpty()
