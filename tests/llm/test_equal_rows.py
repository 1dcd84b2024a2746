"""The mix of sources that consist of equal rows, and of equal rows beside others."""

from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from kilnflow.llm import mixing


def rows(*groups):
    return [r for g in groups for r in g]


CASES = {
    "equal beside unlike": rows([(1, "four words are here", "b")] * 400, [(1000 + i, f"a text of {'word ' * (i % 5)}{i}", "a") for i in range(300)]),
    "only equal": [(1, "four words are here", "a")] * 301,
    "two groups in a source": rows([(1, "one two three", None)] * 100, [(2, "one two three four five", None)] * 77, [(3, "x y", "z")] * 50),
    "empty ones": rows([(1, "", "a")] * 60, [(2, "w", "b")] * 41, [(None, None, "b")] * 9),
}


@pytest.mark.parametrize("docs", CASES.values(), ids=CASES)
def test_targets_are_met_within_a_document(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(table.repartition(5)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in docs)
    taken, largest, sizes = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        sizes[r.source] += r["size"]
        assert r.taken <= 2 * r["size"]
    for source, target in brute.targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= largest[source]
    assert sorted(map(str, mixing.mix(table).collect())) == sorted(map(str, got))
    out = mixing.apply_mix(table.select("*", F.lit(1).alias("first_"), F.lit(2).alias("spread_")))
    count = lambda rs: Counter((r.doc_id, r.text, r.source) for r in rs)
    want = Counter()
    texts = {(i, s): t for i, t, s in docs}
    for r in got:
        want[r.doc_id, texts[r.doc_id, r.source], r.source] += r.copies
    assert count(out.collect()) == +want
