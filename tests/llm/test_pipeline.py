"""Groups of near-duplicates with null and repeated ids, and the whole pipeline against a brute-force version."""

import unicodedata
from collections import Counter, defaultdict
from math import log2, sqrt

import brute
import corpus_pipeline
import pytest
import xxhash

from kilnflow.llm import mixing, quality_rules, simhash
from kilnflow.llm.tokenizer_path import default_tokenizer


@pytest.fixture(scope="module")
def unnamed(spark, sf_dir, documents):
    """Unlike texts of good quality with null ids or one id, and copies of two."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    good = documents.join(labels, "doc_id").filter("size(split(text, ' ')) between 150 and 1500").orderBy("doc_id").limit(9).collect()
    rows = [(None if k < 5 else 800_001, " ".join(r.text.split()[::-1]), r.lang, r.source, r.n_chars) for k, r in enumerate(good)]
    return spark.createDataFrame([*rows, rows[0], rows[-1]], "doc_id long, text string, lang string, source string, n_chars long").select(*documents.columns)


def key(text):
    if text is None:
        return 42
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def first_of_each(rows):
    fps = {t: brute.fingerprint(t) for t in {r.text for r in rows}}
    root = brute.components(fps.values())
    least = {}
    for r in rows:
        mine = ((r.doc_id is None, r.doc_id or 0, key(r.text)), r)
        g = root[fps[r.text]]
        if g not in least or mine[0] < least[g][0]:
            least[g] = mine
    return [r for _, r in least.values()]


def good(rows):
    """Rows that the quality rules keep, from histograms counted character by character and word by word."""
    width, counts, sums = 12, [], defaultdict(lambda: [Counter(), Counter()])
    for r in rows:
        t = r.text or ""
        kinds = Counter(0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in ".,;:?'\"()-" else 5 if "!" <= c <= "~" else 6 for c in t)
        plain = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()
        listed = quality_rules.COMMON.get(r.lang, ())
        words = Counter(listed.index(w) if w in listed else width for w in plain)
        counts.append((kinds, words))
        sums[r.lang][0].update(kinds)
        sums[r.lang][1].update(words)

    def distance(p, q):
        n, m = sum(p.values()), sum(q.values())
        part = lambda a, b: a * log2(2 * a / (a + b)) if a else 0.0
        return sqrt(max(sum(part(p[k] / n, q[k] / m) + part(q[k] / m, p[k] / n) for k in q) / 2, 0.0))

    out = []
    for r, (kinds, words) in zip(rows, counts):
        far = sum(kinds.values()) >= quality_rules.MIN_CHARS and distance(kinds, sums[r.lang][0]) > quality_rules.MAX_CLASS
        if sum(words.values()) >= quality_rules.MIN_WORDS and r.lang in quality_rules.COMMON:
            reference = sums[r.lang][1]
            far = far or distance(words, reference) > quality_rules.MAX_WORDS_SHARE * distance(Counter({width: 1}), reference)
        if not far and not brute.quality(r.text)[-1]:
            out.append(r)
    return out


def test_dedup_keeps_a_row_of_each_group_whatever_its_ids(all_docs, unnamed):
    docs = all_docs.unionByName(unnamed)
    want = first_of_each(docs.collect())
    assert sum(r.doc_id is None for r in want) >= 6 and sum(r.doc_id == 800_001 for r in want) >= 4
    assert Counter((r.doc_id, r.text) for r in simhash.dedup(docs).collect()) == Counter((r.doc_id, r.text) for r in want)


def test_pipeline_against_brute_force(spark, sf_dir, all_docs, unnamed, benchmark_items, tmp_path):
    from tokenizers import Tokenizer

    all_docs.unionByName(unnamed).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark_items.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = first_of_each(good(spark.read.parquet(str(tmp_path / "documents.parquet")).collect()))
    leaks = {i for i, _ in brute.leaks([(n, r.text) for n, r in enumerate(rows)], [(r.item_id, r.text) for r in benchmark_items.collect()])}
    rows = [r for n, r in enumerate(rows) if n not in leaks]
    assert sum(r.doc_id is None for r in rows) >= 5 and sum(r.doc_id == 800_001 for r in rows) >= 4
    plan = mixing.mix(spark.createDataFrame(rows, all_docs.schema))  # held against brute force on its own
    mixed = mixing.apply_mix(spark.createDataFrame(rows, all_docs.schema)).collect()
    assert len(mixed) == sum(r.copies for r in plan.collect())
    want = brute.token_rows([(r.doc_id, r.text) for r in mixed], Tokenizer.from_file(default_tokenizer()))
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
