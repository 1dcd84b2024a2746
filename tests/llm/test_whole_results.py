"""Verdicts, indexes, files and callers' columns held against plain versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pipeline import good

from kilnflow.llm import decontaminate, mixing, quality_rules, simhash, token_files
from kilnflow.llm.tokenizer_path import default_tokenizer

#: Names that the operators use inside.
NAMES = ("row_", "id_", "key_", "fp", "h", "copies_", "whole", "cut_at", "kept_id_", "kept_key_", "good_id_", "good_key_", "leak_id_", "leak_key_", "row_id_", "row_key_", "path", "cell", "content", "size", "root", "lines", "w")


def test_verdicts_of_the_quality_rules(all_docs):
    kept = quality_rules.judge(all_docs).filter("kept").select("doc_id").collect()
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in good(all_docs.collect()))


def test_columns_of_the_caller_stay(edge_docs, benchmark_items):
    docs = edge_docs.select("doc_id", "text", "lang", "source", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    for out in (quality_rules.keep_good(docs), simhash.dedup(docs), decontaminate.drop_leaks(docs, benchmark_items), mixing.apply_mix(docs)):
        assert out.columns == docs.columns
        assert out.select(*NAMES).distinct().collect() in ([tuple(range(len(NAMES)))], [])
    assert simhash.dedup(docs).count() and decontaminate.drop_leaks(docs, benchmark_items).count()


def test_index_finds_every_pair_within_the_radius_once(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 62), 1 << 62, 40).tolist()
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False))
    items = [(5 + i % 3, x) for i, x in enumerate(base)]
    windows = [(s, flip(x, int(n))) for s, x in items for n in rng.integers(0, 24, 12)] + items
    got = decontaminate.near_pairs(spark.createDataFrame(windows, "size int, fp long").distinct(), spark.createDataFrame(items, "item_size int, item_fp long")).collect()
    want = {(s, a, b) for s, a in windows for t, b in items if s == t and ((a ^ b) & (1 << 64) - 1).bit_count() <= decontaminate.RADIUS}
    assert len(got) == len(want) and {(r["size"], r.fp, r.item_fp) for r in got} == want


def test_benchmark_in_slices(all_docs, benchmark_items):
    docs = all_docs.select("doc_id", "text").unionByName(benchmark_items.select((F.col("item_id") + 8_000_000).alias("doc_id"), F.concat(F.lit("before it "), "text").alias("text")))
    one = {tuple(r) for r in decontaminate.matches(docs, benchmark_items).collect()}
    assert one == {tuple(r) for r in decontaminate.matches(docs, benchmark_items, slice_words=300).collect()} and len(one) >= benchmark_items.count()


def test_buckets_stay_bounded():
    from functools import reduce
    from itertools import product

    families = [simhash.covering_masks(2, f) for f in range(simhash.FAMILIES[2])]
    assert max(64 - reduce(int.__or__, masks).bit_count() for masks in product(*families)) <= 8
    for masks in families:
        assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))


def test_damaged_blocks_are_refused(spark, edge_docs, tmp_path):
    token_files.write_blocks(edge_docs, default_tokenizer(), str(tmp_path / "t"))
    blocks = spark.read.parquet(str(tmp_path / "t" / "blocks"))
    broken = blocks.withColumn("crc32", F.col("crc32").bitwiseXOR(F.lit(1)))
    broken.write.parquet(str(tmp_path / "u" / "blocks"))
    spark.read.parquet(str(tmp_path / "t" / "table")).write.parquet(str(tmp_path / "u" / "table"))
    with pytest.raises(Exception, match="damaged"):
        token_files.read_documents(spark, str(tmp_path / "u")).collect()


def test_long_texts_are_encoded_in_parts():
    from tokenizers import Tokenizer

    text = "Some words, and others'll do.\n  Then 12 more é! " * 200
    parts = token_files.pieces(text, ["<|endoftext|>"], most=500)
    plain = Tokenizer.from_file(default_tokenizer())
    assert len(parts) > 5 and "".join(parts) == text
    assert [i for p in parts for i in plain.encode(p, add_special_tokens=False).ids] == plain.encode(text, add_special_tokens=False).ids


def test_targets_of_many_sources(spark):
    import brute

    rng = np.random.default_rng(4)
    sizes = {f"https://{i}.example": int(n) for i, n in enumerate(rng.integers(0, 5000, 500))} | {None: 300, "": 7}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute.targets(sizes)
    assert len(rows) == len(sizes) and all(r.target == pytest.approx(want[r.source]) for r in rows)
