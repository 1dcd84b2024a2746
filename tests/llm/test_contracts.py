"""Each operator against its plain version, over a whole table and over rows of every odd kind."""

from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnflow.llm import chat, decontaminate, line_dedup, mixing, quality_model, quality_rules, secrets, simhash, token_files, toxicity
from kilnflow.llm.queries import CHAT_SQL
from kilnflow.llm.tokenizer_path import default_tokenizer


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_mixing(all_docs):
    rows = mixing.mix(all_docs).collect()
    docs = all_docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += len(brute.words(d.text))
    target = brute.targets(dict(sizes))
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == Counter((d.doc_id, d.source, len(brute.words(d.text))) for d in docs)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(all_docs.repartition(5)).collect()))


def test_mixing_is_nested_and_follows_the_budget(all_docs):
    small = {(r.doc_id, r["size"]): r.copies for r in mixing.mix(all_docs, share=0.3).collect()}
    large = {(r.doc_id, r["size"]): r.copies for r in mixing.mix(all_docs, share=0.6).collect()}
    assert all(large[k] >= v for k, v in small.items()) and sum(large.values()) > sum(small.values())


def test_apply_mix_repeats_rows(edge_docs):
    plan = mixing.mix(edge_docs).collect()
    assert mixing.apply_mix(edge_docs).columns == edge_docs.columns
    assert mixing.apply_mix(edge_docs).count() == sum(r.copies for r in plan)


def test_secrets(all_docs):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.summarise(secrets.scan(all_docs)).collect())
    assert got == Counter((i, *brute.secrets(t)) for i, t in pairs(all_docs))


def test_entropy_spans_and_allow_list(spark):
    texts = ["key z9Q8w7E6r5T4y3U2i1O0pLkJhGf end", "https/some/path/of-words/2024/01/02/page", "a-very-long-name-of-many-words-here", "550e8400-e29b-41d4-a716-446655440000", "abababababababababababab12", "é 4f9a1c77e2b08d63f5a9 é"]
    rows = secrets.summarise(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["entropy:4:31", "", "", "", "", "entropy:2:22"]
    assert "[secret]" in secrets.redact(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).first().text


def test_max_entropy_is_the_largest_window(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdef0123456789"[: rng.integers(2, 16)]), rng.integers(20, 60))) for _ in range(20)]

    def plain(t):
        ent = lambda w: -sum(c / 20 * np.log2(c / 20) for c in Counter(w).values())
        return max(ent(t[i : i + 20]) for i in range(len(t) - 19))

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.max_entropy(F.col("t")).alias("e")).collect()
    assert all(r.e == pytest.approx(plain(r.t)) for r in got)


def test_quality_rules(all_docs):
    rows = quality_rules.judge(all_docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((i, *brute.quality(t)) for i, t in pairs(all_docs))
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_rules_keep_clean_prose(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules.judge(documents).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r.kept for r in judged if r.quality == 1)
    assert sum(not r.kept for r in judged if r.quality == 0) >= sum(r.quality == 0 for r in judged) / 3


def test_js_distance(spark):
    df = spark.createDataFrame([([1, 0], [0, 3]), ([1, 1], [2, 2]), ([0, 0], [1, 1])], "p array<long>, q array<long>")
    got = [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(0.0) and got[2] is None


def test_chat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = Counter((r.conv_id, r.n_turns, r.n_same, r.chat) for r in chat.format_chats(turns).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert got == Counter(con.execute(CHAT_SQL).fetchall())


def test_chat_snapshots(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 1, "user", "b"), (None, 0, None, None), (5, 0, "user", ""), (6, 0, "user", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chat string, place int")
    got = {r.conv_id: (r.n_turns, r.n_same, r.chat) for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, None, 5, 6} and got[2][:2] == (2, 2)
    assert got[None][2] == "<|unknown|>\n\n<|end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_simhash(all_docs):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(all_docs).collect())
    assert got == brute.near_duplicates(pairs(all_docs))


def test_simhash_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = {b ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(150)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute.components(fps)
    for pairwise in (4, 1000):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, pairwise=pairwise)).collect()}
        groups, plain = defaultdict(set), defaultdict(set)
        for f in fps:
            groups[roots.get(f, f)].add(f)
            plain[want[f]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_covering_masks_cover():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))


def test_dedup_keeps_one_of_each(all_docs):
    kept = simhash.dedup(all_docs)
    assert kept.columns == all_docs.columns
    rows = pairs(kept)
    groups = brute.near_duplicates(pairs(all_docs))
    assert len(rows) == len({k[2] for k in groups})
    assert {i for i, _ in rows} == {k[2] for k in groups}


def test_line_dedup(all_docs):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(all_docs, digest=True).collect())
    assert got == brute.dedup_lines(pairs(all_docs))


def test_line_dedup_hot_line_over_partitions(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('the very same line for everyone\\nown line of document ', id, '\\nThe very same line for everyone ') as text")
    rows = line_dedup.dedup_lines(docs).collect()
    assert sum(r.n_dropped for r in rows) == 2 * 2999
    assert [r.n_dropped for r in rows if r.doc_id == 2999] == [0]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_settle_does_not_depend_on_batches(size):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = sorted({(int(rng.integers(0, 12)), -int(rng.integers(0, 9)), int(rng.integers(0, 3))) for _ in range(300)})
    cols = [pa.array([r[0] for r in rows], pa.int64())] * 2 + [pa.array([-r[1] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
    table = pa.table(cols, names=["h1", "h2", "doc", "key_", "pos"])
    out = pa.Table.from_batches(list(line_dedup.settle(iter(table.to_batches(max_chunksize=size)))), schema=line_dedup._OUT).to_pylist()
    edge = {rows[0][0], rows[-1][0]}
    docs = defaultdict(set)
    for h, d, _ in rows:
        docs[h].add(-d)
    want = {(-d, p, h) for h, d, p in rows if h not in edge and len(docs[h]) >= 3 and -d != max(docs[h])}
    drops = Counter((r["doc"], r["pos"]) for r in out if r["status"] == line_dedup.DROP)
    last = {(-d, p, h) for h, d, p in rows if h == rows[-1][0] and h != rows[0][0] and len(docs[h]) >= 3 and -d != max(docs[h])}
    assert drops == Counter((d, p) for d, p, _ in want | last)
    assert {r["h1"]: r["n_docs"] for r in out if r["status"] == line_dedup.SUMMARY} == {h: len(docs[h]) for h in edge}


def test_decontamination(all_docs, benchmark_items):
    items = [(r.item_id, r.text) for r in benchmark_items.collect()]
    planted = all_docs.limit(5).withColumn("text", F.concat(F.lit("Some words before, "), F.lit(items[0][1].upper()), F.lit(" and after."))).withColumn("doc_id", F.col("doc_id") + 5_000_000)
    docs = all_docs.unionByName(planted)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, benchmark_items).collect()}
    want = brute.leaks(pairs(docs), items)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    clean = decontaminate.drop_leaks(docs, benchmark_items)
    assert clean.count() == sum(i not in {k[0] for k in want} for i, _ in pairs(docs))


def test_decontamination_odd_items(spark, edge_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "One two"), (4, "quick brown fox of words the"), (4, "quick brown fox of words the"), (None, "one two three one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(edge_docs, items).collect()}
    assert got == {(900005, 3), (900006, 3), (900006, None), (900012, 4)}


def test_token_files(spark, all_docs, tmp_path):
    from tokenizers import Tokenizer

    token_files.write_blocks(all_docs, default_tokenizer(), str(tmp_path / "t"))
    rows = sorted(token_files.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter(brute.token_rows(pairs(all_docs), Tokenizer.from_file(default_tokenizer())))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


@pytest.mark.parametrize("n", [0, 1, 511, 513, 70_001])
def test_rans_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 999).astype(np.uint32)
    table = token_files.Table.of(np.bincount(ids, minlength=1000))
    payload = token_files.encode(ids, table)
    assert (token_files.decode(payload, table) == ids).all()
    lanes, marks = (int(x) for x in np.frombuffer(payload, "<u4", 4)[[1, 3]])
    for k in range(1, marks + 1):
        assert (token_files.decode(payload, table, k) == ids[k * token_files.CHECKPOINT * lanes :]).all()


def test_encoder_equals_the_library():
    from hypothesis import given, settings, strategies as st
    from tokenizers import Tokenizer

    encoder, plain = token_files.Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.one_of(st.sampled_from(list(" \n\t\r\x0b\x1c\x85  .,'!?;:aé9漢🙂_s")), st.characters(exclude_categories=["Cs"])), max_size=30))
    def check(text):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    check()


def test_classifiers_on_odd_rows_and_no_labels(spark, edge_docs):
    labels = spark.createDataFrame([(900006, 1, 0), (900012, 0, 1), (900012, 0, 1), (None, 1, 1), (900004, None, None)], "doc_id long, quality int, toxic int")
    for model in (quality_model, toxicity):
        for known in (labels, labels.limit(0)):
            rows = model.score(edge_docs, known).collect()
            assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_everything_on_empty_tables(spark, no_docs, benchmark_items):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(no_docs).count() == 0 and mixing.apply_mix(no_docs).count() == 0
    assert secrets.scan(no_docs).count() == 0 and quality_rules.judge(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.dedup(no_docs).count() == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert decontaminate.matches(no_docs, benchmark_items).count() == 0
    assert decontaminate.drop_leaks(no_docs, benchmark_items).count() == 0
    assert quality_model.score(no_docs, labels).count() == 0 and toxicity.score(no_docs, labels).count() == 0


def test_empty_token_files(spark, no_docs, tmp_path):
    token_files.write_blocks(no_docs, default_tokenizer(), str(tmp_path / "t"))
    assert token_files.read_documents(spark, str(tmp_path / "t")).count() == 0
