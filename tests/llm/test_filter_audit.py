"""The filter audit against a plain walk of every order, over a whole table and odd rows."""

import re
from collections import Counter
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from kilnflow.llm import filter_audit
from kilnflow.llm.queries import AUDIT_SQL

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = {x for x, y in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)), ("D", re.search(r"[#$%&*|]", t)), ("E", i is not None and i > first[t])) if y}
        failed.append((lang or "", s, i in good, i in toxic))
    rows, shapley = [], Counter()
    for part in {f[0] for f in failed}:
        for order in permutations("ABCDE"):
            left = [f for f in failed if f[0] == part]
            for step, x in enumerate(order, 1):
                out = [f for f in left if x in f[1]]
                mine = [f[1] for f in failed if f[0] == part and x in f[1]]
                left = [f for f in left if x not in f[1]]
                rows.append((part, "".join(order), step, len(left), len(out), len(mine) - len(out), sum(s == {x} for s in mine), sum(f[2] for f in out), sum(f[3] for f in out)))
                shapley[part, x] += len(out)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def got(docs, labels):
    return sorted(tuple(r) for r in filter_audit.audit(filter_audit.flags(docs), labels).select(*NAMES).collect())


def test_whole_table_and_odd_rows(spark, sf_dir, all_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    odd = spark.createDataFrame([(900005, 1, 0), (900005, 0, 1), (900005, None, None), (900006, 7, -1), (None, 1, 1), (123456789, 1, 1), (900013, None, 1)], "doc_id long, quality int, toxic int")
    labels = labels.select(*[F.col(c).cast("long") for c in labels.columns]).unionByName(odd.select(*[F.col(c).cast("long") for c in odd.columns]))
    docs = [(r.doc_id, r.text, r.lang) for r in all_docs.collect()]
    assert got(all_docs, labels) == plain(docs, [tuple(r) for r in labels.collect()])


def test_clashing_columns_and_empty_tables(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(900011, 1, 0, 5)], "doc_id long, quality int, toxic int, copies int")
    docs = edge_docs.select("*", *[F.lit("x").alias(n) for n in ("id_", "h1", "h2", "part", "copies", "n_words", "word", "first", "good", "m", "n", "A", "E", "step", "bit")])
    assert got(docs, labels) == plain([(r.doc_id, r.text, r.lang) for r in edge_docs.collect()], [(900011, 1, 0)])
    assert got(no_docs, labels) == [] and len(got(edge_docs, labels.limit(0))) == 600 * edge_docs.select(F.coalesce("lang", F.lit(""))).distinct().count()


def test_sql_computes_the_same(sf_dir, spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({AUDIT_SQL})").fetchall())
    assert got(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")) == want
