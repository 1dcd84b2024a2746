"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kilnflow.llm.common import cut


def remainder(mod: int) -> Column:
    """crc32 of doc_id as text, mod ``mod``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


#: The most bytes of texts that a classifier is fitted on.
MOST_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, per_class: tuple[int, int], most_bytes: int = MOST_BYTES) -> tuple[list[bytes], np.ndarray, float]:
    """Whole texts and labels (0 or 1) of at most ``per_class[y]`` documents of class y that aren't held out, the same ones in every run.

    The bounds are on rows: documents are taken in the order of a hash of the
    id until their class has enough, and one that would bring the texts beyond
    ``most_bytes`` in all is passed over. Labels that are null or neither 0 nor
    1 and ids with conflicting labels are left out; of repeated rows one is
    taken. Also returns the log of how much rarer class 1 is, against class 0,
    among all usable labels than in the sample.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & (remainder(mod) != held_out)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).filter("y = z")
    # A few more ids than needed, for ids without a document.
    chosen = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[y] + per_class[y] // 4).select(F.col("doc_id").alias("id_"), "y") for y in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # at most 1.25 times the sum of per_class
    texts = docs.filter(remainder(mod) != held_out).join(few, F.col("doc_id") == F.col("id_")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts = cut(texts.select("doc_id", "y", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")), "labelled")
    sizes = sorted(texts.select("doc_id", "y", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect(), key=lambda r: r.doc_id)
    taken: dict[int, int] = {0: 0, 1: 0}
    room, picked = most_bytes, []
    for i in np.random.default_rng(0).permutation(len(sizes)):
        r = sizes[i]
        if taken[r.y] < per_class[r.y] and r.n <= room:
            taken[r.y] += 1
            room -= r.n
            picked.append(r.doc_id)
    rows = {r.doc_id: r for r in texts.filter(F.col("doc_id").isin(picked)).collect()} if picked else {}
    all_labels = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    rarer = np.log(all_labels[1] / all_labels[0] * taken[0] / taken[1]) if taken[0] and taken[1] else 0.0
    return [bytes(rows[i].text) for i in picked], np.array([rows[i].y for i in picked], np.float32), float(rarer)
