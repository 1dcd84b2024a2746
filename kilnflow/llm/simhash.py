"""Operator 5: SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kilnflow.llm.common import cut
from kilnflow.llm.graph import components

BITS, SEED = 64, 42
#: Words hashed at a time, so that the longest text needs little memory beside its words.
BLOCK = 1 << 16
#: A bucket with more fingerprints is split by the masks of the next family before its pairs are compared.
PAIRWISE = 128
#: So many families by radius. After three, the masks of radius 2 leave 8 bits free at most, so a bucket has 256 fingerprints at most.
FAMILIES = {2: 3, 4: 4}


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 hashes have each bit, least significant first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash, as an unsigned number, of a UTF-8 text's word shingles; 0 without words."""
    words = (text or b"").lower().split()  # for bytes both know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        line, ends = b" ".join(part), [x - 1 for x in accumulate(len(w) + 1 for w in part)]
        starts = [0, *[x + 1 for x in ends]]
        counts += bit_counts(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :] or ends[-1:])], dtype=np.uint64))
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, key_, fp): the hash of the text and its fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "key_", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key_"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key_ long, fp long")


def covering_masks(radius: int, family: int = 0) -> list[int]:
    """2 ** (radius + 1) - 1 masks: for any set of at most ``radius`` bits, some mask has none of them.

    Bit i gets the vector (p(i) mod (2 ** (radius + 1) - 1)) + 1 of radius + 1
    bits; mask v has the bits whose vector has an odd overlap with v. Fewer
    vectors than dimensions always leave some v that is even on all of them.
    p is the order of the bits, another one for each family.
    """
    vectors = (1 << (radius + 1)) - 1
    place = lambda i: i * (1, 9, 60, 23)[family] % 67 // (5 if family and radius == 2 else 1)
    return [sum(1 << i for i in range(BITS) if ((place(i) % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def links(fps: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b): all pairs of the fingerprints (distinct longs ``fp``) within ``radius`` bits, a < b, some of them repeated.

    Pairs within a covering table's bucket are compared in place. The
    fingerprints of a bucket of more than ``pairwise`` are dealt again, by the
    masks of the next family together with the first: those keep together
    every pair within the radius, too, and each family leaves fewer bits free.
    """
    if radius not in FAMILIES:
        raise ValueError("radius must be 2 or 4")
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    pair = lambda xs: F.flatten(F.transform(xs, lambda a: F.transform(F.filter(xs, lambda b: (b > a) & near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    dealt = fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("cell"))
    out: DataFrame | None = None
    for family in range(FAMILIES[radius]):
        masks = covering_masks(radius, family)
        cells = F.array(*[F.struct((F.col("path") * len(masks) + t).alias("path"), F.col("cell").bitwiseOR(F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("cell")) for t, m in enumerate(masks)])
        placed = dealt.select("fp", F.explode(cells).alias("x")).select("fp", "x.*")
        sizes = placed.groupBy(F.col("path").alias("path_"), F.col("cell").alias("cell_")).agg(F.count("*").alias("n")).filter("n > 1")
        shared = cut(placed.join(sizes, (F.col("path") == F.col("path_")) & (F.col("cell") == F.col("cell_"))).select("fp", "path", "cell", "n"), "simhash-cells")
        last = family == FAMILIES[radius] - 1
        few = shared if last else shared.filter(F.col("n") <= pairwise)
        found = few.groupBy("path", "cell").agg(F.collect_list("fp").alias("fps")).select(F.explode(pair(F.col("fps"))).alias("e")).select("e.*")
        out = found if out is None else out.unionByName(found)
        dealt = shared.filter(F.col("n") > pairwise).select("fp", "path", "cell")
        if last or dealt.isEmpty():
            break
    assert out is not None
    return out


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Per row of ``docs``: doc_id, key_, fp, fingerprint (16 hex digits), component_id (the least doc_id reachable) and root (the component's own fingerprint).

    Null texts are empty; texts without words have fingerprint 0 and link like
    any other. Rows with a null doc_id take part; component_id is null only
    where all reachable ids are. Components whose least ids are null or alike
    have one component_id, but roots of their own. Repeated rows are one group. An empty table
    gives an empty result. Other columns are not kept.
    """
    rows = cut(fingerprints(docs, width), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius, pairwise))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed, "simhash-nodes")
    ids = placed.groupBy(F.col("root").alias("root_")).agg(F.min("least").alias("component_id"))
    named = placed.join(ids, F.col("root") == F.col("root_")).select(F.col("fp").alias("fp_"), "component_id", "root")
    return rows.join(named, F.col("fp") == F.col("fp_")).select("doc_id", "key_", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def dedup(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates, the one with the least doc_id (nulls last, then text hash), with its own columns whatever their names.

    Of repeated rows one stays; an empty table gives an empty result.
    """
    groups = near_duplicates(docs, width, radius)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key_")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias("kept_id_"), F.col("x.key_").alias("kept_key_"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    rows = docs.select(own, F.col("doc_id").cast("long").alias("id_"), F.xxhash64("text").alias("key_"))
    return rows.join(kept, F.col("id_").eqNullSafe(F.col("kept_id_")) & (F.col("key_") == F.col("kept_key_")), "left_semi").dropDuplicates(["id_", "key_"]).select("row_.*")
