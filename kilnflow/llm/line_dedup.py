"""Operator 9: line dedup over range-partitioned hashes in a secondary sort.

Rows of (line hash, document, position) are range-partitioned and sorted; each
task streams its rows once and knows a line's first document and number of
documents when the hash changes. Hashes cut by a partition's edge are settled
from one summary row per edge. What goes back to the documents is a compressed
bitmap of the lines to keep.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kilnflow.llm.common import cut, partitions

NO_ID = -(1 << 63)
DROP, EDGE, SUMMARY = 1, 2, 3
_OUT = pa.schema([("status", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("key_", pa.int64()), ("pos", pa.int64()), ("n_docs", pa.int64())])
_OUT_SQL = "status int, h1 long, h2 long, doc long, key_ long, pos long, n_docs long"


def line_key(line: bytes, min_chars: int = 20) -> bytes | None:
    """The 128-bit hash of a line's key: without white space at its ends, A-Z in lower case; None if it is short."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc, key_, pos) of each line whose key is long enough; doc is NO_ID for a null doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at, pos = [], [], []
            for i, text in enumerate(b.column(2)):
                for j, line in enumerate((text.as_py() or b"").split(b"\n")):
                    if key := line_key(line, min_chars):
                        found.append(key), at.append(i), pos.append(j)
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), b.column(0).take(rows), b.column(1).take(rows), pa.array(pos, pa.int64())], ["h1", "h2", "doc", "key_", "pos"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key_"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "h1 long, h2 long, doc long, key_ long, pos long")


def _rows(status: int, h: tuple[int, int], doc: np.ndarray, key: np.ndarray, pos: np.ndarray, n_docs: int = 0) -> pa.RecordBatch:
    full = lambda x, t: pa.array(np.full(len(doc), x, t))
    return pa.RecordBatch.from_arrays([full(status, np.int32), full(h[0], np.int64), full(h[1], np.int64), pa.array(doc), pa.array(key), pa.array(pos), full(n_docs, np.int64)], schema=_OUT)


class _Run:
    """The open run of rows with one hash. Rows held back are those of its second document, at most."""

    def __init__(self, h: tuple[int, int], edge: bool, min_docs: int) -> None:
        self.h, self.edge, self.min_docs = h, edge, min_docs
        self.top, self.last, self.n = None, None, 0
        self.held: list[tuple[np.ndarray, ...]] = []

    def extend(self, doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.top = int(doc[0]) if self.top is None else self.top
        self.n += int(self.last != int(doc[0])) + int((doc[1:] != doc[:-1]).sum())
        self.last = int(doc[-1])
        if self.edge:
            yield _rows(EDGE, self.h, doc, key, pos)
            return
        if (later := doc != self.top).any():
            self.held.append((doc[later], key[later], pos[later]))
        if self.n >= self.min_docs:
            for rows in self.held:
                yield _rows(DROP, self.h, *rows)
            self.held = []

    def close(self, at_end: bool) -> Iterator[pa.RecordBatch]:
        if self.edge or at_end:
            for rows in self.held:
                yield _rows(EDGE, self.h, *rows)
            one = np.array([self.top], np.int64)
            yield _rows(SUMMARY, self.h, one, one * 0, one * 0, self.n)


def settle(batches: Iterator[pa.RecordBatch], min_docs: int = 3) -> Iterator[pa.RecordBatch]:
    """Stream one partition's rows, sorted by hash and then documents from the largest id down.

    DROP rows are decided; EDGE rows belong to the partition's first hash, or
    to its last where that is still open; a SUMMARY row for each of these two
    holds its largest document and number of documents here.
    """
    run: _Run | None = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, key, pos = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = run is None or run.h != (int(h1[0]), int(h2[0]))
        starts = np.flatnonzero(new)
        head = int(starts[0]) if len(starts) else len(h1)
        if head:
            yield from run.extend(doc[:head], key[:head], pos[:head])
        if not len(starts):
            continue
        begin = 0
        if run is None:
            run = _Run((int(h1[0]), int(h2[0])), True, min_docs)
            end = int(starts[1]) if len(starts) > 1 else len(h1)
            yield from run.extend(doc[:end], key[:end], pos[:end])
            begin = 1
        if len(starts) > begin:
            yield from run.close(False)
            a, z = int(starts[begin]), int(starts[-1])
            if z > a:
                at = starts[begin:-1] - a
                d = doc[a:z]
                other = np.ones(z - a, bool)
                other[1:] = d[1:] != d[:-1]
                other[at] = True
                lengths = np.diff(np.append(at, z - a))
                drop = (np.repeat(np.add.reduceat(other.astype(np.int64), at), lengths) >= min_docs) & (d != np.repeat(d[at], lengths))
                if drop.any():
                    yield _rows(DROP, (0, 0), d[drop], key[a:z][drop], pos[a:z][drop])
            run = _Run((int(h1[z]), int(h2[z])), False, min_docs)
            yield from run.extend(doc[z:], key[z:], pos[z:])
    if run is not None:
        yield from run.close(True)


def pack(drops: np.ndarray) -> bytes:
    """A compressed bitmap of the lines to keep; lines beyond its end are kept."""
    keep = np.ones(int(drops.max()) // 8 * 8 + 8, np.uint8)  # whole bytes, so that padding keeps
    keep[drops] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, key_, bitmap) of the documents that lose lines."""
    spark = docs.sparkSession
    hashes = cut(line_hashes(docs, min_chars), "line-hashes")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    # A hash with very many rows spreads over partitions by document; equal (hash, document) rows stay together.
    ranged = hashes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "key_", "pos")
    settled = cut(ranged.mapInArrow(lambda batches: settle(batches, min_docs), _OUT_SQL), "line-settled")
    # At most two summary rows a partition; written, so that Spark decides by their stored size.
    edges = settled.filter(F.col("status") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), F.max("doc").alias("top")).filter(F.col("all_docs") >= min_docs)
    edges = cut(edges, "line-edges")
    undecided = settled.filter(F.col("status") == EDGE).select("h1", "h2", "doc", "key_", "pos").join(edges, ["h1", "h2"]).filter("doc <> top")
    drops = settled.filter(F.col("status") == DROP).select("doc", "key_", "pos").unionByName(undecided.select("doc", "key_", "pos"))
    places = drops.groupBy("doc", "key_").agg(F.collect_set("pos").alias("drops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = pa.array([pack(np.asarray(x.as_py(), np.int64)) for x in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), maps], ["doc", "key_", "bitmap"])

    return places.mapInArrow(run, "doc long, key_ long, bitmap binary")


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    # Bitmaps are written first: while they are small, Spark sends them to the texts, which then stay where they are.
    maps = cut(keep_bitmaps(docs, min_chars, min_docs), "line-bitmaps").withColumnsRenamed({"doc": "map_doc_", "key_": "map_key_"})
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_"), F.xxhash64("text").alias("key_"))
    return rows.join(maps, (F.col("doc_") == F.col("map_doc_")) & (F.col("key_") == F.col("map_key_")), "left")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped and the text of the kept lines (or its kept_sha256 with ``digest``).

    A line key found in ``min_docs`` documents or more stays only in the one
    with the largest doc_id, there with all its lines. A null or empty text is
    one empty line. Rows with a null doc_id count as one document below all
    others; rows that share a doc_id are one document. Other columns are not
    kept; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, dropped, kept = [], [], []
            for text, bitmap in zip(b.column(1), b.column(2)):
                data, packed = text.as_py() or b"", bitmap.as_py()
                n = data.count(b"\n") + 1
                if packed is not None:
                    keep = unpack(packed, n)
                    data = b"\n".join(x for x, k in zip(data.split(b"\n"), keep) if k)
                    dropped.append(int(n - keep.sum()))
                else:
                    dropped.append(0)
                total.append(n)
                kept.append(hashlib.sha256(data).hexdigest() if digest else data.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "out"])

    kind = dict(docs.dtypes)["doc_id"]
    done = _with_bitmaps(docs, min_chars, min_docs).select("doc_id", "text", "bitmap").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, out string")
    return done.withColumnRenamed("out", "kept_sha256" if digest else "text")
