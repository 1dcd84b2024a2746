"""Operator 10: benchmark decontamination by SimHash of item-sized windows.

Windows as long as a benchmark item are fingerprinted and matched to items by
multi-index Hamming blocks, which find every fingerprint within the radius; an
exact similarity of weighted word shingles decides. A window can only reach
the similarity if nearly all its shingles occur in the benchmark, so windows
with fewer are not fingerprinted; that loses none. A document shorter than an
item is one window, compared with the items that it is long enough to match.
Equal windows are compared once, however many documents hold them.

A benchmark of many words is taken in slices, with a pass over the documents
for each, so that what goes to every task is bounded whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kilnflow.llm.common import cut
from kilnflow.llm.simhash import bit_counts

WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints of windows alike to just SIMILARITY differ in about 10 of 64 bits with a deviation of 3, more alike ones in fewer.
#: Two within RADIUS differ in at most RADIUS // BLOCKS bits of some block; the item tries all but one of them, the window the last.
RADIUS, BLOCKS = 15, 4
#: Words of benchmark items whose shingles go to every task at a time.
SLICE_WORDS = 500_000
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: ASCII marks that are no word characters become spaces.
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
#: ASCII, and the bytes of U+00C0 to U+02AF, which are letters but for two.
_PLAIN = bytes([*range(128), *range(0x80, 0xC0), *range(0xC3, 0xCB)])


def tokens(text: str | None) -> list[bytes]:
    """Words of letters, digits and underscores in lower case, as UTF-8.

    Texts of ASCII and Latin letters, most by far, are split as bytes, others by a pattern; both give the same.
    """
    low = (text or "").lower()
    data = low.encode()
    if not data.translate(None, _PLAIN) and b"\xc3\x97" not in data and b"\xc3\xb7" not in data:
        return data.translate(_SPACED).split()
    return [w.encode() for w in _WORD.findall(low)]


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words (of the whole sequence, if shorter)."""
    n = max(1, len(words) - width + 1) if words else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(n)), np.uint64, n)


def weighted(hashes: np.ndarray) -> np.ndarray:
    """The hashes as a set that keeps weights: the k-th occurrence of a shingle becomes an element of its own."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    starts = np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
    out = np.empty_like(hashes)
    out[order] = ordered + (np.arange(len(hashes)) - starts).astype(np.uint64) * _PRIME
    return out


def simhash(hashes: np.ndarray) -> int:
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@dataclass(frozen=True)
class Benchmark:
    """What a task needs to pick windows: a number for each benchmark word, and the shingles in these numbers, all by shingle width and those of each item size."""

    ids: dict[bytes, int]
    known: dict[int, np.ndarray]
    by_size: dict[int, np.ndarray]
    width: int
    similarity: float

    @staticmethod
    def of(texts: list[str | None], width: int, similarity: float) -> Benchmark:
        words = [w for t in texts if (w := tokens(t))]
        ids = {w: i + 1 for i, w in enumerate(sorted({x for w in words for x in w}))}
        out = Benchmark(ids, {}, {}, width, similarity)
        for w in words:
            out.by_size.setdefault(len(w), []).append(out.rolled(w, min(len(w), width)))  # type: ignore[arg-type]
        for size in sorted(out.by_size):
            out.by_size[size] = np.unique(np.concatenate(out.by_size[size]))
            n = min(size, width)
            out.known[n] = np.union1d(out.known[n], out.by_size[size]) if n in out.known else out.by_size[size]
        return out

    def rolled(self, words: list[bytes], width: int) -> np.ndarray:
        """A number for each run of ``width`` words, from their numbers; unknown words are 0."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.uint64, len(words))
        n = len(ids) - width + 1
        out = np.zeros(max(n, 0), np.uint64)
        for j in range(width if n > 0 else 0):
            out = out * _PRIME + ids[j : j + n]
        return out

    def windows(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, words, size) of the windows that hold enough shingles of items of that size to be similar to one; of fewer words than the size only where they are the whole document."""
        found: list[tuple[int, int, int]] = []
        for width, known in self.known.items():
            rolled = self.rolled(words, width)
            places = np.flatnonzero(known[np.minimum(np.searchsorted(known, rolled), len(known) - 1)] == rolled)
            if not len(places):
                continue
            for size, own in self.by_size.items():
                length = min(size, len(words))
                n, own_n = length - width + 1, size - width + 1
                if min(size, self.width) != width or n < 1 or n < own_n * self.similarity - 1e-9:
                    continue
                need = int(np.ceil((n + own_n) * self.similarity / (1 + self.similarity) - 1e-9))
                hits = places[own[np.minimum(np.searchsorted(own, rolled[places]), len(own) - 1)] == rolled[places]]
                if len(hits) < need:
                    continue
                marks = np.zeros(len(rolled) + 1, np.int64)
                marks[hits + 1] = 1
                sums = np.cumsum(marks)
                found += [(int(i), length, size) for i in np.flatnonzero(sums[n:] - sums[:-n] >= need)]
        return found


def _fingerprinted(words: list[bytes], spots: list[tuple[int, int, int]], width: int) -> list[tuple[int, np.ndarray]]:
    """(fingerprint, weighted shingles) of each (start, words, size); a shingle shared by windows is hashed once."""
    cache: dict[tuple[int, int], int] = {}
    out = []
    for at, length, size in spots:
        w = min(size, width)
        for i in range(at, at + length - w + 1):
            if (i, w) not in cache:
                cache[i, w] = xxhash.xxh64_intdigest(b" ".join(words[i : i + w]))
        hashes = np.array([cache[i, w] for i in range(at, at + length - w + 1)], np.uint64)
        out.append((simhash(hashes), weighted(hashes)))
    return out


_SQL = "doc_id long, key_ long, at long, size int, fp long, elements array<long>"


def candidate_windows(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """(doc_id, key_, at, size, fp, elements) of the windows worth comparing; ``at`` counts words, ``size`` those of the items to compare with."""
    shared = docs.sparkSession.sparkContext.broadcast(bench)  # of SLICE_WORDS words or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("i", "at", "size", "fp", "elements")}
            for i, text in enumerate(b.column(2)):
                words = tokens(text.as_py())
                spots = shared.value.windows(words)
                for (at, _, size), (fp, elements) in zip(spots, _fingerprinted(words, spots, shared.value.width)):
                    for k, v in zip(rows, (i, at, size, fp, elements.view(np.int64))):
                        rows[k].append(v)
            take = pa.array(rows["i"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(rows["at"], pa.int64()), pa.array(rows["size"], pa.int32()), pa.array(rows["fp"], pa.int64()), pa.array(rows["elements"], pa.list_(pa.int64()))],
                ["doc_id", "key_", "at", "size", "fp", "elements"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key_"), "text").mapInArrow(run, _SQL)


def item_rows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, slice_key, item_size, item_fp, item_elements) of the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, len(w), h) for i, x in enumerate(b.column(2)) if (w := tokens(x.as_py())) for h in [shingles(w, width)]]
            take = pa.array([i for i, _, _ in found], pa.int64())
            cols = [b.column(0).take(take), b.column(1).take(take), pa.array([n for _, n, _ in found], pa.int32()), pa.array([simhash(h) for _, _, h in found], pa.int64()), pa.array([weighted(h).view(np.int64) for _, _, h in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "slice_key", "item_size", "item_fp", "item_elements"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("slice_key"), "text")
    return rows.mapInArrow(run, "item_id long, slice_key long, item_size int, item_fp long, item_elements array<long>")


def _masks(most: int) -> list[int]:
    """All masks of one block with at most so many bits."""
    return [m for m in range(1 << (64 // BLOCKS)) if m.bit_count() <= most]


def _block(fp: str, j: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), j * 64 // BLOCKS).bitwiseAND(F.lit((1 << (64 // BLOCKS)) - 1)).cast("int")


def _cells(df: DataFrame, fp: str, masks: list[int]) -> DataFrame:
    """``df`` with (j, v, m): each block's number and value, changed by each mask."""
    blocks = F.array(*[F.struct(F.lit(j).alias("j"), _block(fp, j).alias("block")) for j in range(BLOCKS)])
    rows = df.select("*", F.explode(blocks).alias("b_")).select(*df.columns, "b_.*")
    return rows.select(*df.columns, "j", "block", F.explode(F.array(*map(F.lit, masks))).alias("m")).select(*df.columns, "j", F.col("block").bitwiseXOR(F.col("m")).alias("v"), "m")


def near_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of ``windows`` (size, fp, ...) and ``items`` (item_size, item_fp, ...) of one size and within RADIUS bits, each once.

    An item stands in a cell for each change of a block by all but one of the
    RADIUS // BLOCKS bits that may differ, a window for each change by one at
    most. A pair counts in its first block that is near enough, and there
    where the window's change is none or, if it needs one, the lowest bit.
    """
    most = RADIUS // BLOCKS
    left = _cells(windows, "fp", _masks(1)).withColumnRenamed("m", "wm")
    right = _cells(items, "item_fp", _masks(most - 1)).drop("m").withColumnsRenamed({"j": "ij", "v": "iv"})
    met = left.join(right, (F.col("size") == F.col("item_size")) & (F.col("j") == F.col("ij")) & (F.col("v") == F.col("iv")))
    apart = lambda j: _block("fp", j).bitwiseXOR(_block("item_fp", j))
    first = F.coalesce(*[F.when(F.bit_count(apart(j)) <= most, F.lit(j)) for j in range(BLOCKS)])
    here = F.coalesce(*[F.when(F.col("j") == j, apart(j)) for j in range(BLOCKS)])
    change = F.when(F.bit_count(here) < most, F.lit(0)).otherwise(here.bitwiseAND(-here))
    kept = met.filter((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & (F.col("j") == first) & (F.col("wm") == change))
    return kept.drop("j", "v", "wm", "ij", "iv")


def found_windows(docs: DataFrame, benchmark: DataFrame, items: DataFrame, width: int, similarity: float, slice_words: int) -> DataFrame:
    """candidate_windows() for the whole benchmark: one written pass over the documents for each slice of about ``slice_words`` words of items."""
    total = items.agg(F.sum("item_size")).first()[0] or 0
    slices = max(1, -(-int(total) // slice_words))
    own = F.pmod(F.xxhash64("text"), F.lit(slices))
    out: DataFrame | None = None
    for k in range(slices):
        texts = [r.text for r in benchmark.filter(own == k).select("text").distinct().collect()]  # one slice's items
        part = cut(candidate_windows(docs, Benchmark.of(texts, width, similarity)), "leak-windows")
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, key_, item_id, similarity, n_windows, first_word): a row for each document row and the item it holds.

    Similarity is the weighted Jaccard index of ``width``-word shingles of the
    best window as long as the item, or of the whole document where it is
    shorter. Words are runs of letters, digits and underscores in lower
    case. Null and empty texts and items match nothing; items of fewer words
    than ``width`` match as a whole. Equal items each match; repeated rows of a
    document count once. Empty tables give an empty result; other columns are
    not kept.
    """
    items = cut(item_rows(benchmark, width), "leak-items")
    found = found_windows(docs, benchmark, items, width, similarity, slice_words).withColumn("content", F.xxhash64("elements"))
    same = ["size", "fp", "content"]
    unlike = cut(found.select(*same, "elements").dropDuplicates(same), "leak-unlike")
    listed = items.select("item_id", "item_size", "item_fp", F.xxhash64("item_elements").alias("item_content"))
    pairs = near_pairs(unlike.select(*same), listed.select("item_size", "item_fp", "item_content").distinct())
    texts = items.groupBy(F.col("item_size").alias("s_"), F.xxhash64("item_elements").alias("c_")).agg(F.any_value("item_elements").alias("item_elements"))
    both = pairs.join(unlike, same).join(texts, (F.col("item_size") == F.col("s_")) & (F.col("item_content") == F.col("c_")))
    shared = F.size(F.array_intersect("elements", "item_elements"))
    scored = both.withColumn("similarity", shared / (F.size("elements") + F.size("item_elements") - shared)).filter(F.col("similarity") >= similarity).select(*same, "item_content", "similarity")
    named = scored.join(listed.select("item_id", F.col("item_size").alias("size"), "item_content"), ["size", "item_content"])
    placed = found.select("doc_id", "key_", "at", *same).join(cut(named, "leak-pairs"), same)
    return placed.groupBy("doc_id", "key_", "item_id").agg(F.max("similarity").alias("similarity"), F.countDistinct("at", "size").alias("n_windows"), F.min("at").alias("first_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns; null and empty texts, repeated rows and null ids stay. Without items all rows stay."""
    leaks = matches(docs, benchmark, width, similarity).select(F.col("doc_id").alias("leak_id_"), F.col("key_").alias("leak_key_")).distinct()
    return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(leaks["leak_id_"]) & (F.xxhash64(docs["text"]) == leaks["leak_key_"]), "left_anti")
