"""Operator 13: spelling variants by a positional q-gram index with a count filter.

Words a single edit apart share all but two of their padded bigrams, each at
most one place off. Words meet in blocks of the index: those that share three
of their rarest bigrams. Within a block the postings of a word's bigrams,
limited in length and position, are merged; pairs with enough in common are
verified.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kilnflow.llm.common import cut, partitions

#: Runs of letters in Latin-1, in which a byte is a code point; other characters become "?".
_RUN = re.compile(rb"[a-z\xc0-\xff]+")
DELETE_EVERY = 97
#: Words of a task are counted in a table of at most so many.
HELD = 1 << 18
#: Bigrams that the key of a block names, of the rarest ones of a word.
SHARED = 3
#: A larger block is dealt in slices: a task indexes a slice of its words and looks up all others.
BLOCK = 4096


def words_of(doc_id: int | None, text: str | None, min_chars: int = 5) -> Counter[bytes]:
    """The words of a text in Latin-1 with their counts: runs of letters with A-Z lower-cased, some with a code point deleted."""
    runs = Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower()))
    found: Counter[bytes] = Counter()
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in runs.items():
        if len(run) < min_chars:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_chars:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` code points and ``min_count`` occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                held.update(words_of(doc_id.as_py(), text.as_py(), min_chars))
                if len(held) > HELD:
                    yield give()
                    held.clear()
        yield give()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def grams(word: str) -> list[str]:
    """Bigrams of a word with an end mark on both sides; the place in the list is the position."""
    padded = f"\0{word}\0"
    return [padded[i : i + 2] for i in range(len(word) + 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells two words apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def block_keys(word: str, rank: dict[str, int]) -> list[tuple[int, int]]:
    """(key, longer length of its pairs) of the word's blocks. Any two words an edit apart have a block in common.

    Let c be the longer length of a pair. Of c + 1 bigrams (c of a shorter
    word) the two share c - 1 at least, so of their 5 (4) first in any order of
    bigrams they share three. A word is in blocks of c = its length and, as the
    shorter one, of its length + 1.
    """
    seen: Counter[str] = Counter()
    tokens = []
    for g in grams(word):
        seen[g] += 1
        tokens.append((rank[g], seen[g]))
    tokens.sort()
    keys = set()
    for longer in (len(word), len(word) + 1):
        first = len(tokens) - (longer - 1) + SHARED
        for some in combinations(tokens[:first], SHARED):
            keys.add((xxhash.xxh64_intdigest(f"{longer}{some}") - (1 << 63), longer))
    return sorted(keys)


def common(lists: list[list[int]], need: int) -> Iterator[int]:
    """What at least ``need`` of the ascending lists hold, by a heap of their heads.

    Where too few heads are equal, one less than ``need`` lists go on to the
    next head at once: what they skip can't be in enough lists.
    """
    k = len(lists)
    heap = [held[0] * k + i for i, held in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * k
    while len(heap) >= need:
        least = heap[0] // k
        most = least * k + k
        taken = []
        while heap and heap[0] < most:
            taken.append(heapq.heappop(heap) % k)
        if len(taken) >= need:
            yield least
            least += 1
        else:
            while len(taken) < need - 1:
                taken.append(heapq.heappop(heap) % k)
            least = heap[0] // k if heap else least + 1
        for i in taken:
            held = lists[i]
            if held[-1] >= least:
                at[i] = bisect_left(held, least, at[i])
                heapq.heappush(heap, held[at[i]] * k + i)


class Index:
    """Positional postings of a block, whose words have the longer length of a pair or one code point less.

    A bigram is at the same place in two words of one length, and at the same
    place or one further in the longer of two words of different lengths.
    """

    def __init__(self, longer: int, rank: dict[str, int]) -> None:
        self.longer, self.rank, self.need = longer, rank, longer - 1
        self.words: list[str] = []
        self.long: dict[int, list[int]] = {}
        self.short: dict[int, list[int]] = {}

    def places(self, word: str) -> list[int]:
        """A number for each bigram at its position."""
        n, rank = len(self.rank), self.rank
        return [at * n + rank[g] for at, g in enumerate(grams(word))]

    def add(self, word: str, places: list[int]) -> None:
        held, j = self.long if len(word) == self.longer else self.short, len(self.words)
        for x in places:
            if x in held:
                held[x].append(j)
            else:
                held[x] = [j]
        self.words.append(word)

    def near(self, word: str, places: list[int]) -> Iterator[str]:
        """Indexed words one edit apart: postings within the limits of length and position, merged and counted."""
        n = len(self.rank)
        if len(word) == self.longer:
            of = ([self.long[x] for x in places if x in self.long], [self.short[y] for x in places for y in (x, x - n) if y in self.short])
        else:
            of = ([self.long[y] for x in places for y in (x, x + n) if y in self.long],)
        for lists in of:
            if len(lists) >= self.need:
                for j in common(lists, self.need):
                    if one_edit(word, self.words[j]):
                        yield self.words[j]


def near_pairs(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) of words one edit apart, each pair once with a < b, of a table (word, n) of distinct words."""
    spark = counted.sparkSession
    # There are no more bigrams than pairs of letters of the alphabet: the driver ranks them, rarest first.
    padded = F.concat(F.lit("\0"), "word", F.lit("\0"))
    bigrams = counted.select(F.explode(F.transform(F.sequence(F.lit(0), F.char_length("word")), lambda i: padded.substr(i + 1, F.lit(2)))).alias("g"))
    rank = {r.g: i for i, r in enumerate(bigrams.groupBy("g").agg(F.count("*").alias("k")).orderBy("k", "g").collect())}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 2000):
                words = b.column(0).slice(begin, 2000).to_pylist()
                keys = [block_keys(w, rank) for w in words]
                key, longer = ([x[i] for k in keys for x in k] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(longer, pa.int32()), pa.array([w for w, k in zip(words, keys) for _ in k], pa.string())], ["key", "longer", "word"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda: pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.string()), pa.array([max(p) for p in found], pa.string())], ["a", "b"])
        found: list[tuple[str, str]] = []
        index, here = None, None
        for b in batches:
            for key, longer, slice_, other, word in zip(*(c.to_pylist() for c in b.columns)):
                if here != (key, longer, slice_):
                    index, here = Index(longer, rank), (key, longer, slice_)
                places = index.places(word)
                found += [(word, x) for x in index.near(word, places)]
                if not other:
                    index.add(word, places)
                if len(found) > 10000:
                    yield give()
                    found = []
        yield give()

    blocks = cut(counted.select("word").mapInArrow(keys, "key long, longer int, word string"), "spelling-blocks")
    sizes = blocks.groupBy("key", "longer").agg(F.count("*").alias("size")).filter("size > 1")
    # Most blocks have one word. The others' keys are written, so that Spark joins them by their size.
    sizes = cut(sizes.select("key", "longer", F.ceil(F.col("size") / block).cast("int").alias("slices")), "spelling-sizes")
    own = blocks.join(sizes, ["key", "longer"]).select("key", "longer", "word", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int").alias("own"))
    # A word is indexed in its own slice and only looks up the slices before.
    dealt = own.select("key", "longer", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("slice"), "own", "word").select("key", "longer", "slice", (F.col("own") > F.col("slice")).alias("other"), "word")
    ordered = dealt.repartition(partitions(spark), "key", "longer", "slice").sortWithinPartitions("key", "longer", "slice", "other")
    return ordered.mapInArrow(match, "a string, b string").distinct()


def variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of [A-Za-z\u00C0-\u00FF] with A-Z in lower case; of
    one run in 97, by a hash of document and run, a code point is deleted first.
    Words of at least ``min_chars`` code points and ``min_count`` occurrences
    count. A word's form is the most frequent word one edit apart (of equals
    the first in code-point order), if that has ``ratio`` times its n; its root
    is where forms lead. A null or empty text has no words; a null doc_id hashes
    as an empty one; repeated rows count again; other columns are not read. An
    empty table gives an empty result.
    """
    counted = cut(word_counts(docs, min_chars, min_count), "spelling-words")
    pairs = cut(near_pairs(counted, block), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form")))
    near = both.join(counted.withColumnRenamed("word", "b"), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form")).alias("form"), F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"))
    judged = cut(judged, "spelling-forms")
    return judged.join(roots(judged.filter("form IS NOT NULL").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) without circles: where forms lead. Each round doubles the way, so that there are few."""
    ways = forms.select("word", F.col("form").alias("root"))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = cut(ways.join(further, "root", "left"), "spelling-ways")
        ways = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.filter("further IS NOT NULL").isEmpty():
            return ways
