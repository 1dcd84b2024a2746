"""Operator 12: how filters of documents interact, over all orders in which they may run.

Words are exploded and counted per (document, word), then per document; the
other conditions are joined to that. What follows needs only how many documents
fail each set of filters: 32 counts a part, from which every order is read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, functions as F

from kilnflow.llm.common import cut, words

LETTERS = "ABCDE"
_KEY = ["id_", "h1", "h2", "part"]


def _documents(docs: DataFrame) -> DataFrame:
    """Key columns and text. Rows equal in all of doc_id, text and lang share a key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_"), text.alias("text_"), F.coalesce(F.col("lang"), F.lit("")).alias("part"))
    id_ = F.coalesce("doc_", F.lit(-(1 << 63)).cast("long"))
    return rows.select(id_.alias("id_"), F.xxhash64("text_").alias("h1"), F.xxhash64(F.lit(1), "text_").alias("h2"), "part", F.col("doc_").isNull().alias("no_id"), "text_")


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n_words, n_distinct) of documents with a word, over all rows of a key.

    Texts are dealt by their key once; words are counted where they are then,
    without another shuffle.
    """
    dealt = _documents(docs).select(*_KEY, "text_").repartition(*_KEY)
    each = dealt.select(*_KEY, F.explode(words(F.col("text_"))).alias("word")).groupBy(*_KEY, "word").agg(F.count("*").alias("n"))
    return each.groupBy(*_KEY).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def flags(docs: DataFrame) -> DataFrame:
    """Per key: doc_id, part (lang; null: empty), copies (rows of it) and whether they fail each of A to E.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * [A-Z]
    characters > 10 * code points; D: any of [#$%&*|]; E: the same text as a row
    with a smaller doc_id. A null text is empty. Rows with a null doc_id never
    fail E, nor do others because of them; rows that share the smallest doc_id
    of a text all pass. Equal rows are one key with that many copies. An empty
    table gives an empty result.
    """
    text = F.col("text_")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 10
    by_key = _documents(docs).select(*_KEY, "no_id", capitals.alias("C"), F.regexp_like(text, F.lit("[#$%&*|]")).alias("D"))
    by_key = cut(by_key.groupBy(*_KEY, "no_id", "C", "D").agg(F.count("*").alias("copies")), "audit-flags")
    # The first document of each text is looked up by (id, text), so that a text however common makes no hot key.
    first = by_key.filter("NOT no_id").groupBy("h1", "h2").agg(F.min("id_").alias("id_")).withColumn("first", F.lit(True))
    counted = by_key.join(word_counts(docs), _KEY, "left").join(first, ["id_", "h1", "h2"], "left")
    total = F.expr("coalesce(n_words, 0) div copies")
    return counted.select(
        F.when(~F.col("no_id"), F.col("id_")).alias("doc_id"), "part", "copies", (total < 100).alias("A"), (F.coalesce("n_distinct", F.lit(0)) * 100 < total * 80).alias("B"), "C", "D", (~F.col("no_id") & F.col("first").isNull()).alias("E")
    )


def audit(flagged: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row per part, order of the filters and step, counting documents (rows).

    ``flagged``: part, copies, doc_id and a boolean per letter. Columns: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. Label rows of one doc_id count together: a document is
    good (toxic) if any of them says so; null and other labels say nothing, and
    a null doc_id has none. No
    documents give no rows.
    """
    k = len(letters)
    mask = sum((F.when(F.col(x), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(letters)), F.lit(0))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = flagged.join(marks.filter("good OR toxic"), "doc_id", "left")
    count = lambda c: F.sum(F.when(F.col(c), F.col("copies")).otherwise(F.lit(0)))
    sets = known.groupBy("part", mask.alias("m")).agg(F.sum("copies").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
    # 32 conditional counts of each kind, over rows that were counted by set of failed filters before the shuffle.
    conditional = lambda c: F.array(*[F.sum(F.when(F.col("m") == m, F.col(c)).otherwise(F.lit(0))) for m in range(1 << k)]).alias(c)
    parts = sets.groupBy("part").agg(*[conditional(c) for c in ("n", "good", "toxic")])
    orders = F.explode(F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")).alias("filter_order")
    steps = parts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda i: f"shiftleft(1, locate(substr(filter_order, {i}, 1), '{letters}') - 1)"
    rows = steps.withColumn("bit", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(filter(sequence(1, {k}), i -> i < step), 0, (a, i) -> a + {bit('i')})"))
    total = lambda c, when, times="1": F.expr(f"aggregate(sequence(0, {(1 << k) - 1}), 0L, (a, m) -> a + CASE WHEN {when} THEN {c}[m] * {times} ELSE 0 END)")
    here = "m & bit > 0 AND m & before = 0"
    return rows.select(
        "part", "filter_order", "step", total("n", "m & (bit | before) = 0").alias("kept"), total("n", here).alias("removed"), total("n", "m & bit > 0 AND m & before > 0").alias("redundant"), total("n", "m = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # Of a set of failed filters each is the first in an equal share of all orders.
        total("n", "m & bit > 0", f"({factorial(k)} div bit_count(m))").alias("shapley"),
    )
