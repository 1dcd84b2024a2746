"""Operator 8: quality rules by distribution divergence, in Spark expressions only.

Each document's histogram of character classes and of common words is compared
with the reference of its language by the Jensen-Shannon distance. References
are sums over all documents of a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kilnflow.llm.common import cut, words

#: Disjoint character classes; what is in none of them (letters beyond ASCII, marks) is the last class. The second is white space.
CLASSES = (r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[0-9]", r"[.,;:?'\"()-]", r"[!-/:-@\[-`{-~&&[^.,;:?'\"()-]]")
SPACES = 1
#: Common words of four languages, fixed values.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "are"),
    "fr": ("le", "la", "de", "et", "les", "des", "un", "une", "que", "en", "pour", "qui"),
    "de": ("der", "die", "und", "das", "in", "den", "von", "zu", "mit", "ist", "ein", "des"),
    "es": ("el", "la", "de", "que", "y", "en", "un", "los", "se", "del", "las", "por"),
}
#: A class distance above the first rejects, and a word distance above this share of what a text without any common word has; both lie above what prose shows.
MAX_CLASS, MAX_WORDS_SHARE = 0.27, 0.9
#: Shorter documents have no say: their histograms are too sparse to compare.
MIN_CHARS, MIN_WORDS = 200, 50
SYMBOLS = r"[#*$%&|<>]"


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two arrays of counts; null where either is empty."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    part = lambda a, b: F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    def compare(x: Column) -> Column:
        terms = F.zip_with(x["p"], x["q"], lambda a, b: part(a / x["n"], b / x["m"]) + part(b / x["m"], a / x["n"]))
        return F.when((x["n"] > 0) & (x["m"] > 0), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / 2, F.lit(0.0))))

    both = F.array(F.struct(p.alias("p"), q.alias("q"), total(p).alias("n"), total(q).alias("m")))
    return F.transform(both, compare)[0]


def _repeat_words(n: Column) -> Column:
    """Words in 3-word windows found twice or more, of the window hashes sorted with their places in ``windows``, which is empty where none repeats."""
    w = F.col("windows")
    twice = F.filter(w, lambda x, i: ((i > 0) & (w[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(w) - 1) & (w[F.least(i + 1, F.size(w) - 1)]["h"] == x["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    fold = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")), lambda acc: acc["n"])
    return F.when(n < 3, F.lit(0)).otherwise(fold).cast("long")


def features(docs: DataFrame, common: dict[str, tuple[str, ...]] = COMMON) -> DataFrame:
    """doc_id, lang, key_ (hash of the text) and the counts of every row; words are compared in lower case without marks.

    Window hashes are 64 bits wide and compared within a document only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("text"), words(F.col("text")).alias("w"))
    left = ["text", *[f"t{i}" for i in range(len(CLASSES))]]
    for i, pattern in enumerate(CLASSES):  # classes are disjoint, so each is taken out of what the ones before left
        rows = rows.withColumn(left[i + 1], F.regexp_replace(left[i], f"{pattern}+", ""))
    taken = lambda i: (F.length(left[i]) - F.length(left[i + 1])).cast("long")
    w, n = F.col("w"), F.size("w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    lists = F.lit(None).cast("array<string>")
    for lang, listed in common.items():
        lists = F.when(F.col("lang") == lang, F.array(*[F.lit(x) for x in listed])).otherwise(lists)
    rows = rows.withColumn("hashes", hashes)
    sorted_ = F.sort_array(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), sorted_).otherwise(none))  # without a repeated window there is nothing to count
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("lines", lines).withColumn("plain", F.split(F.lower("text"), r"[^\p{L}]+")).withColumn("list_", lists)
    width = max(map(len, common.values()))
    hits = F.filter("plain", lambda x: F.array_contains(F.col("list_"), x))
    n_plain = F.size(F.filter("plain", lambda x: x != ""))
    rest = left[-2]  # symbols are all of the last class
    rows = rows.select(
        "doc_id", "lang", F.xxhash64("text").alias("key_"), F.length("text").cast("long").alias("n_chars_"),
        n.cast("long").alias("n_words"), (F.length("text") - taken(SPACES)).cast("long").alias("word_chars"),
        (F.length(rest) - F.length(F.regexp_replace(rest, f"{SYMBOLS}+", ""))).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(n).alias("n_repeat_words"),
        *[taken(i).alias(f"c{i}") for i in range(len(CLASSES))],
        n_plain.cast("long").alias("n_plain"), F.coalesce(hits, F.array().cast("array<string>")).alias("hits"), "list_",
    )
    times = lambda j: F.size(F.filter("hits", lambda x: x == F.try_element_at("list_", F.lit(j + 1))))  # noqa: E731  a second argument of the inner function would be the place in hits
    counts = [F.coalesce(times(j), F.lit(0)).cast("long").alias(f"w{j}") for j in range(width)]
    return rows.select(*[c for c in rows.columns if c not in ("hits", "list_")], *counts)


def judge(docs: DataFrame, common: dict[str, tuple[str, ...]] = COMMON) -> DataFrame:
    """Per row of ``docs``: doc_id, key_, the base counts, base_failed, class_distance, words_distance and kept.

    A null text has no words and fails. A null or unlisted lang is compared by
    character classes only, against the rows of that lang. Empty tables give
    empty results; rows alike get the same verdict. Other columns are not kept.
    """
    width = max(map(len, common.values()))
    rows = cut(features(docs, common), "quality-features")
    names = [f"c{i}" for i in range(len(CLASSES))] + ["n_chars_", "n_plain"] + [f"w{j}" for j in range(width)]
    reference = rows.groupBy("lang").agg(*[F.sum(c).alias(f"r_{c}") for c in names]).withColumnRenamed("lang", "r_lang")
    def hist(total: str, parts: list[str]) -> Column:
        """The counts and what of the total is in none of them."""
        counts = F.array(*map(F.col, parts))
        return F.concat(counts, F.array(F.greatest(F.col(total) - F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long"))))

    kinds = {"class": ("n_chars_", [f"c{i}" for i in range(len(CLASSES))]), "words": ("n_plain", [f"w{j}" for j in range(width)])}
    of = lambda kind, p: hist(p + kinds[kind][0], [p + c for c in kinds[kind][1]])
    wordless = F.array(*[F.lit(0).cast("long")] * width, F.lit(1).cast("long"))
    reference = reference.withColumn("r_wordless", js_distance(wordless, of("words", "r_")))
    reference = cut(reference, "quality-reference")  # a row per language; its stored size tells Spark whether to broadcast it
    both = rows.join(reference, F.col("lang").eqNullSafe(F.col("r_lang")))
    listed = F.col("lang").isin(*common) if common else F.lit(False)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    both = both.withColumn("class_distance", F.when(F.col("n_chars_") >= MIN_CHARS, js_distance(of("class", ""), of("class", "r_"))))
    both = both.withColumn("words_distance", F.when((F.col("n_plain") >= MIN_WORDS) & F.coalesce(listed, F.lit(False)), js_distance(of("words", ""), of("words", "r_"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS) | F.coalesce(F.col("words_distance") > MAX_WORDS_SHARE * F.col("r_wordless"), F.lit(False))
    return both.select("doc_id", "key_", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "words_distance")


def keep_good(docs: DataFrame, common: dict[str, tuple[str, ...]] = COMMON) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with their own columns; repeated rows stay or go together, null and empty texts go, an empty table stays empty."""
    good = judge(docs, common).filter("kept").select(F.col("doc_id").alias("good_id_"), F.col("key_").alias("good_key_")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(good, docs["doc_id"].eqNullSafe(good["good_id_"]) & (key == good["good_key_"]), "left_semi")
