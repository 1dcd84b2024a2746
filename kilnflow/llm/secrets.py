"""Operator 7: secret scan with sliding-window entropy, in Spark expressions only.

Three fixed patterns give the base spans. The entropy scan adds runs of key
characters in which some window of WINDOW characters has a Shannon entropy
above the limit of its character class; the window's counts are updated by the
character that enters and the one that leaves.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns of the base kinds, and the least length of what must match them.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: A candidate of the entropy scan: a run of key characters that holds a letter and a digit and is at least a window long.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits per character above which a window of that class is suspect (20 hex digits have 4 at most, 20 others log2(20) = 4.32).
MIN_HEX_BITS, MIN_ALNUM_BITS, MIN_KEY_BITS = 3.0, 3.6, 3.8
#: Candidates of these forms are no secrets: words joined by marks, dates and numbers, paths of words, ruler lines, UUIDs.
#: The repeated groups are possessive, which Java runs as a loop; what follows one can't begin like it, so the same texts match.
ALLOW = (
    r"^[A-Za-z]+(?:[+/_=-]+[A-Za-z]+)*+[+/_=-]*$",
    r"^[0-9+/_=-]+$",
    r"^[+/_=-]*(?:[A-Za-z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Za-z]+|[0-9]{1,4}))*+[+/_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Spans are appended in runs of so many, as each append copies its array.
_RUN = 256


def _folded(items: Column, begin: Column, step) -> Column:
    """The spans that a fold over ``items`` gives out: ``step(state, item)`` returns the next state (an int) and a span, or null for none."""
    none = F.array().cast(_SPAN)

    def one(acc: Column, x: Column) -> Column:
        state, span = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(span.isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    def run(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("spans")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["parts"], F.array(r["spans"])).alias("parts")))[0]

    def whole(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _RUN).cast("int")), lambda i: F.slice(xs, i * _RUN + 1, F.lit(_RUN)))
        return F.aggregate(runs, F.struct(begin.alias("state"), F.array().cast(f"array<{_SPAN}>").alias("parts")), run, lambda acc: F.flatten(acc["parts"]))

    return F.transform(F.array(items), lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))[0]


def _located(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the pattern's matches for which keep(match) holds, as (start, kind, end) in code points.

    The pieces between the matches, from split(), and the matches themselves
    alternate, so their lengths add up to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))  # one gap more than matches: the last match is null

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.coalesce(end, start), F.when(x["match"].isNotNull() & keep(x["match"]), span)

    return F.when(F.regexp_like(text, F.lit(pattern)), _folded(steps, F.lit(0), step)).otherwise(F.array().cast(_SPAN))


#: Counts are packed into longs, so many to each of so many bits.
_PACKED, _BITS = 12, 5
#: Terms c * log2(c) are whole numbers of this part of a bit, so that sums stay exact however long the string is.
_UNIT = 1 << 24


def max_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window of the string, from incremental counts; 0 for shorter strings.

    The string becomes an array of character codes once. Each step adds the
    character that enters to the packed counts and takes out the one that
    leaves; the sum of c * log2(c) over the counts changes by their two terms.
    Entropy is log2(window) - sum / window. Time grows with the length.
    """
    if window >= 1 << _BITS:
        raise ValueError(f"counts of a window of {window} don't fit {_BITS} bits")
    lookup = [0] * 128
    for i, c in enumerate(ALPHABET):
        lookup[ord(c)] = i + 1
    table = F.array(*map(F.lit, lookup))
    term = [0] + [round(c * log2(c) * _UNIT) for c in range(1, window + 1)]
    more = F.array(*[F.lit(term[c + 1] - term[c]) for c in range(window)])  # what the sum gains when a count of c grows
    bits = lambda code: (code % _PACKED * _BITS).cast("int")
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), bits(code))

    def step(enter: Column, leave: Column) -> Column:
        return F.struct(
            F.floor(enter / _PACKED).cast("int").alias("e"), bits(enter).alias("es"), one(enter).alias("e1"),
            F.floor(leave / _PACKED).cast("int").alias("l"), bits(leave).alias("ls"), one(leave).alias("l1"),
            (leave >= 0).alias("full"), (enter == leave).cast("int").alias("same"),
        )

    count = lambda acc, at, by: F.call_function("shiftright", acc["counts"][at], by).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def move(acc: Column, x: Column) -> Column:
        # The window before this step is looked at first, as its sum is at hand.
        best = F.when(x["full"], F.least(acc["best"], acc["sum"])).otherwise(acc["best"])
        left = F.when(x["full"], more[count(acc, x["l"], x["ls"]) - 1]).otherwise(F.lit(0))
        total = acc["sum"] - left + more[count(acc, x["e"], x["es"]) - x["same"]]
        parts = [acc["counts"][k] + F.when(x["e"] == k, x["e1"]).otherwise(F.lit(0)) - F.when(x["full"] & (x["l"] == k), x["l1"]).otherwise(F.lit(0)) for k in range(len(ALPHABET) // _PACKED + 1)]
        return F.struct(F.array(*parts).alias("counts"), total.cast("long").alias("sum"), best.alias("best"))

    codes = F.transform(F.split(candidate, ""), lambda c: table[F.ascii(c)])
    zeros = F.array(*[F.lit(0).cast("long")] * (len(ALPHABET) // _PACKED + 1))
    start = F.struct(zeros.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 62).alias("best"))
    done = lambda acc: F.log2(F.lit(float(window))) - F.least(acc["best"], acc["sum"]) / float(_UNIT * window)

    def whole(codes: Column) -> Column:
        lagged = F.concat(F.array_repeat(F.lit(-1), window), F.slice(codes, 1, F.greatest(F.size(codes) - window, F.lit(0))))
        return F.aggregate(F.zip_with(codes, lagged, step), start, move, done)

    return F.when(F.length(candidate) >= window, F.transform(F.array(codes), whole)[0]).otherwise(F.lit(0.0))


def _suspect(candidate: Column) -> Column:
    limit = F.when(F.regexp_like(candidate, F.lit(r"^([0-9a-f]+|[0-9A-F]+)$")), F.lit(MIN_HEX_BITS)).when(F.regexp_like(candidate, F.lit(r"^[A-Za-z0-9]+$")), F.lit(MIN_ALNUM_BITS)).otherwise(F.lit(MIN_KEY_BITS))
    allowed = F.lit(False)
    for form in ALLOW:
        allowed = allowed | F.regexp_like(candidate, F.lit(form))
    return ~allowed & (max_entropy(candidate) >= limit)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text and ``found``, an array of (start, kind, end) ordered by start, then kind.

    A null text is empty. Offsets are code points, ends exclusive. Kind is an
    index into KINDS. Base matches are leftmost and non-overlapping per kind
    and then checked for length; entropy spans are added unless a base span
    holds all of them, so they may overlap one. Other columns of ``docs`` are not kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN
    rows = docs.select("doc_id", text.alias("text"))
    # Runs shorter than the least length are no matches either way for the two kinds that consist of one run.
    rows = rows.withColumns({
        "base_": F.concat(
            _located(F.col("text"), ASSIGN, 0, key),
            _located(F.col("text"), ACCESS, 1, lambda m: F.length(m) >= MIN_ACCESS),
            _located(F.col("text"), HEX.replace("+", f"{{{MIN_HEX},}}"), 2, lambda m: F.length(m) >= MIN_HEX),
        ),
        "more_": _located(F.col("text"), CANDIDATE, 3, _suspect),
    })
    # Within the sorted spans, a base one that begins no later comes before: the furthest end so far tells whether it holds an entropy span.
    keep = lambda far, x: (F.when(x["kind"] < 3, F.greatest(far, x["end"])).otherwise(far), F.when((x["kind"] < 3) | (x["end"] > far), x))
    free = _folded(F.col("all_"), F.lit(0), keep)
    rows = rows.withColumn("all_", F.sort_array(F.concat("base_", "more_")))
    return rows.select("doc_id", "text", F.sort_array("base_").alias("base"), F.when(F.size("more_") == 0, F.col("all_")).otherwise(free).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """doc_id and the text with every found span replaced by ``mark``; overlapping spans merge into one.

    A null text becomes empty; a row stays for each row of ``docs``. Other columns are not kept.
    """

    def step(acc: Column, s: Column) -> Column:
        over = s["start"] < acc["at"]
        piece = F.when(over, F.lit("")).otherwise(F.concat(acc["text"].substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"), acc["text"].alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.col("text").alias("text"))
    done = F.aggregate("found", start, step)
    return scan(docs).withColumn("done", done).select("doc_id", F.concat(F.col("done.out"), F.expr("substring(text, done.at + 1)")).alias("text"))


def summarise(found: DataFrame) -> DataFrame:
    """The digest columns of scan()'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
