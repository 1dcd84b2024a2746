"""Operator 2: mix sources to target weights by hash-threshold histograms.

Sizes are summed by source and by a slice of a document hash. A budget's
threshold lies in the one slice where the running sum crosses it; only that
slice is split again by the next bits. Documents below the threshold are taken:
thresholds are nested (a larger budget takes a superset), nothing is sorted,
and reruns agree as the hash depends on the row alone. Only where a threshold
falls among equal rows, which share a hash, are these few numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnflow.functions.ordering import with_positions
from kilnflow.llm.common import cut, n_words

#: Each level resolves so many more bits of the hash, in two steps of half of them.
LEVEL_BITS, LEVELS = 16, 3


def _slice(level: int) -> Column:
    """The level's bits of the hash column ``h``, from the top."""
    shift = 64 - LEVEL_BITS * (level + 1)
    return F.shiftrightunsigned("h", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources``: (source, source_size). Adds weight and target.

    Weights repeat over the sources by code point, null last. They share
    ``share`` times all sizes; none gets over ``most`` times its size, and what
    is cut is reshared by weight among the others until none is above: then
    target = min(most * size, level * weight) with one common level. Each
    resharing is one aggregation over the sources, however many there are, and
    only raises the level, so that sources once cut stay so.
    """
    known = with_positions(sources, [F.col("source").asc_nulls_last()], "place_")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place_") % len(weights) + 1).cast("int"))
    rows = cut(known.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "mix-sources")
    pool = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, n_cut = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        now = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cut"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if now.n == n_cut:
            break
        n_cut = now.n
        if not now.open:  # all are cut
            level = float("inf")
            break
        level = max(level, (pool - (now.cut or 0.0)) / now.open)
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _crossing(state: DataFrame, sums: DataFrame) -> DataFrame:
    """``state`` (source, copies, budget, prefix) moved to the slice of ``sums`` (source, slice, size, rows, least, most) in which the running sum crosses the budget.

    A source has at most 2 ** (LEVEL_BITS / 2) slices, which bounds the window.
    The budget loses what is below the slice; the prefix gains the slice's bits.
    """
    first = Window.partitionBy("source").orderBy("slice")
    running = sums.withColumn("under", F.sum("size").over(first) - F.col("size")).withColumnRenamed("source", "s_")
    crossing = (
        state.join(running, F.col("source").eqNullSafe(F.col("s_")) & (F.col("under") <= F.col("budget")), "left")
        .groupBy("source", "copies", "budget", "prefix")
        .agg(F.max(F.struct("slice", "under", "size", "rows", "least", "most")).alias("at"))
    )
    return crossing.select(
        "source", "copies",
        (F.col("budget") - F.coalesce("at.under", F.lit(0))).alias("budget"),
        (F.shiftleft("prefix", LEVEL_BITS // 2) + F.coalesce("at.slice", F.lit(0))).alias("prefix"),
        F.coalesce("at.size", F.lit(0)).alias("slice_size"), "at.rows", "at.least", "at.most",
    )


def thresholds(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """``base``: (source, size, h); ``wanted``: (source, target, source_size).

    Returns per source the number of whole copies, and the exclusive upper
    bound ``cut_at`` on the top LEVEL_BITS * LEVELS bits of h under which one
    more copy is taken. A level's sums by slice are written once and searched
    in two steps: by the upper half of its bits, then by the lower half within
    the crossing. The slice that holds the last crossing is taken whole when
    that lands nearer the budget; but of several rows of one size in it (equal
    ones, as a rule) ``tie_take`` of those at ``tie_at`` are taken, which is
    null elsewhere.
    """
    half = LEVEL_BITS // 2
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    state = wanted.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")).select("source", "copies", "budget", F.lit(0).cast("long").alias("prefix"))
    inside = base
    held = lambda rows, bits: rows.join(state.select(F.col("source").alias("s_"), F.col("prefix").alias("p_")), F.col("source").eqNullSafe(F.col("s_")) & (bits == F.col("p_"))).select(*rows.columns)
    for level in range(LEVELS):
        if level:
            inside = held(inside, F.shiftrightunsigned("h", 64 - LEVEL_BITS * level))
        sums = cut(inside.groupBy("source", _slice(level).alias("fine")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("size").alias("least"), F.max("size").alias("most")), f"mix-sums{level}")
        upper = sums.groupBy("source", F.shiftright("fine", half).alias("slice")).agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
        state = _crossing(state, upper).select("source", "copies", "budget", "prefix")
        top = F.col("p_").bitwiseAND(F.lit((1 << half) - 1))
        near = sums.join(state.select(F.col("source").alias("s_"), F.col("prefix").alias("p_")), F.col("source").eqNullSafe(F.col("s_")) & (F.shiftright("fine", half) == top))
        last = cut(_crossing(state, near.select("source", F.col("fine").bitwiseAND(F.lit((1 << half) - 1)).alias("slice"), "size", "rows", "least", "most")), f"mix-lower{level}")
        state = last.select("source", "copies", "budget", "prefix")
    nearer = (F.col("slice_size") > 0) & (F.col("budget") * 2 >= F.col("slice_size"))
    some = F.when((F.col("rows") > 1) & (F.col("least") == F.col("most")) & (F.col("most") > 0), F.floor(F.try_divide(F.col("budget"), F.col("most")) + 0.5))
    tie = F.when((some > 0) & (some < F.col("rows")), some)
    return last.select("source", "copies", (F.col("prefix") + F.when(tie.isNull() & nearer, 1).otherwise(0)).alias("cut_at"), F.when(tie.isNotNull(), F.col("prefix")).alias("tie_at"), tie.alias("tie_take"))


def _hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The written tables of document sizes (doc_id, source, size, h) and of the plan, a row per source: (source, source_size, target, whole, cut_at, tie_at, tie_take)."""
    base = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash(seed).alias("h")), "mix-sizes")
    wanted = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    bounds = thresholds(base, wanted)
    both = wanted.alias("w").join(bounds.alias("b"), F.col("w.source").eqNullSafe(F.col("b.source")))
    return base, cut(both.select("w.source", "w.source_size", "w.target", F.col("b.copies").alias("whole"), "b.cut_at", "b.tie_at", "b.tie_take"), "mix-plan")


def _with_copies(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """``rows`` (with source and h) and how often the plan takes each. The plan has a row per source; its stored size tells Spark whether to broadcast it."""
    bounds = plan.select(F.col("source").alias("plan_source_"), F.col("source_size").alias("plan_size_"), F.col("target").alias("plan_target_"), "whole", "cut_at", "tie_at", "tie_take")
    top = F.shiftrightunsigned("h", 64 - LEVEL_BITS * LEVELS)
    copies = lambda more: F.least(F.col("whole") + F.when(more, 1).otherwise(0), F.lit(int(most)))
    joined = rows.join(bounds, F.col("source").eqNullSafe(F.col("plan_source_")))
    known = joined.withColumn("copies_", copies(top < F.col("cut_at")))
    if plan.filter("tie_take IS NOT NULL").isEmpty():
        return known
    # A threshold falls among equal rows: which of them is all the same, how many is not. They are numbered across
    # partitions, as there may be very many.
    tied = F.coalesce(top == F.col("tie_at"), F.lit(False))
    spread = joined.filter(tied).withColumn("spread_", F.xxhash64(F.monotonically_increasing_id()))
    placed = with_positions(spread, [F.col("source").asc_nulls_last(), F.col("spread_")], "place_")
    first = cut(placed.groupBy(F.col("source").alias("first_source_")).agg(F.min("place_").alias("first_")), "mix-ties")
    numbered = placed.join(first, F.col("source").eqNullSafe(F.col("first_source_"))).withColumn("copies_", copies(F.col("place_") - F.col("first_") < F.col("tie_take")))
    return known.filter(~tied).unionByName(numbered.select(*known.columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies (how often the mix takes it) and taken (copies * size).

    Null texts have size 0; a null source is a source of its own, last in the
    order. Rows alike in doc_id and text share one hash; where the threshold
    falls among n of them, as many take one more copy as come nearest to the
    target. Sources without words get target 0. An empty table gives an empty
    result.
    """
    base, plan = plan_mix(docs, weights, share, most, seed)
    out = _with_copies(base, plan, most)
    return out.select("doc_id", "source", "size", F.col("plan_size_").alias("source_size"), F.col("plan_target_").alias("target"), F.col("copies_").alias("copies"), (F.col("copies_") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, with its own columns; nulls and equal rows as in mix().

    Texts are not shuffled, but for those of equal rows among which a threshold
    falls. An empty table gives an empty result.
    """
    _, plan = plan_mix(docs, weights, share, most, seed)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    rows = docs.select(own, F.col("source"), _hash(seed).alias("h"))
    taken = _with_copies(rows, plan, most).filter("copies_ > 0")
    return taken.select("row_", F.explode(F.sequence(F.lit(1), F.col("copies_"))).alias("copy_")).select("row_.*")
