"""Operator 3: chat formatting after the collapse of cumulative snapshots, in Spark expressions only.

Logs often hold a conversation again and again as it grows. A rolling hash of
every turn prefix tells which conversations are prefixes of longer ones; an
anti-join keeps the maximal ones, which are then rendered.

Turns are range-partitioned in their order, so that a long conversation lies in
several partitions. Everything is done on its runs, the parts of it in one
partition each; what carries over from earlier runs is a row a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnflow.llm.common import cut, partitions

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
#: Equal rows are dealt to partitions in slices of this many.
EQUAL_ROWS = 256
_PLACE = (1 << 33) - 1  # monotonically_increasing_id has the place in the partition in its low 33 bits
RUN = ("part", "k1", "k2")


def _key(conv_id: Column) -> list[Column]:
    """A 128-bit key of a conversation that is never null."""
    return [F.xxhash64(F.lit(seed), conv_id.isNull(), conv_id).alias(f"k{seed}") for seed in (1, 2)]


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, k1, k2, part, at, c1, c2, piece): each turn's partition and place in it, the hash of role and text, and the turn rendered.

    Turns are ordered by turn, then role and text, nulls first; equal rows stay
    as often as they occur. They are counted before the shuffle and dealt in
    slices, so that neither a long conversation nor a row however often
    repeated goes to one task.
    """
    names = ["conv_id", "turn", "role", "text"]
    counted = turns.select(*names).groupBy(*names).agg(F.count("*").alias("copies"))
    sliced = counted.select(*names, "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / EQUAL_ROWS))).alias("slice"))
    order = [*[F.col(c).asc_nulls_first() for c in names], F.col("slice").asc()]
    ranged = sliced.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    n = F.least(F.lit(EQUAL_ROWS), F.col("copies") - F.col("slice") * EQUAL_ROWS)
    rows = ranged.select("conv_id", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("copy"))
    content = [F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"c{seed}") for seed in (1, 2)]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    return cut(rows.select("conv_id", *_key(F.col("conv_id")), F.spark_partition_id().alias("part"), at.alias("at"), *content, _rendered(F.col("role"), F.col("text")).alias("piece")), "chat-turns")


def runs(placed: DataFrame) -> DataFrame:
    """Per conversation and partition: conv_id, k1, k2, part, start (its first place there), n, before (turns in earlier partitions), n_turns, slice (from 1), n_slices."""
    one = placed.groupBy(*RUN).agg(F.first("conv_id").alias("conv_id"), F.min("at").alias("start"), F.count("*").alias("n"))
    whole = Window.partitionBy("k1", "k2")  # a row a partition
    so_far = whole.orderBy("part")
    return cut(one.select("*", (F.sum("n").over(so_far) - F.col("n")).alias("before"), F.sum("n").over(whole).cast("int").alias("n_turns"), F.row_number().over(so_far).alias("slice"), F.count("*").over(whole).cast("int").alias("n_slices")), "chat-runs")


def prefixes(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, p1, p2): for each turn, its place from 1 and the 128-bit hash of the turns up to it.

    Each turn's hash covers its place, role and text, with nulls told from
    empty strings; the rolling hash is the exclusive-or of those so far, and as
    places differ it depends on the order.
    """
    place = (F.col("before") + F.col("at") - F.col("start") + 1).cast("int")
    rows = placed.select(*RUN, "at", "c1", "c2").join(parts.drop("slice"), list(RUN)).withColumn("place", place)
    so_far = Window.partitionBy(*RUN).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolling = [F.bit_xor(F.xxhash64(F.lit(seed), "place", "c1", "c2")).over(so_far).alias(f"p{seed}") for seed in (1, 2)]
    within = cut(rows.select(*RUN, "conv_id", "n_slices", "place", "n_turns", *rolling, (F.col("place") == F.col("before") + F.col("n")).alias("ends")), "chat-within")
    earlier = Window.partitionBy("k1", "k2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = within.filter("ends AND n_slices > 1").select(*RUN, *[F.bit_xor(f"p{seed}").over(earlier).alias(f"e{seed}") for seed in (1, 2)])
    joined = within.join(cut(ends, "chat-carried"), list(RUN), "left")  # two rows a partition at most; Spark decides by the stored size
    carried = [F.col(f"p{seed}").bitwiseXOR(F.coalesce(F.col(f"e{seed}"), F.lit(0).cast("long"))).alias(f"p{seed}") for seed in (1, 2)]
    return joined.select("conv_id", "place", "n_turns", *carried)


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same) of prefixes(): conversations that no longer one starts with; of equal ones the least conv_id stays, n_same counts them."""
    whole = hashed.filter("place = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("least"), F.count("*").alias("n_same"))
    inner = hashed.filter("place < n_turns").select(F.col("place").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(inner, ["n_turns", "p1", "p2"], "left_anti").select(F.col("least.conv_id").alias("conv_id"), "n_turns", "n_same")


def format_slices(turns: DataFrame) -> DataFrame:
    """Maximal conversations in slices: conv_id, n_turns, n_same, slice (from 1), n_slices and chat, the slice's turns rendered in order.

    A slice is what one partition of the ordered turns holds of a conversation,
    so a conversation of any length comes out, in more slices. All else is as
    in format_chats().
    """
    placed = in_order(turns)
    parts = runs(placed)
    kept = maximal(prefixes(placed, parts)).select(*_key(F.col("conv_id")), "n_same")
    wanted = cut(parts.select(*RUN, "conv_id", "n_turns", "slice", "n_slices").join(kept, ["k1", "k2"]), "chat-kept")
    rows = placed.select(*RUN, "at", "piece").join(wanted, list(RUN))
    chats = rows.groupBy(*RUN, "conv_id", "n_turns", "n_same", "slice", "n_slices").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("t"))
    return chats.select("conv_id", "n_turns", "n_same", "slice", "n_slices", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("chat"))


def format_chats(turns: DataFrame) -> DataFrame:
    """A row per maximal conversation: conv_id, n_turns, n_same and chat, its turns rendered in order.

    A null role renders as "unknown", a null text as empty. Rows with a null
    conv_id are one conversation. Columns other than conv_id, turn, role and
    text are ignored. An empty table gives an empty result. A conversation that
    spans partitions is rendered a partition at a time, then put together; one
    whose rendering exceeds a string (2 GB) needs format_slices().
    """
    slices = format_slices(turns)
    short = slices.filter("n_slices = 1").select("conv_id", "n_turns", "n_same", "chat")
    long = slices.filter("n_slices > 1").groupBy("conv_id", "n_turns", "n_same").agg(F.sort_array(F.collect_list(F.struct("slice", "chat"))).alias("t"))
    return short.unionByName(long.select("conv_id", "n_turns", "n_same", F.array_join(F.transform("t", lambda x: x["chat"]), "").alias("chat")))
