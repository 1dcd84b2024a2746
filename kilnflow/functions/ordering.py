"""Positions, ranks and exact quantiles over a whole table without a single-task window.

A table is range-partitioned by its order and sorted within partitions; a row's
place is its place in the partition plus the sizes of the partitions before,
of which there are as many as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnflow.sources.shared import cut

_PLACE = (1 << 33) - 1  # monotonically_increasing_id has the place in the partition in its low 33 bits


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_positions(df: DataFrame, order_by: list[Column], name: str = "_position") -> DataFrame:
    """``df`` with the dense 0-based position of each row in a total order. The order should end with a unique key."""
    place = df.repartitionByRange(_partitions(df), *order_by).sortWithinPartitions(*order_by)
    placed = cut(place.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("_place")), "positions")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    joined = placed.join(F.broadcast(before), F.col("_part") == F.col("_p"))  # a row per partition
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_place")).alias(name))


def in_file_order(df: DataFrame, name: str = "_position") -> DataFrame:
    """``df`` with the dense 0-based position of each row in the order in which it is read: its place in its partition plus the rows of those before."""
    placed = cut(df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("_place")), "positions")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    joined = placed.join(F.broadcast(before), F.col("_part") == F.col("_p"))  # a row per partition
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_place")).alias(name))


def with_running_total(df: DataFrame, order_by: list[Column], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all earlier rows in a total order (0 for the first)."""
    placed = cut(df.repartitionByRange(_partitions(df), *order_by).select("*", F.spark_partition_id().alias("_part")), "running")
    sizes = placed.groupBy("_part").agg(F.sum(amount).alias("n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order_by)) - F.col(amount)
    joined = placed.withColumn("_within", within).join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_within")).alias(name))


def average_ranks(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """(group, value, name): the 1-based average rank of each distinct value within its group, ties sharing the mean.

    Ranks come from counts of distinct values, so a value however common costs
    one row; join them back on group and value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    totals = with_running_total(counts, [F.col(group), F.col(value)], "_n", "_less")
    starts = totals.groupBy(F.col(group).alias("_g")).agg(F.min("_less").alias("_start"))
    ranked = totals.join(starts, F.col(group).eqNullSafe(F.col("_g")))
    return ranked.select(group, value, (F.col("_less") - F.col("_start") + (F.col("_n") + 1) / 2).cast("double").alias(name))


#: Classes that a pass of exact_quantiles counts in a range of values.
BINS = 1 << 14
#: Rows of a range that are counted by value at once.
FEW = 1 << 14


def _signed_log(v: Column) -> Column:
    return F.signum(v) * F.log1p(F.abs(v))


def _bin(v: Column, lo: Column, hi: Column, scale) -> Column:
    """The class of ``v`` in [lo, hi], never less for a larger value; infinities and NaN, which is largest, have their own."""
    width = scale(hi) - scale(lo)
    inside = F.when(width > 0, F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((scale(v) - scale(lo)) / width * BINS)))).otherwise(F.lit(0))
    return F.when(F.isnan(v), BINS + 1).when(v == float("inf"), BINS).when(v == float("-inf"), -1).otherwise(inside).cast("int")


def exact_quantiles(df: DataFrame, group: str, value: str, probabilities: dict[str, float], method: str = "linear") -> DataFrame:
    """One row per group: the exact quantiles of ``value`` (nulls out), named as the keys of ``probabilities``.

    ``linear`` interpolates between the two neighbours; ``nearest`` takes the
    value at round((n - 1) q), halves away from zero. By radix selection: rows
    are counted by class of value, before any shuffle, and only the class that
    holds a wanted place is divided again, by the logarithm first and by value
    afterwards, until it has few rows or one value. No pass moves all rows.
    Groups without a value have no row.
    """
    rows = cut(df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")), "values")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.min("v").alias("least"), F.max("v").alias("most"))
    places = []
    for name, q in probabilities.items():
        at = (F.col("size") - 1) * F.lit(float(q))
        at = F.round(at) if method == "nearest" else at
        places += [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), k.cast("long").alias("k"), (at - F.floor(at)).alias("part")) for side, k in (("low", F.floor(at)), ("high", F.ceil(at)))]
    one = F.col("least") == F.col("most")
    end = lambda c: F.when(one, F.col("least")).otherwise(F.coalesce(c, F.lit(0.0))).alias(c)
    wanted = cut(sizes.select("g", end("lo"), end("hi"), F.col("size").alias("n"), one.alias("done"), F.explode(F.array(*places)).alias("x")).select("g", "lo", "hi", "n", "done", "x.*"), "places")
    scale, whole = _signed_log, True
    while True:
        open_ = wanted.filter("NOT done")
        most = open_.agg(F.max("n")).first()[0]
        if most is None:
            break
        ranges = open_.select(F.col("g").alias("g_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_")).distinct()
        here = F.col("g").eqNullSafe(F.col("g_"))
        near = rows.join(ranges, here if whole else here & F.col("v").between(F.col("lo_"), F.col("hi_")))
        last = most <= FEW
        by = F.col("v").alias("class") if last else _bin(F.col("v"), F.col("lo_"), F.col("hi_"), scale).alias("class")
        counted = near.groupBy("g_", "lo_", "hi_", by).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("m").over(Window.partitionBy("g_", "lo_", "hi_").orderBy("class"))  # at most FEW or BINS + 3 rows
        counted = counted.withColumn("before", upto - F.col("m"))
        found = open_.join(counted, here & (F.col("lo") == F.col("lo_")) & (F.col("hi") == F.col("hi_")) & (F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("m")))
        found = found.select("g", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("m").alias("n"), one.alias("done"), "name", "side", (F.col("k") - F.col("before")).alias("k"), "part")
        wanted = wanted.filter("done").unionByName(found)
        if last:
            break
        wanted = cut(wanted, "places")
        scale, whole = lambda v: v, False
    aggregates = []
    for name in probabilities:
        of = lambda side, c: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(c)))  # noqa: B023, E731
        low, high = of("low", "lo"), of("high", "lo")
        aggregates.append(F.when(low == high, low).otherwise(low + (high - low) * of("low", "part")).alias(name))
    return wanted.groupBy(F.col("g").alias(group)).agg(*aggregates)
