"""Sorting, cohort filters, lineage, imputation and scaling, splits and leakage checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kilnflow.functions.ordering import exact_quantiles, with_positions
from kilnflow.functions.statistics import first_seen_mode
from kilnflow.operators.profile import numeric_columns
from kilnflow.sources.tables import ROW_ID

MISSING = "__MISSING__"
PARTITION = "_data_partition"


class RefusedError(ValueError):
    """An operator refuses its input; the message says why."""


def stable_sort(df: DataFrame, by: list[str], descending: list[bool] | bool = False, nulls_last: bool = True, row_id: str = ROW_ID) -> DataFrame:
    """Sort by several keys; the row id as the last key makes the sort stable."""
    if not by or len(set(by)) < len(by) or (missing := [c for c in by if c not in df.columns]):
        raise RefusedError(f"sort keys must be distinct columns: {by}")
    down = [descending] * len(by) if isinstance(descending, bool) else descending
    keys = [(F.col(c).desc_nulls_last() if nulls_last else F.col(c).desc_nulls_first()) if d else (F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first()) for c, d in zip(by, down, strict=True)]
    return df.orderBy(*keys, F.col(row_id))


def null_keys(df: DataFrame, by: list[str]) -> DataFrame:
    """(column_name, null_count) of the sort keys that have nulls."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in by])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in by])).alias("x")).select("x.*").filter("null_count > 0")


@dataclass(frozen=True)
class Range:
    """A numeric cohort: bounds that may be open, each inclusive or not."""

    column: str
    minimum: float | None = None
    maximum: float | None = None
    include_minimum: bool = True
    include_maximum: bool = True

    def condition(self) -> Column:
        c = F.col(f"`{self.column}`")
        out = c.isNotNull()
        if self.minimum is not None:
            out = out & (c >= self.minimum if self.include_minimum else c > self.minimum)
        if self.maximum is not None:
            out = out & (c <= self.maximum if self.include_maximum else c < self.maximum)
        return out


def cohort(df: DataFrame, keep: Range) -> DataFrame:
    """The rows within the range; nulls go."""
    if keep.column not in df.columns or keep.column not in numeric_columns(df):
        raise RefusedError(f"{keep.column} is no numeric column")
    return df.filter(keep.condition())


def cohort_counts(df: DataFrame, keep: Range) -> DataFrame:
    """One row: rows before, kept, left out, and left out for null."""
    inside = keep.condition()
    return df.agg(F.count("*").alias("source_rows"), F.count_if(inside).alias("retained_rows"), F.count_if(~inside).alias("excluded_rows"), F.count_if(F.col(f"`{keep.column}`").isNull()).alias("null_excluded_rows"))


def cohort_candidates(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(column_name): numeric columns with two or more distinct values, in table order with ``position``."""
    columns = [c for c in numeric_columns(df) if c not in ignore]
    ends = df.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"z_{c}") for c in columns])  # two values differ just when these do
    return ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), (F.col(f"a_{c}") < F.col(f"z_{c}")).alias("ok")) for i, c in enumerate(columns)])).alias("x")).select("x.*").filter("ok").drop("ok")


def observed_range(df: DataFrame, column: str) -> DataFrame:
    """One row: minimum and maximum; both null where the column has no values or one that isn't finite."""
    c = F.col(column).cast("double")
    odd = F.coalesce(F.bool_or(F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    return df.agg(F.when(~odd, F.min(c)).alias("minimum"), F.when(~odd, F.max(c)).alias("maximum"))


def removed_rows(raw: DataFrame, current: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Ids of raw rows that the current table no longer has."""
    return raw.select(row_id).join(current.select(row_id), row_id, "left_anti")


def lineage(raw: DataFrame, processed: DataFrame, order_by: list[Column], row_id: str = ROW_ID) -> DataFrame:
    """(_processed_row_index, row_id) of the processed rows in their order; refuses ids that the raw table doesn't have."""
    if not processed.select(row_id).join(raw.select(row_id), row_id, "left_anti").isEmpty():
        raise RefusedError("the processed table has row ids that the raw table doesn't have")
    return with_positions(processed.select(row_id, *[]), order_by, "_processed_row_index")


def impute_values(df: DataFrame, numeric: dict[str, str] | None = None, categorical: dict[str, str] | None = None, row_id: str = ROW_ID) -> dict[str, float | str | None]:
    """Fill values of columns by strategy: median, mean, most_frequent (first seen among equals) or constant. One row per column comes to the driver."""
    out: dict[str, float | str | None] = {}
    medians = [c for c, s in (numeric or {}).items() if s == "median"]
    means = [c for c, s in (numeric or {}).items() if s == "mean"]
    if medians:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in medians])).alias("x")).select("x.*")
        out |= {r.c: r.median for r in exact_quantiles(cells, "c", "v", {"median": 0.5}).collect()}
    if means:
        out |= df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict()
    for c in [c for c, s in ((numeric or {}) | (categorical or {})).items() if s == "most_frequent"]:
        row = first_seen_mode(df, c, row_id).first()
        out[c] = row[c] if row else None
    return out | {c: MISSING for c, s in (categorical or {}).items() if s == "constant"}


def impute(df: DataFrame, values: dict[str, float | str | None]) -> DataFrame:
    """Fill nulls with fitted values."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if isinstance(v, float) else F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def scaling(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """(column_name, center, scale). Standard: mean and population deviation; robust: median and quartile distance by nearest values. A zero scale becomes 1."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    if method == "standard":
        fitted = cells.groupBy("column_name").agg(F.avg("v").alias("center"), F.stddev_pop("v").alias("scale"))
    else:
        linear = exact_quantiles(cells, "column_name", "v", {"center": 0.5})
        near = exact_quantiles(cells, "column_name", "v", {"q1": 0.25, "q3": 0.75}, "nearest")
        fitted = linear.join(near, "column_name").select("column_name", "center", (F.col("q3") - F.col("q1")).alias("scale"))
    return fitted.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def scale(df: DataFrame, fitted: DataFrame) -> DataFrame:
    rows = {r.column_name: r for r in fitted.collect()}  # a row per column
    return df.withColumns({c: (F.col(c) - F.lit(r.center)) / F.lit(r.scale) for c, r in rows.items()})


def _labels(position: Column, n: Column, test: float, validation: float) -> Column:
    n_test, n_validation = F.ceil(n * test), F.ceil(n * validation)
    return F.when(position < n - n_test - n_validation, "train").when(position < n - n_test, "validation").otherwise("test")


def split_time(df: DataFrame, order_by: list[Column], test: float = 0.2, validation: float = 0.2) -> DataFrame:
    """``df`` with its partition: the last ceil(n * test) rows in order are test, those before validation, the rest train."""
    placed = with_positions(df, order_by, "_place")
    total = placed.agg(F.count("*").alias("_n"))
    return placed.crossJoin(F.broadcast(total)).withColumn(PARTITION, _labels(F.col("_place"), F.col("_n"), test, validation)).drop("_n")  # one row


def split_group(df: DataFrame, group: str, test: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with its partition; all rows of a group share it. Groups are ordered by a hash: test first, then validation, then train."""
    groups = with_positions(df.select(group).distinct(), [F.xxhash64(F.lit(seed), group), F.col(group)], "_g")
    total = groups.agg(F.count("*").alias("_n"))
    named = groups.crossJoin(F.broadcast(total)).select(F.col(group).alias("_group"), F.when(F.col("_g") < F.ceil(F.col("_n") * test), "test").when(F.col("_g") < F.ceil(F.col("_n") * test) + F.ceil(F.col("_n") * validation), "validation").otherwise("train").alias(PARTITION))
    return df.join(named, df[group].eqNullSafe(named["_group"])).drop("_group")


def permuted_groups(spark: SparkSession, groups: list, seed: int = 42, test: float = 0.2, validation: float = 0.2) -> DataFrame:
    """(group, partition) by the PCG64 permutation of a group list that the caller holds, in first-seen order."""
    order = np.random.default_rng(seed).permutation(len(groups))
    n_test, n_validation = int(np.ceil(len(groups) * test)), int(np.ceil(len(groups) * validation))
    label = lambda k: "test" if k < n_test else "validation" if k < n_test + n_validation else "train"
    return spark.createDataFrame([(groups[int(g)], label(k)) for k, g in enumerate(order)], f"group string, {PARTITION} string")


def split_random(df: DataFrame, row_id: str = ROW_ID, test: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with its partition by the order of a hash of the row id."""
    return split_time(df, [F.xxhash64(F.lit(seed), row_id), F.col(row_id)], test, validation)


def partition_summary(df: DataFrame, key: str | None = None) -> DataFrame:
    """(partition, n_rows, fraction[, min_key, max_key]) with fractions to six digits."""
    extra = [F.min(key).alias("min_key"), F.max(key).alias("max_key")] if key else []
    total = df.agg(F.count("*").alias("_n"))
    sums = df.groupBy(PARTITION).agg(F.count("*").alias("n_rows"), *extra)
    return sums.crossJoin(F.broadcast(total)).withColumn("fraction", F.round(F.col("n_rows") / F.col("_n"), 6)).drop("_n")


def shared_keys(df: DataFrame, key: str) -> DataFrame:
    """(left, right, n_shared): how many keys two partitions share, a leak if any."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(PARTITION)).alias("p")).filter(F.size("p") > 1)  # three partitions at most
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return sets.select(F.explode(pairs).alias("x")).groupBy("x.left", "x.right").agg(F.count("*").alias("n_shared"))


def time_order(df: DataFrame, key: str) -> DataFrame:
    """One row: whether train ends after validation starts, or validation after test starts; equal bounds are only a tie."""
    ends = df.agg(*[f(F.when(F.col(PARTITION) == p, F.col(key))).alias(f"{n}_{p}") for p in ("train", "validation", "test") for n, f in (("min", F.min), ("max", F.max))])
    after = lambda a, b: F.coalesce(F.col(f"max_{a}") > F.col(f"min_{b}"), F.lit(False))
    tie = lambda a, b: F.coalesce(F.col(f"max_{a}") == F.col(f"min_{b}"), F.lit(False))
    return ends.select((after("train", "validation") | after("validation", "test") | after("train", "test")).alias("violated"), (tie("train", "validation") | tie("validation", "test")).alias("boundary_tie"))


def union_relaxed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, columns by name; a column of two types gets the wider one, text where none holds both, and one that a side lacks is null there."""
    kinds, other = dict(a.dtypes), dict(b.dtypes)
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def wider(x: str, y: str) -> str:
        if x == y:
            return x
        if x in numbers and y in numbers:
            return "double" if "float" in (x, y) else numbers[max(numbers.index(x), numbers.index(y))]
        return "double" if {x, y} <= {*numbers} | {k for k in (x, y) if k.startswith("decimal")} else "string"

    types = {c: wider(kinds.get(c, other.get(c)), other.get(c, kinds.get(c))) for c in [*kinds, *[c for c in other if c not in kinds]]}
    side = lambda df, own: df.select(*[(F.col(f"`{c}`") if c in own else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    return side(a, kinds).unionByName(side(b, other))


def same_sequence(a: DataFrame, order_a: list[Column], b: DataFrame, order_b: list[Column], row_id: str = ROW_ID) -> DataFrame:
    """One row: sizes of two ordered lists of ids, the places where they differ (nulls are equal, a missing place differs), and whether they are the same."""
    left = with_positions(a, order_a, "_place").select("_place", F.col(row_id).alias("_a"), F.lit(True).alias("_in_a"))
    right = with_positions(b, order_b, "_place").select("_place", F.col(row_id).alias("_b"), F.lit(True).alias("_in_b"))
    both = left.join(right, "_place", "full_outer")
    differs = F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return both.agg(F.count("_in_a").alias("n_left"), F.count("_in_b").alias("n_right"), F.count_if(differs).alias("n_different")).withColumn("same", F.col("n_different") == 0)


def first_seen(df: DataFrame, text: str, position: str, most: int = 200) -> DataFrame:
    """Each distinct text with its first place and number of occurrences, the first ``most`` in order; the limit is the report's."""
    return df.groupBy(text).agg(F.min(position).alias("first_place"), F.count("*").alias("occurrences")).orderBy("first_place").limit(most)


def check_split(df: DataFrame, minimum: dict[str, int] | None = None) -> None:
    """Refuse a split that leaves a partition too few rows."""
    sizes = {r[PARTITION]: r["count"] for r in df.groupBy(PARTITION).count().collect()}
    for name, least in (minimum or {"train": 2, "validation": 1, "test": 1}).items():
        if sizes.get(name, 0) < least:
            raise RefusedError(f"{name} has {sizes.get(name, 0)} rows; it needs {least}")
