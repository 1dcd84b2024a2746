"""Column profiles, validation checks and the data quality score.

Columns are unpivoted, so that a table of any width is profiled in one pass
with partial aggregation and one shuffle by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType, StringType

from kilnflow.functions.statistics import is_number, stripped

#: Penalty per severity, multiplier and dimension per issue.
SEVERITY_WEIGHTS = {"ERROR": 20.0, "WARNING": 8.0, "INFO": 2.0}
ISSUES = {
    "EMPTY_DATASET": (5.0, "COMPLETENESS"),
    "DUPLICATE_ROWS": (1.0, "UNIQUENESS"),
    "ALL_NULL_COLUMN": (1.5, "COMPLETENESS"),
    "HIGH_MISSING_RATIO": (1.0, "COMPLETENESS"),
    "CONSTANT_COLUMN": (0.75, "VARIABILITY"),
    "NEAR_CONSTANT_COLUMN": (0.5, "VARIABILITY"),
    "NAN_VALUES": (1.0, "VALIDITY"),
    "INFINITE_VALUES": (1.5, "VALIDITY"),
    "NUMERIC_STRING_COLUMN": (0.75, "VALIDITY"),
}
MAX_MISSING, MAX_FREQUENCY, MIN_NUMERIC_TEXT = 0.30, 0.95, 0.80


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; Boolean ones are not."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, text, number): a row per row and column; number is null for columns that aren't numeric."""
    numeric = set(numeric_columns(df))
    cell = lambda c: F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("text"), (F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"))
    return df.select(F.explode(F.array(*map(cell, columns))).alias("x")).select("x.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, text, number, n) of each distinct value, null among them."""
    return unpivot(df, columns).groupBy("column_name", "text", "number").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: counts, ratios, distinct values with null as one, constancy, and min, max and mean of numeric ones.

    An empty table gives no rows.
    """
    counts = value_counts(df, columns or df.columns)
    stats = counts.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("*").alias("unique_count"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
        F.try_divide(F.sum(F.col("number") * F.col("n")), F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias("mean_value"),
    )
    return stats.select(
        "column_name", "row_count", "null_count", (F.col("null_count") / F.col("row_count")).alias("null_ratio"), "unique_count",
        (F.col("unique_count") / F.col("row_count")).alias("cardinality_ratio"), (F.col("unique_count") <= 1).alias("is_constant"), "min_value", "max_value", "mean_value",
    )


def preview(df: DataFrame, row_id: str, rows: int = 20) -> DataFrame:
    """The first rows by ``row_id``, without it, in that order: a top-k, so no sort of the table."""
    if rows < 1:
        raise ValueError("rows must be at least 1")
    return df.orderBy(F.col(row_id)).limit(rows).drop(row_id)


def samples(df: DataFrame, row_id: str, values: int = 5) -> DataFrame:
    """(column_name, place, value): the first values of each column by ``row_id``, as text, nulls among them; no rows for an empty table."""
    if values < 1:
        raise ValueError("values must be at least 1")
    columns = [c for c in df.columns if c != row_id]
    first = df.orderBy(F.col(row_id)).limit(values)
    numbered = first.select("*", F.row_number().over(Window.orderBy(row_id)).alias("_place"))  # `values` rows
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_place").alias("place"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return numbered.select(F.explode(cells).alias("x")).select("x.*")


def duplicate_excess(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row: rows, distinct rows (nulls equal) and the excess, over all columns but ``ignore``."""
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ignore]
    groups = df.groupBy(*columns).agg(F.count("*").alias("_rows_"))
    return groups.agg(F.coalesce(F.sum("_rows_"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("excess", F.col("n_rows") - F.col("n_distinct"))


def _weighted(df: DataFrame, severity: Column, issue: Column) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv])
    factor = F.create_map(*[F.lit(x) for k, v in ISSUES.items() for x in (k, v[0])])
    dimension = F.create_map(*[F.lit(x) for k, v in ISSUES.items() for x in (k, v[1])])
    return df.withColumn("severity", severity).withColumn("issue_type", issue).withColumn("dimension", dimension[F.col("issue_type")]).withColumn("penalty", F.round(weight[F.col("severity")] * factor[F.col("issue_type")], 2))


def validate(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, issue_type, severity, ratio): the checks that a table's columns don't pass; duplicates have no column.

    An all-null column gets that issue alone. NaN and infinities are looked for
    in floating columns, numbers as text in string columns.
    """
    columns = [c for c in df.columns if c not in ignore]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    floats = [c for c in columns if isinstance(kinds[c], (FloatType, DoubleType))]
    texts = [c for c in columns if isinstance(kinds[c], StringType)]
    counts = value_counts(df, columns)
    number, n = F.col("number"), F.col("n")
    valid = F.col("text").isNotNull() & (stripped(F.col("text")) != "")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    stats = counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"), of(F.col("text").isNull()).alias("nulls"), F.count("text").alias("distinct_"), F.max(F.when(F.col("text").isNotNull(), n)).alias("most"),
        of(F.isnan(number)).alias("nans"), of(F.abs(number) == float("inf")).alias("infs"), of(valid).alias("filled"), of(valid & is_number(F.col("text"))).alias("numbers"),
    )
    stats = stats.withColumn("present", F.col("rows") - F.col("nulls"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    some, none = F.col("present") > 0, F.col("present") == 0
    issue = lambda cond, kind, severity, r: F.when(cond, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), r.alias("ratio")))
    in_ = lambda names: F.col("column_name").isin(names) if names else F.lit(False)
    found = F.array_compact(F.array(
        issue(none, "ALL_NULL_COLUMN", "ERROR", ratio("nulls", "rows")),
        issue(some & (ratio("nulls", "rows") >= MAX_MISSING), "HIGH_MISSING_RATIO", "WARNING", ratio("nulls", "rows")),
        issue(some & (F.col("distinct_") == 1), "CONSTANT_COLUMN", "WARNING", F.lit(1.0)),
        issue(some & (F.col("distinct_") > 1) & (ratio("most", "present") >= MAX_FREQUENCY), "NEAR_CONSTANT_COLUMN", "INFO", ratio("most", "present")),
        issue(in_(floats) & (F.col("nans") > 0), "NAN_VALUES", "WARNING", ratio("nans", "rows")),
        issue(in_(floats) & (F.col("infs") > 0), "INFINITE_VALUES", "ERROR", ratio("infs", "rows")),
        issue(in_(texts) & (F.col("filled") > 0) & (ratio("numbers", "filled") >= MIN_NUMERIC_TEXT), "NUMERIC_STRING_COLUMN", "INFO", ratio("numbers", "filled")),
    ))
    per_column = stats.select("column_name", F.explode(found).alias("x")).select("column_name", "x.*")
    excess = duplicate_excess(df, ignore)
    whole = excess.select(F.lit(None).cast("string").alias("column_name"), F.when(F.col("n_rows") == 0, F.lit("EMPTY_DATASET")).when(F.col("excess") > 0, F.lit("DUPLICATE_ROWS")).alias("issue_type"), F.when(F.col("n_rows") == 0, F.lit("ERROR")).otherwise(F.lit("WARNING")).alias("severity"), F.try_divide(F.col("excess").cast("double"), F.col("n_rows").cast("double")).alias("ratio")).filter("issue_type IS NOT NULL")
    return per_column.unionByName(whole)


def quality_score(issues: DataFrame) -> DataFrame:
    """One row: the score from 100 down by the rounded penalties of (issue_type, severity), and counts."""
    scored = _weighted(issues, F.col("severity"), F.col("issue_type"))
    return scored.agg(
        F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum("penalty"), F.lit(0.0))).alias("score"),
        F.coalesce(F.sum("penalty"), F.lit(0.0)).alias("total_penalty"),
        F.count("*").alias("n_issues"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITY_WEIGHTS],
        *[F.coalesce(F.sum(F.when(F.col("dimension") == d, F.col("penalty"))), F.lit(0.0)).alias(f"{d.lower()}_penalty") for d in ("COMPLETENESS", "UNIQUENESS", "VALIDITY", "VARIABILITY")],
    )


def target_suitability(df: DataFrame, target: str) -> DataFrame:
    """One row: counts of a regression target and the first reason to refuse it: all null, constant, not numeric."""
    numeric = target in numeric_columns(df)
    c = F.col(f"`{target}`")
    counts = df.agg(F.count("*").alias("row_count"), F.count(c).alias("non_null_count"), F.count_distinct(c).alias("distinct_count"))
    code = F.when(F.col("non_null_count") == 0, "TARGET_ALL_NULL").when(F.col("distinct_count") <= 1, "TARGET_CONSTANT").when(~F.lit(numeric), "TARGET_NOT_NUMERIC")
    return counts.withColumn("refusal_code", code).withColumn("suitable", F.col("refusal_code").isNull())


def column_suggestions(df: DataFrame, order_by: str) -> DataFrame:
    """(column_name, non_decreasing): whether each numeric column never falls in the order of a unique key."""

    # Each row's predecessor by position: an equi-join instead of a window over the whole table.
    from kilnflow.functions.ordering import with_positions

    columns = [c for c in numeric_columns(df) if c != order_by]
    placed = with_positions(df.select(order_by, *columns), [F.col(order_by)])
    buckets = Window.partitionBy(F.floor(F.col("_position") / 4096)).orderBy("_position")
    inner = placed.select("_position", *[F.coalesce(F.col(c) >= F.lag(c).over(buckets), F.lit(True)).alias(c) for c in columns])
    firsts = placed.filter(F.col("_position") % 4096 == 0).select(F.col("_position").alias("p"), *[F.col(c).alias(f"f_{c}") for c in columns])
    lasts = placed.select((F.col("_position") + 1).alias("p"), *[F.col(c).alias(f"l_{c}") for c in columns]).filter(F.col("p") % 4096 == 0)
    edges = firsts.join(lasts, "p").select(F.col("p").alias("_position"), *[(F.col(f"f_{c}") >= F.col(f"l_{c}")).alias(c) for c in columns])
    verdict = inner.unionByName(edges).agg(*[F.bool_and(c).alias(c) for c in columns])
    return verdict.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_decreasing")) for c in columns])).alias("x")).select("x.*")


def identifier_choice(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, chosen): whether a column has two different values or more, nulls aside; from its ends, without counting distinct values."""
    kinds = dict(df.dtypes)
    ends = lambda c: F.lit(False) if kinds[c] == "void" else F.coalesce(F.min(c) < F.max(c), F.lit(False))
    one = df.agg(*[ends(c).alias(f"e{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"e{i}").alias("chosen")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("x")).select("x.*")
