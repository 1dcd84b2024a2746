"""Leakage of a split and of a choice of features, as one table of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnflow.operators.prepare import PARTITION
from kilnflow.operators.routing import tokens_of

#: Words of a name that give it away.
DERIVED_TOKENS = ("actual", "observed", "residual", "error", "difference", "delta", "future", "next")
FUTURE_TOKENS = ("future", "next", "lead", "post", "after")
OUTCOME_TOKENS = ("outcome", "failure", "completion", "completed", "end", "result")
TEMPORAL_TOKENS = ("time", "timestamp", "date", "datetime")
#: Issues in the order of a report. The scope of a fit may be unknown, which only warns.
ISSUES = (
    "ORIGINAL_ROW_ID_OVERLAP", "SPLIT_SUMMARY_MISMATCH", "GROUP_PARTITION_OVERLAP", "TIME_ORDER_VIOLATION", "TARGET_INCLUDED_AS_FEATURE", "IDENTIFIER_INCLUDED_AS_FEATURE",
    "TARGET_DERIVED_FEATURE", "FUTURE_DERIVED_FEATURE", "OUTCOME_TIMESTAMP_FEATURE", "PREPROCESSING_FIT_SCOPE_UNKNOWN", "PREPROCESSING_NOT_FIT_ON_TRAINING_DATA",
)
WARNINGS = ("PREPROCESSING_FIT_SCOPE_UNKNOWN",)
_PARTS = ("train", "validation", "test")


class LeakageError(ValueError):
    """A report has blockers."""


def name_issues(features: DataFrame, target: str | None = None) -> DataFrame:
    """``features``: (feature, role or null). A row (issue, feature) for each rule that a feature's name or role breaks.

    A feature is the target; is an identifier (by role, or the row id); holds
    all words of the target's name and one that tells a derived value; holds a
    word of the future; or holds one of an outcome and one of time. Words are
    compared whole, in lower case. Features are repeated by as many rules.
    """
    words = tokens_of(F.col("feature"))
    holds = lambda listed: F.arrays_overlap(words, F.array(*map(F.lit, listed)))
    goal = F.lit(target).cast("string")
    goal_words = tokens_of(goal)
    derived = (F.col("feature") != goal) & (F.size(goal_words) > 0) & (F.size(F.array_except(goal_words, words)) == 0) & holds(DERIVED_TOKENS)
    rules: list[tuple[str, Column]] = [
        ("TARGET_INCLUDED_AS_FEATURE", F.col("feature") == goal),
        ("IDENTIFIER_INCLUDED_AS_FEATURE", (F.col("role") == "IDENTIFIER") | (F.col("feature") == "_original_row_id")),
        ("TARGET_DERIVED_FEATURE", derived),
        ("FUTURE_DERIVED_FEATURE", holds(FUTURE_TOKENS)),
        ("OUTCOME_TIMESTAMP_FEATURE", holds(OUTCOME_TOKENS) & holds(TEMPORAL_TOKENS)),
    ]
    return features.select("feature", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules]))).alias("issue")).select("issue", "feature")


def _overlap(df: DataFrame, key: str, issue: str) -> DataFrame:
    """One row (issue, columns, partitions) if a key is in several partitions, with those partitions; else none. Null keys don't count."""
    own = [F.max((F.col(PARTITION) == p).cast("int")).alias(p) for p in _PARTS]
    shared = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*own).filter(" + ".join(_PARTS) + " > 1")
    found = shared.agg(*[F.coalesce(F.max(p), F.lit(0)).alias(p) for p in _PARTS])
    parts = F.array_compact(F.array(*[F.when(F.col(p) == 1, F.lit(p)) for p in _PARTS]))
    return found.select(F.lit(issue).alias("issue"), F.array(F.lit(key)).alias("columns"), parts.alias("partitions")).filter("size(partitions) > 0")


def _time_order(df: DataFrame, key: str) -> DataFrame:
    """One row if an earlier partition ends after a later one starts. Equal times are allowed."""
    ends = df.agg(*[f(F.when(F.col(PARTITION) == p, F.col(key))).alias(f"{n}_{p}") for p in _PARTS for n, f in (("lo", F.min), ("hi", F.max))])
    after = lambda a, b: F.coalesce(F.col(f"hi_{a}") > F.col(f"lo_{b}"), F.lit(False))
    ordered = F.col("lo_validation").isNotNull()
    first, second, only = ordered & after("train", "validation"), ordered & after("validation", "test"), ~ordered & after("train", "test")
    parts = F.array_compact(F.array(F.when(first | only, F.lit("train")), F.when(first | second, F.lit("validation")), F.when(second | only, F.lit("test"))))
    return ends.select(F.lit("TIME_ORDER_VIOLATION").alias("issue"), F.array(F.lit(key)).alias("columns"), parts.alias("partitions")).filter("size(partitions) > 0")


def _summary_mismatch(df: DataFrame, key: str, summary: DataFrame) -> DataFrame:
    """One row if the ids of a partition, by count and hash, aren't those that the split's ``summary`` (partition, id) lists."""
    digest = lambda rows, part, k: rows.groupBy(F.col(part).alias("p")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(k)).alias("x"), F.sum(F.xxhash64(F.lit(1), k).cast("decimal(38,0)")).alias("s"))
    both = digest(df, PARTITION, F.col(key)).alias("a").join(digest(summary, PARTITION, F.col(key)).alias("b"), F.col("a.p") == F.col("b.p"), "full_outer")
    wrong = both.filter(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.s").eqNullSafe(F.col("b.s"))))
    parts = wrong.agg(F.collect_set(F.coalesce("a.p", "b.p")).alias("p"))  # partitions
    listed = F.array_compact(F.array(*[F.when(F.array_contains("p", x), F.lit(x)) for x in _PARTS]))
    return parts.filter("size(p) > 0").select(F.lit("SPLIT_SUMMARY_MISMATCH").alias("issue"), F.array(F.lit(key)).alias("columns"), listed.alias("partitions"))


def check(df: DataFrame, row_id: str, features: DataFrame, target: str | None = None, group: str | None = None, time: str | None = None, steps: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """The report: (place, issue, severity, columns, partitions), in the order of ISSUES and then of columns.

    ``df`` is a split table; ``features``: (feature, role or null); ``steps``:
    (columns, on_train or null) of preprocessing that fits statistics;
    ``summary``: (partition, id) as the split was announced. ``group`` and
    ``time`` are checked where given. An empty report means a safe split.
    """
    found = [_overlap(df, row_id, "ORIGINAL_ROW_ID_OVERLAP")]
    if summary is not None:
        found.append(_summary_mismatch(df, row_id, summary))
    if group:
        found.append(_overlap(df, group, "GROUP_PARTITION_OVERLAP"))
    if time:
        found.append(_time_order(df, time))
    names = name_issues(features, target)
    found.append(names.select("issue", F.array("feature").alias("columns"), F.array().cast("array<string>").alias("partitions")))
    if steps is not None:
        scope = F.when(F.col("on_train").isNull(), F.lit(ISSUES[9])).when(~F.col("on_train"), F.lit(ISSUES[10]))
        found.append(steps.select(scope.alias("issue"), "columns", F.array(*map(F.lit, _PARTS)).alias("partitions")).filter("issue IS NOT NULL"))
    issues = reduce(DataFrame.unionByName, found)
    rank = F.array_position(F.array(*map(F.lit, ISSUES)), F.col("issue"))
    severity = F.when(F.col("issue").isin(*WARNINGS), "WARNING").otherwise("BLOCKER")
    place = F.row_number().over(Window.orderBy(rank, "columns"))  # a row per issue: as many as features and steps
    return issues.select(place.alias("place"), "issue", severity.alias("severity"), "columns", "partitions")


def assert_safe(report: DataFrame) -> None:
    """Raise LeakageError with the number and kinds of blockers, if there are any."""
    kinds = report.filter("severity = 'BLOCKER'").groupBy("issue").agg(F.count("*").alias("n"), F.min("place").alias("place")).orderBy("place").collect()
    if kinds:
        raise LeakageError(f"{sum(r.n for r in kinds)} leakage blockers: {', '.join(r.issue for r in kinds)}")
