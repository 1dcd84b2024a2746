"""Guarded aggregates: correlation, first-seen mode, casts of text to numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A number as text, the same in every engine.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def correlation(x: str, y: str, minimum_scale: float = 1e-12) -> Column:
    """Pearson correlation as an aggregate, clamped to [-1, 1]; 0 where either side is constant."""
    n = F.count("*").cast("double")
    sd = lambda c: F.stddev_pop(c)
    flat = (F.coalesce(sd(x), F.lit(0.0)) <= minimum_scale) | (F.coalesce(sd(y), F.lit(0.0)) <= minimum_scale)
    cov = F.covar_pop(x, y)
    safe = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(cov, sd(x) * sd(y)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(safe, F.lit(0.0)))))


def first_seen_mode(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """One row: the most frequent non-null value, the one seen first among equals, with its count and first id."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"), F.min(row_id).alias("_first"))
    return counts.orderBy(F.desc("_n"), F.asc("_first")).limit(1)


def is_number(text: Column) -> Column:
    """Whether text, without white space at its ends, is a number."""
    return F.regexp_like(stripped(text), F.lit(NUMBER))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
