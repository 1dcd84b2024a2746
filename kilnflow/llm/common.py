"""What the training-data operators share: words of texts, tables by name; and, from the engine, tables written to cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kilnflow.sources.shared import cut, mark, new_path, release, shared_dir, small_batches

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as one class and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The array of words of a text; empty for null or white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def n_words(text: Column) -> Column:
    """The number of words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["SPACE", "SPACE_CHARS", "WORD", "cut", "mark", "n_words", "new_path", "partitions", "release", "shared_dir", "small_batches", "table", "words"]
