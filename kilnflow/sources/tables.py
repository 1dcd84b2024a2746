"""Table scans with a dense row id, and sinks."""

from __future__ import annotations

import hashlib
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from kilnflow.functions.ordering import in_file_order, with_positions

ROW_ID = "_original_row_id"
SUFFIXES = (".csv", ".parquet", ".xlsx")


class TableError(ValueError):
    """A table can't be loaded as asked: no such path, an unknown suffix or a reserved column."""


def scan(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV (with header; types from the whole file unless ``schema`` is given), Parquet or XLSX table by its suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise TableError(f"unknown suffix {suffix!r}; known are {', '.join(SUFFIXES)}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise TableError(f"no such table: {path}")
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True).option("samplingRatio", 1.0)).csv(path)
    import pandas as pd  # the first sheet of a workbook, which one task can hold; needs openpyxl

    return spark.createDataFrame(pd.read_excel(path))


def with_row_id(df: DataFrame, order_by: list[Column] | None = None) -> DataFrame:
    """``df`` with ROW_ID, 0 to n - 1 in the given total order (in file order without one)."""
    if ROW_ID in df.columns:
        raise TableError(f"{ROW_ID} is reserved and already a column")
    if order_by:
        return with_positions(df, order_by, ROW_ID)
    return in_file_order(df, ROW_ID)


def load(spark: SparkSession, path: str, order_by: list[Column] | None = None) -> DataFrame:
    return with_row_id(scan(spark, path), order_by)


def from_csv_bytes(spark: SparkSession, content: bytes, preview: int = 20) -> tuple[DataFrame, list]:
    """A table from an uploaded CSV's bytes, and its first rows."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(spark.sparkContext.parallelize(content.decode("utf-8-sig").splitlines(), 1))
    return df, df.limit(preview).collect()


def write_workflow_csv(df: DataFrame, path: str, timestamp: str = "timestamp") -> None:
    """CSV with the timestamp as seconds since 1970, which a split by time needs."""
    df.withColumn(timestamp, epoch_seconds(F.col(timestamp))).write.option("header", True).mode("overwrite").csv(path)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def content_fingerprint(path: str, chunk: int = 1 << 20) -> str:
    """SHA-256 of one local file's bytes, a chunk at a time."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(chunk):
            digest.update(data)
    return digest.hexdigest()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows, and an exclusive-or and a sum over row hashes; the same for any order and partitioning."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("hash_xor"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"))
