"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again.

Stages take (spark, docs, sf_dir). All but the last return the columns of
``documents``: documents that fail the quality rules go, then near-duplicates
but one of each group, then documents that hold a benchmark item; what is left
is mixed to the sources' targets (a document may come twice) and encoded as
token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilnflow.llm import decontaminate, mixing, quality_rules, simhash, token_files
from kilnflow.llm.common import cut, mark, new_path, release, table
from kilnflow.llm.tokenizer_path import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_blocks(docs, default_tokenizer(), path)
    return token_files.read_documents(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("mixing", mixture),
    ("token files", tokens),
]

#: SQL can't express the fingerprints and the encoding; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows: doc_id, start, n_tokens, ids_crc32.

    Null ids and texts, repeated rows and ties are handled as each stage says;
    an empty table gives an empty result. When a stage is written, the tables
    made for it and the stage before are deleted.
    """
    docs, began = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        release(began, newest=1)
    return STAGES[-1][1](spark, docs, sf_dir)
