"""What Python workers get at a time, and what they keep after encoding."""

import pyarrow as pa
from pyspark.sql import functions as F

from kilnflow.llm import token_files
from kilnflow.llm.common import cut
from kilnflow.llm.tokenizer_path import default_tokenizer
from kilnflow.sources.shared import BATCH_BYTES


def sizes(spark):
    """Rows and bytes of each batch of 20 MB in one partition."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = spark.range(0, 100, 1, 1).select(F.expr("repeat('x', 200000)").alias("text"))
    return cut(rows.mapInArrow(run, "n long, size long"), "sizes").collect()


def test_long_rows_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    got = sizes(spark)
    assert sum(r.n for r in got) == 100
    assert max(r.size for r in got) < 2 * BATCH_BYTES
    assert spark.conf.get(key, None) == before


def test_batches_that_the_session_sets_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1000000")
    try:
        got = sizes(spark)
        assert sum(r.n for r in got) == 100 and max(r.size for r in got) < 2_000_000
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)


def test_pieces_are_forgotten_after_encoding():
    token_files._encoder(default_tokenizer()).encode(["some words to remember"])
    assert token_files._encoder.cache_info().currsize == 1
    assert list(token_files._forgetting(iter([1, 2]))) == [1, 2]
    assert token_files._encoder.cache_info().currsize == 0
