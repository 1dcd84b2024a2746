"""Column suggestions: every rule, orders over several partitions, odd tables, users' own names."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kilnflow.operators import suggestions as sg

N = 100


def table(spark):
    """A hundred rows with a column for each rule."""
    x = F.col("id")
    return spark.range(0, N, 1, 4).select(
        x.cast("string").alias("Lot_ID"), F.when(x < 96, x).otherwise(F.lit(0)).alias("batch"), (x % 7).alias("device-id"), F.lit(5).alias("wafer"), F.lit(None).cast("string").alias("serial"), F.array(x).alias("sample"),
        F.lit(None).cast("double").alias("empty"), F.array(x).alias("list"), x.alias("cycle time"), (-x).alias("time"), F.lit("2024").alias("Date"), F.lit(1.0).alias("Quality_Score"), (x % 3).alias("yield"), F.lit("q").alias("outcome"),
        F.lit(3).alias("same"), (x % 2 == 0).alias("flag"), F.concat(F.lit("t"), x % 30).alias("text"), (x % 9).alias("code"), (x * 1.5).alias("wide"), F.sqrt((x % 50).cast("double")).alias("sensor"), F.when(x > 0, x % 40).alias("gappy"),
    )


WANT = {
    "Lot_ID": (sg.IDENTIFIER, 50, 0.95), "batch": (sg.IDENTIFIER, 50, 0.90), "device-id": (sg.IDENTIFIER, 50, 0.70), "wafer": (sg.REVIEW, 20, 0.70), "serial": (sg.REVIEW, 20, 0.70), "sample": (sg.REVIEW, 20, 0.70),
    "empty": (sg.EXCLUDED, 0, 0.95), "list": (sg.EXCLUDED, 0, 0.95), "cycle time": (sg.TIMESTAMP, 50, 0.80), "time": (sg.TIMESTAMP, 50, 0.70), "Date": (sg.TIMESTAMP, 50, 0.55), "Quality_Score": (sg.TARGET, 90, 0.95), "yield": (sg.TARGET, 60, 0.85), "outcome": (sg.TARGET, 70, 0.90),
    "same": (sg.EXCLUDED, 0, 0.95), "flag": (sg.REVIEW, 10, 0.60), "text": (sg.EXCLUDED, 0, 0.85), "code": (sg.REVIEW, 5, 0.55), "wide": (sg.REVIEW, 5, 0.50), "sensor": (sg.FEATURE, 1, 0.75), "gappy": (sg.FEATURE, 1, 0.75),
}


@pytest.fixture(scope="module")
def suggested(spark):
    small = spark.createDataFrame([(i, float(i % 2)) for i in range(5)], "a long, soh double")
    return sg.suggest(sg.column_facts({"t": table(spark), "small": small, "none": small.limit(0)})).cache()


def test_every_rule(suggested):
    rows = {r.column_name: r for r in suggested.filter("table_name = 't'").collect()}
    assert {c: (r.category, r.priority, round(r.confidence, 9)) for c, r in rows.items()} == WANT
    assert [c for c in WANT if rows[c].constant] == ["wafer", "Date", "Quality_Score", "outcome", "same"]
    assert (rows["gappy"].null_count, rows["gappy"].unique_count, rows["empty"].unique_count) == (1, 41, 1)
    assert [c for c in WANT if rows[c].suitable_as_target] == ["batch", "device-id", "cycle time", "time", "yield", "code", "wide", "sensor", "gappy"]
    assert [c for c in WANT if rows[c].non_decreasing] == ["wafer", "cycle time", "Quality_Score", "same", "wide"] and rows["empty"].non_decreasing is None


def test_small_and_empty_tables(suggested):
    got = {(r.table_name, r.column_name): (r.category, r.row_count) for r in suggested.filter("table_name <> 't'").collect()}
    assert got == {("small", "a"): (sg.FEATURE, 5), ("small", "soh"): (sg.TARGET, 5), ("none", "a"): (sg.EXCLUDED, 0), ("none", "soh"): (sg.EXCLUDED, 0)}


def test_configuration_and_active_features(spark, suggested):
    conf = sg.configuration(suggested.filter("table_name = 't'"))
    lists = {}
    for r in conf.orderBy("list", "rank").collect():
        lists.setdefault(r.list, []).append(r.column_name)
    assert lists["TARGETS"] == ["Quality_Score", "outcome", "yield"] and lists["FEATURES"] == ["sensor", "gappy"] and lists["IDENTIFIERS"] == ["Lot_ID", "batch", "device-id"]
    assert lists["EXCLUDED"] == ["empty", "list", "same", "text"] and sum(map(len, lists.values())) == len(WANT)
    chosen = spark.createDataFrame([("t", "sensor"), ("t", "sensor"), ("other", "gappy"), (None, "gappy")], "table_name string, column_name string")
    assert [(r["rank"], r.column_name) for r in sg.active_features(conf, chosen).collect()] == [(2, "gappy")]
    assert {tuple(r) for r in sg.warnings(suggested).collect()} == {("t", "CONSTANT_IDENTIFIER", "wafer"), ("none", "NO_TARGET", None), ("none", "NO_FEATURE", None)}


def test_own_names(spark):
    facts = sg.column_facts({"t": table(spark).select("sensor", "time", "code")}, order=False)
    own = spark.createDataFrame([("Sensor", "TARGET", 99), ("TIME", "IDENTIFIER", 1), ("co_de", "TARGET", 30), ("code", "TIMESTAMP", 1)], "name string, kind string, priority int")
    got = {r.column_name: (r.category, r.priority, r.confidence) for r in sg.suggest(facts, own).collect()}
    assert got == {"sensor": (sg.TARGET, 99, 0.95), "time": (sg.IDENTIFIER, 50, 0.95), "code": (sg.TIMESTAMP, 50, 0.70)}


def test_orders(spark):
    big = 2**60
    rows = [(None, float("nan"), big, Decimal("1.5")), (1.0, None, big + 1, Decimal("1.5")), (None, 1.0, None, Decimal("0.5")), (1.0, 2.0, big + 2, None)]
    df = spark.createDataFrame(rows, "a double, b double, c long, d decimal(5,1)")
    for parts in (df.coalesce(1), df.repartitionByRange(4, F.coalesce("c", F.lit(big + 1)) * 1)):
        got = {r.column_name: r.non_decreasing for r in sg.never_falls(parts).collect()}
        assert got["a"] is True and got["c"] is True
    assert {r.column_name: r.non_decreasing for r in sg.never_falls(df.coalesce(1)).collect()} == {"a": True, "b": False, "c": True, "d": False}
    # Falls between partitions alone, with partitions that hold no value.
    steps = spark.range(0, 40, 1, 8)
    t = steps.select(F.when(F.col("id") < 20, F.col("id")).otherwise(F.col("id") - 19).alias("edge"), F.when(F.col("id").isin(2, 39), F.col("id")).alias("rare"), (F.col("id") / 5).cast("int").alias("steps"), F.when(F.col("id").isin(2, 39), -F.col("id")).alias("fall"))
    assert {r.column_name: r.non_decreasing for r in sg.never_falls(t).collect()} == {"edge": False, "rare": True, "steps": True, "fall": False}
    assert sg.never_falls(steps.select(F.lit("x").alias("s"))).count() == 0


def test_long_texts_and_odd_values(spark):
    rows = [("a" * 50, b"\x00", {"k": 1}, [None]), ("a" * 49 + "b", b"\x01", {"k": 2}, [0]), ("a" * 50, b"\x00", {"k": 1}, [None]), (None, None, None, None), ("", b"", {}, [])]
    df = spark.createDataFrame(rows, "s string, b binary, m map<string,int>, l array<int>")
    assert {r.column_name: (r.null_count, r.unique_count) for r in sg.column_facts({"x": df}).collect()} == {c: (1, 4) for c in ("s", "b", "m", "l")}
    with pytest.raises(ValueError):
        sg.column_facts({})
