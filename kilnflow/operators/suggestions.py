"""What each column of many tables may be used for, by a decision table.

Facts of columns (counts, types, order), names with a meaning, and rules are
relations; a column gets the first rule whose conditions hold. So the catalog
may have any number of tables and columns, and users add names or rules as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DecimalType, FractionalType, MapType, StringType, StructType, VariantType

from kilnflow.operators.profile import numeric_columns
from kilnflow.sources.shared import cut

IDENTIFIER, TIMESTAMP, TARGET, FEATURE, REVIEW, EXCLUDED = "IDENTIFIER_CANDIDATE", "TIMESTAMP_CANDIDATE", "TARGET_CANDIDATE", "FEATURE_CANDIDATE", "REVIEW_REQUIRED", "EXCLUDED_CANDIDATE"
#: Names, without spaces, underscores and hyphens, that tell an identifier or a time, and those of targets by priority.
IDENTIFIER_NAMES = ("id", "identifier", "serial", "serialnumber", "lot", "lotid", "wafer", "waferid", "batch", "batchid", "sample", "sampleid", "device", "deviceid", "cellid", "recordid")
TIMESTAMP_NAMES = ("date", "time", "timestamp", "datetime", "recordedat", "createdat", "measurementtime", "cycletime")
TARGET_NAMES = {"soh": 100, "stateofhealth": 95, "qualityscore": 90, "defectrate": 90, "filmthickness": 85, "target": 80, "label": 75, "response": 70, "outcome": 70, "quality": 65, "yield": 60, "capacity": 55, "efficiency": 50, "performance": 45, "y": 20}
#: Shares of distinct values, rows from which few or many distinct values tell something, and what few are.
UNIQUE_RATIO, NEAR_UNIQUE_RATIO, LEAST_ROWS, FEW_VALUES, FEW_RATIO = 0.95, 0.98, 20, 10, 0.1

#: The conditions of a rule, each a Boolean column of the facts; null where it doesn't matter.
CONDITIONS = ("unusable", "suitable_as_identifier", "constant", "is_boolean", "is_numeric", "non_decreasing", "few_values", "near_unique", "nearly_all_unique")
RULES_SCHEMA = "rule int, kind string, " + ", ".join(f"{c} boolean" for c in CONDITIONS) + ", category string, priority int, confidence double, reason string"
ANY_KIND = ("IDENTIFIER", "TIMESTAMP", "TARGET", "NONE")


def _rule(rule: int, kind: str | None, category: str, priority: int | None, confidence: float | None, reason: str, **conditions: bool) -> tuple:
    return (rule, kind, *[conditions.get(c) for c in CONDITIONS], category, priority, confidence, reason)


#: The first rule that holds counts. A priority or confidence of null follows from the name's own priority.
RULES = (
    _rule(10, "IDENTIFIER", REVIEW, 20, 0.70, "named like an identifier, without usable values", unusable=True),
    _rule(20, None, EXCLUDED, 0, 0.95, "no values, or of a nested type", unusable=True),
    _rule(30, "IDENTIFIER", IDENTIFIER, 50, 0.95, "named like an identifier, nearly all values differ", suitable_as_identifier=True, nearly_all_unique=True),
    _rule(31, "IDENTIFIER", IDENTIFIER, 50, 0.90, "named like an identifier, most values differ", suitable_as_identifier=True, near_unique=True),
    _rule(32, "IDENTIFIER", IDENTIFIER, 50, 0.70, "named like an identifier", suitable_as_identifier=True),
    _rule(40, "IDENTIFIER", REVIEW, 20, 0.70, "named like an identifier, but constant"),
    _rule(50, "TIMESTAMP", TIMESTAMP, 50, 0.55, "named like a time, not numeric", is_numeric=False),
    _rule(51, "TIMESTAMP", TIMESTAMP, 50, 0.80, "named like a time, never falls", non_decreasing=True),
    _rule(52, "TIMESTAMP", TIMESTAMP, 50, 0.70, "named like a time"),
    _rule(60, "TARGET", TARGET, None, None, "named like a target"),
    _rule(70, None, EXCLUDED, 0, 0.95, "constant", constant=True),
    _rule(80, None, REVIEW, 10, 0.60, "Boolean", is_boolean=True),
    _rule(90, None, EXCLUDED, 0, 0.85, "not numeric", is_numeric=False),
    _rule(100, None, REVIEW, 5, 0.55, "few values, perhaps a code", few_values=True),
    _rule(110, None, REVIEW, 5, 0.50, "nearly all values differ, without the name of an identifier", nearly_all_unique=True),
    _rule(120, None, FEATURE, 1, 0.75, "numeric"),
)


def default_names(spark: SparkSession) -> DataFrame:
    """(name, kind, priority) of the fixed names."""
    rows = [(n, "IDENTIFIER", 50) for n in IDENTIFIER_NAMES] + [(n, "TIMESTAMP", 50) for n in TIMESTAMP_NAMES] + [(n, "TARGET", p) for n, p in TARGET_NAMES.items()]
    return spark.createDataFrame(rows, "name string, kind string, priority int")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), RULES_SCHEMA)


def plain_name(name: Column) -> Column:
    """A name in lower case without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(name), r"[\s_-]+", "")


def _nested(kind) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType, VariantType))


def never_falls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, non_decreasing) of numeric columns in the order in which Spark reads the rows, nulls aside; null without values.

    A task sends one row per column: whether its own values fall, its first and
    its last. No row is moved, and only these are compared. NaN is the largest
    value; decimals are compared as doubles.
    """
    names = numeric_columns(df) if columns is None else columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    exact = lambda c: F.col(f"`{c}`").cast("double" if isinstance(kinds[c], (FractionalType, DecimalType)) else "long")
    schema = "part int, column_place int, rises boolean, first double, last double, first_long long, last_long long"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), {}
        for batch in batches:
            for i, column in enumerate(batch.columns):
                v = column.drop_null().to_numpy(zero_copy_only=False)
                if not len(v):
                    continue
                first, last, rises = state.get(i, (v[0], v[0], True))
                a, b = np.concatenate(([last], v[:-1])), v
                state[i] = (first, v[-1], rises and bool(((b >= a) | (b != b)).all()))
        rows = [(part, i, r, *((float(f), float(x), None, None) if isinstance(f, np.floating) else (None, None, int(f), int(x)))) for i, (f, x, r) in state.items()]
        cells = list(zip(*rows)) if rows else [()] * 7
        kinds_ = (pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds_)], ["part", "column_place", "rises", "first", "last", "first_long", "last_long"])

    from pyspark.sql import Window

    spark = df.sparkSession
    listed = spark.createDataFrame(list(enumerate(names)), "column_place int, column_name string")
    if not names:
        return listed.select("column_name", F.lit(None).cast("boolean").alias("non_decreasing"))
    parts = cut(df.select(*[exact(c).alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(ends, schema), "ends")
    order = Window.partitionBy("column_place").orderBy("part")  # a row per task
    after = F.when(F.col("first").isNotNull(), F.col("first") >= F.lag("last").over(order)).otherwise(F.col("first_long") >= F.lag("last_long").over(order))
    steps = F.coalesce(after, F.lit(True))
    verdict = parts.withColumn("steps", steps).groupBy("column_place").agg(F.bool_and(F.col("rises") & F.col("steps")).alias("non_decreasing"))
    return listed.join(verdict, "column_place", "left").select("column_name", "non_decreasing")


def _types(df: DataFrame, table: str) -> list[tuple]:
    numeric = set(numeric_columns(df))
    return [(table, i, f.name, f.dataType.simpleString(), f.name in numeric, isinstance(f.dataType, BooleanType), _nested(f.dataType)) for i, f in enumerate(df.schema.fields)]


def column_facts(tables: dict[str, DataFrame], order: bool = True) -> DataFrame:
    """A row per table and column: type, rows, nulls, distinct values with null as one, and, with ``order``, non_decreasing.

    Columns of all tables are counted by one aggregation; a text of 32
    characters or more goes by its MD5 digest, so no text is shuffled. A table without rows
    has counts of 0.
    """
    if not tables:
        raise ValueError("no table is given")
    spark = next(iter(tables.values())).sparkSession
    types = spark.createDataFrame([r for t, df in tables.items() for r in _types(df, t)], "table_name string, place int, column_name string, dtype string, is_numeric boolean, is_boolean boolean, is_nested boolean")

    def cell(f, i: int) -> Column:
        c = F.col(f"`{f.name}`")
        text = F.hex(c) if isinstance(f.dataType, BinaryType) else F.to_json(F.struct(c)) if _nested(f.dataType) else c.cast("string")
        text = F.when(c.isNotNull(), text)
        long = _nested(f.dataType) or isinstance(f.dataType, (StringType, BinaryType))
        return F.struct(F.lit(i).alias("place"), (F.when(F.length(text) >= 32, F.md5(text)).otherwise(text) if long else text).alias("v"))

    cells = None
    for t, df in tables.items():
        if df.schema.fields:
            one = df.select(F.explode(F.array(*[cell(f, i) for i, f in enumerate(df.schema.fields)])).alias("x")).select(F.lit(t).alias("table_name"), "x.*")
            cells = one if cells is None else cells.unionByName(one)
    values = cells.groupBy("table_name", "place", "v").agg(F.count("*").alias("n"))
    counts = values.groupBy("table_name", "place").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("*").alias("unique_count"))
    facts = types.join(counts, ["table_name", "place"], "left").fillna(0, ["row_count", "null_count", "unique_count"])
    if not order:
        return facts.withColumn("non_decreasing", F.lit(None).cast("boolean"))
    falls = None
    for t, df in tables.items():
        one = never_falls(df).withColumn("table_name", F.lit(t))
        falls = one if falls is None else falls.unionByName(one)
    return facts.join(falls, ["table_name", "column_name"], "left")


def suggest(facts: DataFrame, names: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """``facts`` (column_facts) with category, priority, confidence, reason, constant and suitable_as_target.

    ``names`` (name, kind, priority) add to the fixed ones and win over them;
    ``rules`` replace the decision table. A name of several kinds is that of an
    identifier, then a time, then a target, and has its largest priority.
    Columns of a table without rows have no values and are excluded.
    """
    spark = facts.sparkSession
    given = default_names(spark).withColumn("own", F.lit(1))
    if names is not None:
        given = given.unionByName(names.select("name", "kind", "priority").withColumn("own", F.lit(0)))
    kind_place = F.array_position(F.array(*map(F.lit, ANY_KIND)), F.col("kind"))
    best = F.min_by(F.struct("kind", "priority"), F.struct("own", kind_place, (-F.col("priority")).alias("least")))
    known = given.groupBy(plain_name(F.col("name")).alias("_plain")).agg(best.alias("_n")).select("_plain", F.col("_n.kind").alias("kind"), F.col("_n.priority").alias("name_priority"))
    present = F.col("unique_count") - (F.col("null_count") > 0).cast("long")
    ratio = F.try_divide(F.col("unique_count").cast("double"), F.col("row_count").cast("double"))
    many = F.col("row_count") >= LEAST_ROWS
    named = facts.withColumn("_plain", plain_name(F.col("column_name"))).join(known, "_plain", "left").withColumn("kind", F.coalesce("kind", F.lit("NONE"))).drop("_plain")
    c = named.withColumn("unique_ratio", ratio).withColumn("constant", present == 1).withColumn("unusable", F.col("is_nested") | (present <= 0)).withColumn("suitable_as_identifier", present >= 2)
    c = c.withColumn("suitable_as_target", F.col("is_numeric") & (present >= 2)).withColumn("few_values", many & (F.col("unique_count") <= FEW_VALUES) & (F.col("unique_ratio") <= FEW_RATIO))
    near = F.coalesce(F.col("unique_ratio") >= UNIQUE_RATIO, F.lit(False))
    most = F.coalesce(F.col("unique_ratio") >= NEAR_UNIQUE_RATIO, F.lit(False)) & (many | (F.col("kind") == "IDENTIFIER"))
    c = c.withColumn("near_unique", near).withColumn("nearly_all_unique", most)
    table = default_rules(spark) if rules is None else rules
    # Rules of any kind are listed under each, so that the join is by equality.
    kinds = F.when(F.col("kind").isNull(), F.array(*map(F.lit, ANY_KIND))).otherwise(F.array("kind"))
    table = table.select(F.explode(kinds).alias("kind"), *[F.col(x).alias(f"_{x}") for x in CONDITIONS], F.struct("rule", "category", F.col("priority").alias("p"), F.col("confidence").alias("q"), "reason").alias("_r"))
    holds = [F.col(f"_{x}").isNull() | (F.col(f"_{x}") == F.coalesce(F.col(x), F.lit(False))) for x in CONDITIONS]
    joined = c.join(table, "kind")
    for h in holds:
        joined = joined.filter(h)
    first = joined.groupBy("table_name", "place").agg(F.min("_r").alias("_r"))
    out = c.join(first, ["table_name", "place"]).withColumn("category", F.col("_r.category")).withColumn("priority", F.coalesce("_r.p", "name_priority"))
    confidence = F.coalesce(F.col("_r.q"), F.least(F.lit(0.95), 0.55 + F.col("priority") / 200))
    return out.withColumn("confidence", confidence).withColumn("reason", F.col("_r.reason")).select(
        "table_name", "place", "column_name", "dtype", "category", "priority", "confidence", "reason", "is_numeric", "row_count", "null_count", "unique_count", "unique_ratio", "constant", "suitable_as_target", "non_decreasing", "kind",
    )


#: The list of a configuration that columns of a category go to.
LISTS = {TARGET: "TARGETS", FEATURE: "FEATURES", TIMESTAMP: "TIMESTAMPS", IDENTIFIER: "IDENTIFIERS", EXCLUDED: "EXCLUDED", REVIEW: "REVIEW"}


def configuration(suggested: DataFrame) -> DataFrame:
    """(table_name, list, rank, column_name): the columns of each list, targets by priority, others in the table's order."""
    from pyspark.sql import Window

    lists = F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv])
    rows = suggested.withColumn("list", lists[F.col("category")])
    order = Window.partitionBy("table_name", "list").orderBy(F.when(F.col("list") == "TARGETS", -F.col("priority")), "place")  # a table's columns
    return rows.select("table_name", "list", F.row_number().over(order).alias("rank"), "column_name")


def warnings(suggested: DataFrame) -> DataFrame:
    """(table_name, warning, column_name): tables without a target or feature, and constant columns with the name of an identifier."""
    has = lambda category: F.bool_or(F.col("category") == category)
    codes = F.array_compact(F.array(F.when(~has(TARGET), F.lit("NO_TARGET")), F.when(~has(FEATURE), F.lit("NO_FEATURE"))))
    tables = suggested.groupBy("table_name").agg(codes.alias("w")).select("table_name", F.explode("w").alias("warning"), F.lit(None).cast("string").alias("column_name"))
    return tables.unionByName(suggested.filter("constant AND kind = 'IDENTIFIER'").select("table_name", F.lit("CONSTANT_IDENTIFIER").alias("warning"), "column_name"))


def active_features(configured: DataFrame, chosen: DataFrame) -> DataFrame:
    """(table_name, rank, column_name): the recommended features but those that the user chose for another role (table_name, column_name), in their order."""
    taken = chosen.select("table_name", "column_name").distinct()
    return configured.filter("list = 'FEATURES'").join(taken, ["table_name", "column_name"], "left_anti").select("table_name", "rank", "column_name")
