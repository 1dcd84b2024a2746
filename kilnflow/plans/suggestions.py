"""Queries of column suggestions over the catalog of all given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnflow.operators import suggestions
from kilnflow.plans.preparation import read
from kilnflow.sources.shared import cut

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(suggestions.suggest(suggestions.column_facts({t: read(spark, sf_dir, t) for t in TABLES})), "suggestions")


_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, column_type, rows_, nulls, uniq FROM (SELECT column_name, column_type FROM (DESCRIBE {t})) JOIN (SELECT c AS column_name, count(*) AS rows_, count(*) - count(v) AS nulls, count(DISTINCT v) + (count(v) < count(*))::INT AS uniq FROM (SELECT COLUMNS(*)::VARCHAR FROM {t}) UNPIVOT INCLUDE NULLS (v FOR c IN (*)) GROUP BY c) USING (column_name)"
    for t in TABLES
)
#: Of the given tables' columns only quality and label have a name in the lists; both are targets.
_SUGGESTED = f"""n AS ({_COUNTS}),
k AS (SELECT *, column_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT') AS is_numeric, column_type LIKE '%[]' AS nested, uniq - (nulls > 0)::INT AS present, uniq / rows_ AS ratio, CASE column_name WHEN 'quality' THEN 65 WHEN 'label' THEN 75 END AS target FROM n),
su AS (SELECT *, CASE WHEN nested OR present = 0 THEN 1 WHEN target IS NOT NULL THEN 2 WHEN present = 1 THEN 3 WHEN NOT is_numeric THEN 4 WHEN rows_ >= 20 AND uniq <= 10 AND ratio <= 0.1 THEN 5 WHEN rows_ >= 20 AND ratio >= 0.98 THEN 6 ELSE 7 END AS rule FROM k),
sg AS (SELECT *, CASE WHEN rule = 2 THEN 'TARGET_CANDIDATE' WHEN rule IN (5, 6) THEN 'REVIEW_REQUIRED' WHEN rule = 7 THEN 'FEATURE_CANDIDATE' ELSE 'EXCLUDED_CANDIDATE' END AS category, CASE rule WHEN 2 THEN target WHEN 5 THEN 5 WHEN 6 THEN 5 WHEN 7 THEN 1 ELSE 0 END AS priority,
  CASE rule WHEN 2 THEN least(0.95, 0.55 + target / 200) WHEN 4 THEN 0.85 WHEN 5 THEN 0.55 WHEN 6 THEN 0.5 WHEN 7 THEN 0.75 ELSE 0.95 END AS confidence FROM su)"""


@query(f"WITH {_SUGGESTED} SELECT table_name, column_name, category, priority, round(confidence, 6)::DOUBLE AS confidence, rows_ AS row_count, nulls AS null_count, uniq AS unique_count, round(ratio, 9) AS unique_ratio, present = 1 AS constant, is_numeric AND present >= 2 AS suitable_as_target FROM sg")
def column_suggestions(spark, sf_dir):
    """What each column of each given table may be used for."""
    names = ("row_count", "null_count", "unique_count", "unique_ratio", "constant", "suitable_as_target")
    t = _suggested(spark, sf_dir).withColumn("unique_ratio", F.round("unique_ratio", 9)).withColumn("confidence", F.round("confidence", 6))
    return t.select("table_name", "column_name", "category", "priority", "confidence", *names)


@query(f"WITH {_SUGGESTED} SELECT table_name, 'NO_TARGET' AS warning, NULL AS column_name FROM sg GROUP BY 1 HAVING NOT bool_or(rule = 2) UNION ALL SELECT table_name, 'NO_FEATURE', NULL FROM sg GROUP BY 1 HAVING NOT bool_or(rule = 7)")
def column_warnings(spark, sf_dir):
    return suggestions.warnings(_suggested(spark, sf_dir))


@query(f"WITH {_SUGGESTED} SELECT table_name, column_name FROM sg WHERE rule = 7 AND column_name NOT IN ('l_extendedprice', 'value')")
def active_features(spark, sf_dir):
    """The recommended features when the price of a line and the value of an event are chosen as targets."""
    chosen = spark.createDataFrame([("lineitem", "l_extendedprice"), ("events", "value")], "table_name string, column_name string")
    return suggestions.active_features(suggestions.configuration(_suggested(spark, sf_dir)), chosen).select("table_name", "column_name")


_NEVER = " UNION ALL ".join(f"SELECT '{c}' AS column_name, bool_and(coalesce(c >= p, true)) AS non_decreasing FROM (SELECT {c} AS c, lag({c}) OVER () AS p FROM lineitem)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(_NEVER)
def never_falling_columns(spark, sf_dir):
    """Whether lineitem's numeric columns never fall in the file's order."""
    return suggestions.never_falls(read(spark, sf_dir, "lineitem"))
