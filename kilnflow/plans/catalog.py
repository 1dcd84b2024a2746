"""Queries of industry, role and task of all given tables, and of three of them under the names of an industry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnflow.operators import catalog, routing, suggestions
from kilnflow.plans.preparation import read
from kilnflow.plans.suggestions import TABLES
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


#: Given tables under other names: (table, {name: expression}).
VIEWS = {
    "etching": ("events", {"Wafer": "event_id", "event-time": "ts", "chamber": "user_id", "recipe": "event_type", "thickness_nm": "value", "rf power": "CASE WHEN event_id % 5 > 0 THEN value END", "passed": "event_type = 'click'", "note": "CAST(event_id AS STRING)"}),
    "cells": ("lineitem", {"cell": "l_orderkey", "cycle": "l_linenumber", "soc": "l_quantity", "capacity_ah": "l_extendedprice", "cutoff_voltage": "l_discount", "soh_pct": "l_tax", "chemistry": "l_returnflag", "shipped": "l_shipdate"}),
    "trips": ("orders", {"trip": "o_orderkey", "vin": "o_custkey", "engine_rpm": "o_totalprice", "failure_flag": "o_orderstatus", "recorded at": "o_orderdate", "comment": "o_orderpriority"}),
}
TOLD = (("etching", "user_description", "etch and deposition of wafers"), ("cells", "file_name", "battery.csv"), ("absent", "file_name", "vehicle_id.csv"))
CONFIRMED = (("trips", "automotive"),)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {v: read(spark, sf_dir, t).select(*[F.expr(e).alias(name) for name, e in columns.items()]) for v, (t, columns) in VIEWS.items()}
    return cut(suggestions.column_facts({t: read(spark, sf_dir, t) for t in TABLES} | views, order=False), "facts")


def _industries(of: DataFrame) -> DataFrame:
    spark = of.sparkSession
    told = spark.createDataFrame(list(TOLD), "table_name string, source string, text string")
    return catalog.industries(of, told, spark.createDataFrame(list(CONFIRMED), "table_name string, industry string"))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = facts(spark, sf_dir)
    overrides = spark.createDataFrame([("cells", "soc", "DERIVED_FEATURE"), ("labels", "toxic", "TARGET_QUALITY")], "table_name string, column_name string, role string")
    return cut(catalog.roles(of, _industries(of), overrides), "roles")


def _literals(rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


_SOURCES = {t: t for t in TABLES} | {v: "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f" FROM {t})" for v, (t, columns) in VIEWS.items()}
_FACTS = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, place, column_name, column_type, rows_, nulls, uniq FROM (SELECT row_number() OVER () AS place, column_name, column_type FROM (DESCRIBE SELECT * FROM {s})) JOIN (SELECT c AS column_name, count(*) AS rows_, count(*) - count(v) AS nulls, count(DISTINCT v) + (count(v) < count(*))::INT AS uniq
FROM (SELECT COLUMNS(*)::VARCHAR FROM {s}) UNPIVOT INCLUDE NULLS (v FOR c IN (*)) GROUP BY c) USING (column_name)"""
    for t, s in _SOURCES.items()
)
_KEYWORDS = _literals([(i, k, n) for n, (i, ks) in enumerate(routing.KEYWORDS.items()) for k in ks])
_plain = lambda c: f"trim(regexp_replace(lower({c}), '[^0-9a-z가-힣]+', ' ', 'g'))"
_INDUSTRIES = f"""f AS ({_FACTS}),
tx AS (SELECT table_name, 'column_names' AS source, column_name AS text FROM f UNION ALL SELECT * FROM {_literals(TOLD)} WHERE col0 IN (SELECT table_name FROM f)),
kw AS (SELECT col0 AS industry, col1 AS keyword, col2 AS place FROM {_KEYWORDS}),
hit AS (SELECT DISTINCT table_name, source, industry, keyword FROM tx, kw WHERE contains(' ' || {_plain("text")} || ' ', ' ' || {_plain("keyword")} || ' ')),
sc AS (SELECT t.table_name, i.industry, i.place, coalesce(sum(CASE source WHEN 'user_description' THEN 4.0 WHEN 'column_names' THEN 2.0 WHEN 'file_name' THEN 1.0 END), 0)::DOUBLE AS score
  FROM (SELECT DISTINCT table_name FROM f) t CROSS JOIN (SELECT DISTINCT industry, place FROM kw) i LEFT JOIN hit USING (table_name, industry) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY score DESC, place) AS r, score - lead(score) OVER (PARTITION BY table_name ORDER BY score DESC, place) AS margin FROM sc),
ind AS (SELECT table_name, coalesce(c.col1, CASE WHEN score < 1 THEN 'generic' ELSE industry END) AS industry, score, round(least(1.0, score / 12), 4)::DOUBLE AS confidence, margin,
  CASE WHEN c.col1 IS NOT NULL THEN 'USER_CONFIRMED' WHEN score < 1 THEN 'FALLBACK_GENERIC' WHEN score / 12 < 0.6 OR margin < 2 THEN 'CONFIRMATION_REQUIRED' ELSE 'AUTO_SELECTED' END AS decision
  FROM rk LEFT JOIN {_literals(CONFIRMED)} c ON c.col0 = table_name WHERE r = 1)"""


@query(f"WITH {_INDUSTRIES} SELECT * FROM ind")
def catalog_industries(spark, sf_dir):
    return _industries(facts(spark, sf_dir))


_HINTS = _literals([(i, n, c, r, catalog.UNITS[i].get(c)) for i, rs in catalog.DEFAULT_ROLES.items() for c, r in rs.items() for n in (c, *catalog.SYNONYMS[i].get(c, ()))])
#: A name is that of at most one column of an industry, so no table has a synonym of two roles.
_ROLES = f"""{_INDUSTRIES}, h AS (SELECT col0 AS industry, {_plain("col1")} AS plain, {_plain("col1")} = {_plain("col2")} AS itself, col2 AS canonical, col3 AS role, col4 AS unit FROM {_HINTS}),
hc AS (SELECT industry, plain, arg_max(struct_pack(itself, canonical, role, unit), itself) AS h FROM h GROUP BY ALL),
c AS (SELECT f.*, h, {_plain("column_name")} AS plain, uniq / rows_ AS ratio, column_type LIKE 'TIMESTAMP%' AS temporal, column_type = 'VARCHAR' AS text FROM f JOIN ind USING (table_name) LEFT JOIN hc ON hc.industry = ind.industry AND hc.plain = {_plain("column_name")}),
rr AS (SELECT *, CASE WHEN table_name = 'cells' AND column_name = 'soc' THEN {{'role': 'DERIVED_FEATURE', 'q': 1.0}} WHEN table_name = 'labels' AND column_name = 'toxic' THEN {{'role': 'TARGET_QUALITY', 'q': 1.0}}
  WHEN h.itself THEN {{'role': h.role, 'q': 0.98}} WHEN h IS NOT NULL THEN {{'role': h.role, 'q': 0.95}} WHEN temporal THEN {{'role': 'TIME', 'q': 0.9}}
  WHEN plain IN ('timestamp', 'datetime', 'date', 'time', 'event time', 'measurement time', 'recorded at') THEN {{'role': 'TIME', 'q': 0.88}}
  WHEN regexp_matches(plain, '(^| )id$') OR plain IN ('uuid', 'vin', 'serial', 'serial number') THEN {{'role': 'IDENTIFIER', 'q': 0.88}}
  WHEN plain IN ('target', 'label', 'response', 'quality target', 'prediction target') THEN {{'role': 'TARGET_QUALITY', 'q': 0.85}} WHEN column_type = 'BOOLEAN' THEN {{'role': 'CONTEXT', 'q': 0.8}}
  WHEN text AND ratio <= 0.2 THEN {{'role': 'CONTEXT', 'q': 0.75}} WHEN text AND ratio >= 0.9 THEN {{'role': 'IDENTIFIER', 'q': 0.7}} ELSE {{'role': 'UNKNOWN', 'q': 0.0}} END AS x FROM c),
ro AS (SELECT * EXCLUDE (x, h), x.role AS role, x.q::DOUBLE AS confidence, x.role <> 'UNKNOWN' AND x.q < 0.8 AS low, CASE WHEN x.q IN (0.98, 0.95) THEN h.canonical END AS canonical, CASE WHEN x.q IN (0.98, 0.95) THEN h.unit END AS unit FROM rr)"""


@query(f"WITH {_ROLES} SELECT table_name, column_name, role, confidence, low AS low_confidence, role IN ('CONTROLLABLE_PROCESS', 'STATE_SENSOR', 'CONTEXT', 'DERIVED_FEATURE') AS use_in_model, canonical, unit FROM ro")
def catalog_roles(spark, sf_dir):
    return _roles(spark, sf_dir).select("table_name", "column_name", "role", "confidence", "low_confidence", "use_in_model", "canonical", "unit")


@query(f"""WITH {_ROLES}, s AS (SELECT table_name, coalesce(string_agg(column_name, ',' ORDER BY place) FILTER (role = 'UNKNOWN'), '') AS unresolved, coalesce(string_agg(column_name, ',' ORDER BY place) FILTER (low), '') AS low,
  {", ".join(f"count(*) FILTER (role = '{r}') AS {r.lower()}" for r in catalog.ROLES)} FROM ro GROUP BY 1) SELECT *, unresolved <> '' OR low <> '' AS needs_confirmation FROM s""")
def catalog_role_summary(spark, sf_dir):
    """Which roles a user must confirm in each table, and how many columns have each role."""
    mapped = _roles(spark, sf_dir)
    counts = catalog.role_counts(mapped).groupBy("table_name").pivot("role", list(catalog.ROLES)).agg(F.first("n"))
    counts = counts.select("table_name", *[F.col(r).alias(r.lower()) for r in catalog.ROLES])
    summary = catalog.role_summary(mapped)
    return summary.select("table_name", F.array_join("unresolved", ",").alias("unresolved"), F.array_join("low", ",").alias("low"), "needs_confirmation").join(counts, "table_name")


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c, ",").alias(c) if c in ("candidates", "warnings", "targets", "times") else F.col(c) for c in df.columns])


_TASKS = f"""{_ROLES}, tt AS (SELECT table_name, coalesce(string_agg(column_name, ',' ORDER BY place) FILTER (role = 'TARGET_QUALITY'), '') AS targets, coalesce(string_agg(column_name, ',' ORDER BY place) FILTER (role = 'TIME'), '') AS times,
  count(*) FILTER (role = 'TARGET_QUALITY') AS nt, count(*) FILTER (role = 'TIME') AS nm, arg_min(column_name, place) FILTER (role = 'TARGET_QUALITY') AS target, arg_min(column_name, place) FILTER (role = 'TIME') AS tm FROM ro GROUP BY 1),
tk AS (SELECT tt.*, CASE WHEN text OR column_type = 'BOOLEAN' THEN 'C' WHEN uniq <= 20 AND ratio <= 0.05 THEN 'F' WHEN ro.column_name IS NOT NULL THEN 'R' END AS k, text, rows_ - nulls < 2 AS lacking FROM tt LEFT JOIN ro ON ro.table_name = tt.table_name AND ro.column_name = target)"""


@query(f"""WITH {_TASKS} SELECT table_name, CASE WHEN nt > 1 OR k = 'F' OR nm > 1 AND nt = 0 THEN 'CONFIRMATION_REQUIRED' ELSE 'AUTO_SELECTED' END AS decision,
CASE k WHEN 'C' THEN 'CLASSIFICATION' WHEN 'F' THEN 'CLASSIFICATION' WHEN 'R' THEN 'REGRESSION' ELSE CASE WHEN nm > 0 THEN 'TIME_SERIES_ANOMALY' ELSE 'UNSUPERVISED_ANOMALY' END END AS task, target, CASE WHEN nt = 0 THEN tm END AS time_column,
CASE k WHEN 'C' THEN 'CLASSIFICATION,RESIDUAL_ANOMALY' WHEN 'F' THEN 'CLASSIFICATION,REGRESSION,RESIDUAL_ANOMALY' WHEN 'R' THEN 'REGRESSION,RESIDUAL_ANOMALY' ELSE CASE WHEN nm > 0 THEN 'TIME_SERIES_ANOMALY,UNSUPERVISED_ANOMALY,DRIFT_DETECTION' ELSE 'UNSUPERVISED_ANOMALY' END END AS candidates,
CASE WHEN nt > 1 THEN 'SEVERAL_TARGETS' WHEN k = 'C' THEN CASE WHEN text THEN 'TEXT_TARGET' ELSE 'BOOLEAN_TARGET' END WHEN k = 'F' THEN 'FEW_VALUES' WHEN k = 'R' THEN 'CONTINUOUS_TARGET' WHEN nm > 1 THEN 'SEVERAL_TIMES' ELSE 'NO_TARGET' END AS reason,
concat_ws(',', CASE WHEN nt > 1 THEN 'SEVERAL_TARGETS' END, CASE WHEN k = 'F' THEN 'FEW_VALUES' END, CASE WHEN nt = 0 AND nm > 1 THEN 'SEVERAL_TIMES' END) AS warnings, targets, times, nt > 1 OR coalesce(k = 'F', false) OR nm > 1 AND nt = 0 AS needs_confirmation FROM tk""")
def catalog_tasks(spark, sf_dir):
    """The task that each table's roles and counts suggest."""
    return _flat(catalog.tasks(_roles(spark, sf_dir)))


#: What users ask for, and why some of it can't be followed.
_ASKED = (
    ("cells", "REGRESSION", "capacity_ah", None, None), ("trips", "CLASSIFICATION", "recorded at", None, "TARGET_WITHOUT_CLASSES"), ("etching", "DRIFT_DETECTION", None, "event-time", None), ("labels", "RESIDUAL_ANOMALY", None, None, "TARGET_REQUIRED"),
    ("part", "REGRESSION", "p_type", None, "TARGET_NOT_NUMERIC"), ("orders", "TIME_SERIES_ANOMALY", None, None, "TIME_REQUIRED"), ("lineitem", "REGRESSION", "no_such", None, "NO_SUCH_COLUMN"), ("region", "SORTING", None, None, "NO_SUCH_TASK"), ("customer", "UNSUPERVISED_ANOMALY", None, None, None),
)


@query(f"""WITH {_TASKS}, a AS (SELECT col0 AS table_name, col1 AS asked, col2 AS t, col3 AS m, col4 AS why FROM {_literals(_ASKED)})
SELECT table_name, CASE WHEN why IS NULL THEN 'USER_CONFIRMED' ELSE 'REFUSED' END AS decision, CASE WHEN why IS NULL THEN asked END AS task, t AS target, m AS time_column, coalesce(why, 'USER_CONFIRMED') AS reason,
CASE WHEN why IS NOT NULL THEN '' ELSE CASE asked WHEN 'REGRESSION' THEN 'REGRESSION,RESIDUAL_ANOMALY' WHEN 'DRIFT_DETECTION' THEN 'DRIFT_DETECTION,TIME_SERIES_ANOMALY,UNSUPERVISED_ANOMALY' ELSE 'UNSUPERVISED_ANOMALY' END END AS candidates,
concat_ws(',', nullif(targets, ''), CASE WHEN NOT list_contains(string_split(targets, ','), t) THEN t END) AS targets, concat_ws(',', nullif(times, ''), CASE WHEN NOT list_contains(string_split(times, ','), m) THEN m END) AS times FROM a JOIN tk USING (table_name)""")
def catalog_tasks_confirmed(spark, sf_dir):
    """The tasks that users confirm, with refusals."""
    asked = spark.createDataFrame([a[:4] for a in _ASKED], "table_name string, task string, target string, time_column string")
    out = _flat(catalog.tasks(_roles(spark, sf_dir), asked)).join(asked.select("table_name"), "table_name", "left_semi")
    return out.select("table_name", "decision", "task", "target", "time_column", "reason", "candidates", "targets", "times")
