"""From column facts of many tables to the industry, the column roles and the task of each, as joins of relations.

Everything here works on a row per column, however large the tables are; names,
roles, units and the users' choices are relations, too, so that a catalog may
hold any number of tables and a user adds an industry as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kilnflow.operators import routing

#: The roles that a column may have.
ROLES = ("IDENTIFIER", "TIME", "CONTROLLABLE_PROCESS", "STATE_SENSOR", "CONTEXT", "TARGET_QUALITY", "DERIVED_FEATURE", "UNKNOWN")
#: The role of each canonical name of an industry.
DEFAULT_ROLES = {
    "semiconductor": {
        "wafer_id": "IDENTIFIER", "lot_id": "IDENTIFIER", "die_id": "IDENTIFIER", "timestamp": "TIME", "etch_time": "CONTROLLABLE_PROCESS", "deposition_time": "CONTROLLABLE_PROCESS",
        "gas_flow": "CONTROLLABLE_PROCESS", "rf_power": "CONTROLLABLE_PROCESS", "chamber_pressure": "STATE_SENSOR", "chamber_temperature": "STATE_SENSOR", "endpoint_signal": "STATE_SENSOR",
        "chamber_id": "CONTEXT", "tool_id": "CONTEXT", "recipe_id": "CONTEXT", "yield": "TARGET_QUALITY", "defect_rate": "TARGET_QUALITY", "critical_dimension": "TARGET_QUALITY", "film_thickness": "TARGET_QUALITY",
    },
    "battery": {
        "cell_id": "IDENTIFIER", "batch_id": "IDENTIFIER", "timestamp": "TIME", "cycle_index": "TIME", "charge_current": "CONTROLLABLE_PROCESS", "discharge_current": "CONTROLLABLE_PROCESS",
        "cutoff_voltage": "CONTROLLABLE_PROCESS", "cell_voltage": "STATE_SENSOR", "cell_temperature": "STATE_SENSOR", "internal_resistance": "STATE_SENSOR", "state_of_charge": "STATE_SENSOR",
        "chemistry": "CONTEXT", "formation_channel": "CONTEXT", "discharge_capacity": "TARGET_QUALITY", "capacity_retention": "TARGET_QUALITY", "state_of_health": "TARGET_QUALITY", "coulombic_efficiency": "TARGET_QUALITY",
    },
    "automotive": {
        "vehicle_id": "IDENTIFIER", "vin": "IDENTIFIER", "trip_id": "IDENTIFIER", "timestamp": "TIME", "throttle_position": "CONTROLLABLE_PROCESS", "brake_command": "CONTROLLABLE_PROCESS",
        "engine_rpm": "STATE_SENSOR", "vehicle_speed": "STATE_SENSOR", "steering_angle": "STATE_SENSOR", "brake_pressure": "STATE_SENSOR", "wheel_speed": "STATE_SENSOR",
        "road_type": "CONTEXT", "weather": "CONTEXT", "driver_id": "CONTEXT", "fuel_efficiency": "TARGET_QUALITY", "emission_rate": "TARGET_QUALITY", "failure_flag": "TARGET_QUALITY",
    },
}
#: Other names of the canonical ones.
SYNONYMS = {
    "semiconductor": {
        "wafer_id": ("wafer", "waferid"), "lot_id": ("lot", "lotid", "batch_id"), "die_id": ("die", "dieid"), "timestamp": ("time", "datetime", "event_time"),
        "chamber_id": ("chamber", "chamberid"), "tool_id": ("tool", "toolid", "equipment_id"), "recipe_id": ("recipe", "recipeid"), "critical_dimension": ("cd", "critical_dimension_nm"),
        "film_thickness": ("thickness", "thickness_nm"), "yield": ("process_yield", "yield_rate"), "defect_rate": ("defect", "defect_ratio"),
    },
    "battery": {
        "cell_id": ("cell", "cellid"), "batch_id": ("batch", "batchid", "lot_id"), "cycle_index": ("cycle", "cycle_number"), "timestamp": ("time", "datetime", "event_time"),
        "cell_voltage": ("voltage", "voltage_v"), "cell_temperature": ("temperature", "temp"), "charge_current": ("charging_current", "i_charge"), "discharge_current": ("discharging_current", "i_discharge"),
        "discharge_capacity": ("capacity", "capacity_ah"), "state_of_charge": ("soc", "soc_pct"), "state_of_health": ("soh", "soh_pct"), "internal_resistance": ("resistance", "ir"), "coulombic_efficiency": ("ce", "coulomb_efficiency"),
    },
    "automotive": {
        "vehicle_id": ("vehicle", "vehicleid"), "vin": ("vehicle_identification_number",), "trip_id": ("trip", "tripid"), "timestamp": ("time", "datetime", "event_time"),
        "vehicle_speed": ("speed", "speed_kmh"), "engine_rpm": ("rpm", "engine_speed"), "throttle_position": ("throttle", "throttle_pct"), "brake_pressure": ("brake", "brake_bar"),
        "steering_angle": ("steering", "steer_angle"), "wheel_speed": ("wheel", "wheel_rpm"), "fuel_rate": ("fuel", "fuel_consumption"), "emission_rate": ("emission", "emissions"),
    },
}
#: The units of canonical names.
UNITS = {
    "semiconductor": {"critical_dimension": "nm", "film_thickness": "nm", "chamber_pressure": "Pa", "rf_power": "W"},
    "battery": {"cell_voltage": "V", "charge_current": "A", "discharge_current": "A", "cell_temperature": "degC", "discharge_capacity": "Ah", "internal_resistance": "ohm"},
    "automotive": {"vehicle_speed": "km/h", "engine_rpm": "rpm", "steering_angle": "deg", "brake_pressure": "bar", "fuel_rate": "L/h", "emission_rate": "g/km"},
}
#: Below this confidence a role is to be confirmed; the least values of a target; the tasks that a user may confirm.
MIN_ROLE_CONFIDENCE, MIN_TARGET_VALUES = 0.80, 2
SUPERVISED, TIMED = ("REGRESSION", "CLASSIFICATION", "RESIDUAL_ANOMALY"), ("TIME_SERIES_ANOMALY", "DRIFT_DETECTION")


def industry_hints(spark: SparkSession) -> DataFrame:
    """(industry, name, canonical, role, unit): a row per synonym, and one without a name per canonical name.

    Synonyms of a canonical name without a role tell nothing and are left out.
    """
    rows = []
    for industry, roles in DEFAULT_ROLES.items():
        for canonical, role in roles.items():
            names = (None, *SYNONYMS[industry].get(canonical, ()))
            rows += [(industry, name, canonical, role, UNITS[industry].get(canonical)) for name in names]
    return spark.createDataFrame(rows, "industry string, name string, canonical string, role string, unit string")


def industries(facts: DataFrame, told: DataFrame | None = None, confirmed: DataFrame | None = None) -> DataFrame:
    """A row per table of ``facts`` (table_name, column_name): its industry by column names and by what is ``told`` of it, with the decision.

    ``told``: (table_name, source, text) with a source of user_description or
    file_name. ``confirmed``: (table_name, industry). A table that is only told
    of is left out. No facts, no rows.
    """
    texts = facts.select(F.col("table_name").alias("dataset"), F.lit("column_names").alias("source"), F.col("column_name").alias("text"))
    if told is not None:
        known = told.join(facts.select("table_name").distinct(), "table_name", "left_semi")
        texts = texts.unionByName(known.select(F.col("table_name").alias("dataset"), "source", "text"))
    by_user = None if confirmed is None else confirmed.withColumnRenamed("table_name", "dataset")
    return routing.route_industry(routing.score_industries(texts), by_user).withColumnRenamed("dataset", "table_name")


def roles(facts: DataFrame, routed: DataFrame, overrides: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """``facts`` (suggestions.column_facts) with role, confidence, use_in_model, canonical, alternatives, low_confidence and unit.

    ``routed``: (table_name, industry); a table of another industry than those
    of ``hints`` (industry_hints by default), or of none, goes by its types and
    plain names alone. ``overrides``: (table_name, column_name, role).
    """
    known = industry_hints(facts.sparkSession) if hints is None else hints
    per_table = routed.select("table_name", "industry").distinct().join(known, "industry")
    ratio = F.coalesce(F.try_divide(F.col("unique_count").cast("double"), F.col("row_count").cast("double")), F.lit(0.0))
    mapped = routing.map_roles(facts.withColumn("cardinality_ratio", ratio), per_table, overrides, by=("table_name",))
    units = per_table.groupBy("table_name", "canonical").agg(F.min("unit").alias("unit"))
    low = (F.col("role") != "UNKNOWN") & (F.col("confidence") < MIN_ROLE_CONFIDENCE)
    return mapped.withColumn("low_confidence", low).join(units, ["table_name", "canonical"], "left")


def unknown_overrides(facts: DataFrame, overrides: DataFrame) -> DataFrame:
    """(table_name, column_name, role, reason) of overrides that can't be followed: NO_SUCH_COLUMN or NO_SUCH_ROLE."""
    known = facts.select("table_name", "column_name", F.lit(True).alias("_known")).distinct()
    reason = F.when(F.col("_known").isNull(), "NO_SUCH_COLUMN").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "NO_SUCH_ROLE")
    return overrides.join(known, ["table_name", "column_name"], "left").withColumn("reason", reason).filter("reason IS NOT NULL").select("table_name", "column_name", "role", "reason")


def role_counts(mapped: DataFrame) -> DataFrame:
    """(table_name, role, n) for each role, zeros included."""
    n = [F.count_if(F.col("role") == r).alias(r) for r in ROLES]
    counts = mapped.groupBy("table_name").agg(*n)
    return counts.unpivot("table_name", list(ROLES), "role", "n")


def role_summary(mapped: DataFrame) -> DataFrame:
    """A row per table: unresolved columns, those of low confidence (both in the table's order), and whether a user must confirm the roles."""
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", "column_name")))), lambda x: x["column_name"])
    out = mapped.groupBy("table_name").agg(listed(F.col("role") == "UNKNOWN").alias("unresolved"), listed(F.col("low_confidence")).alias("low"))
    return out.withColumn("needs_confirmation", (F.size("unresolved") > 0) | (F.size("low") > 0))


def kind(dtype: Column) -> Column:
    """What Spark's name of a type tells of a target: BOOLEAN, TEXT, NUMERIC, TEMPORAL or OTHER."""
    return (
        F.when(dtype == "boolean", "BOOLEAN").when(F.regexp_like(dtype, F.lit(r"^(string|char|varchar)")), "TEXT")
        .when(F.regexp_like(dtype, F.lit(r"^(tinyint|smallint|int|bigint|float|double|decimal(\(.*\))?)$")), "NUMERIC")
        .when(F.regexp_like(dtype, F.lit(r"^(date|timestamp|time)")), "TEMPORAL").otherwise("OTHER")
    )


def _names(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def _related(task: Column, has_time: Column) -> Column:
    """The confirmed task, then those that it may be changed for."""
    return (
        F.when(task == "REGRESSION", _names("REGRESSION", "RESIDUAL_ANOMALY")).when(task == "CLASSIFICATION", _names("CLASSIFICATION", "RESIDUAL_ANOMALY"))
        .when(task == "RESIDUAL_ANOMALY", _names("RESIDUAL_ANOMALY", "REGRESSION"))
        .when(task == "TIME_SERIES_ANOMALY", _names("TIME_SERIES_ANOMALY", "UNSUPERVISED_ANOMALY", "DRIFT_DETECTION"))
        .when(task == "DRIFT_DETECTION", _names("DRIFT_DETECTION", "TIME_SERIES_ANOMALY", "UNSUPERVISED_ANOMALY"))
        .when(has_time, _names("UNSUPERVISED_ANOMALY", "TIME_SERIES_ANOMALY", "DRIFT_DETECTION")).otherwise(_names("UNSUPERVISED_ANOMALY"))
    )


def _refusal(least: int) -> Column:
    """Why the user's choice can't be followed; null if it can."""
    task, target, of = F.col("task_"), F.col("target_"), F.col("t.kind")
    supervised = task.isin(*SUPERVISED)
    return F.coalesce(
        F.when(~task.isin(*SUPERVISED, *TIMED, "UNSUPERVISED_ANOMALY"), "NO_SUCH_TASK"),
        F.when((target.isNotNull() & F.col("t.kind").isNull()) | (F.col("time_").isNotNull() & F.col("m.low").isNull()), "NO_SUCH_COLUMN"),
        F.when(supervised & target.isNull(), "TARGET_REQUIRED"),
        F.when(supervised & (F.col("t.present") < least), "TOO_FEW_TARGET_VALUES"),
        F.when(task.isin("REGRESSION", "RESIDUAL_ANOMALY") & (of != "NUMERIC"), "TARGET_NOT_NUMERIC"),
        F.when((task == "CLASSIFICATION") & of.isin("TEMPORAL", "OTHER"), "TARGET_WITHOUT_CLASSES"),
        F.when(task.isin(*TIMED) & F.col("time_").isNull(), "TIME_REQUIRED"),
    )


def tasks(
    mapped: DataFrame, confirmed: DataFrame | None = None, most_classes: int = routing.MAX_CLASSES, most_ratio: float = routing.MAX_CLASS_RATIO, least_values: int = MIN_TARGET_VALUES, prefer_time: bool = True
) -> DataFrame:
    """A row per table of ``mapped`` (roles()): decision, task, target, time_column, candidates, targets, times, reason, warnings.

    ``confirmed``: (table_name, task, target, time_column), null where the user
    says nothing; of several rows of a table the smallest counts. A confirmed
    task is followed (USER_CONFIRMED) or, as one table mustn't stop the others,
    REFUSED with the reason and no task. Otherwise the confirmed or first target
    tells the task: text and Booleans have classes; numbers with few values
    perhaps (CONFIRMATION_REQUIRED); other numbers are regressed on. Several
    targets without a choice, other types and roles of low confidence need
    confirmation. Without a target, or with one of under ``least_values``
    values (to be confirmed), anomalies are sought: over time, if there is a
    TIME column and ``prefer_time``. Tables without rows have targets without
    values.
    """
    spark = mapped.sparkSession
    if confirmed is None:
        confirmed = spark.createDataFrame([], "table_name string, task string, target string, time_column string")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("place", "column_name")))), lambda x: x["column_name"])
    tables = mapped.groupBy("table_name").agg(of("TARGET_QUALITY").alias("targets"), of("TIME").alias("times"))
    choice = confirmed.groupBy("table_name").agg(F.min(F.struct("task", "target", "time_column")).alias("_c")).select("table_name", F.col("_c.task").alias("task_"), F.col("_c.target").alias("target_"), F.col("_c.time_column").alias("time_"))
    also = lambda names, one: F.when(F.col(one).isNull() | F.array_contains(names, F.col(one)), F.col(names)).otherwise(F.array_append(names, F.col(one)))
    base = tables.join(choice, "table_name", "left").withColumn("targets", also("targets", "target_")).withColumn("times", also("times", "time_"))
    base = base.withColumn("_target", F.coalesce("target_", F.get("targets", F.lit(0)))).withColumn("_time", F.coalesce("time_", F.get("times", F.lit(0))))

    few = (F.col("unique_count") <= most_classes) & (F.col("cardinality_ratio") <= most_ratio)
    facts = F.struct(kind(F.col("dtype")).alias("kind"), (F.col("row_count") - F.col("null_count")).alias("present"), few.alias("few"), F.col("low_confidence").alias("low"))
    columns = mapped.select("table_name", "column_name", facts.alias("f"))
    chosen = lambda name, key: columns.select("table_name", F.col("column_name").alias(key), F.col("f").alias(name))
    b = base.join(chosen("t", "_target"), ["table_name", "_target"], "left").join(chosen("m", "_time"), ["table_name", "_time"], "left").withColumn("_refused", _refusal(least_values))

    has_time, several_times = F.size("times") > 0, (F.size("times") > 1) & F.col("time_").isNull()
    several = F.col("target_").isNull() & (F.size("targets") > 1)
    lacking = F.coalesce(~several & (F.col("t.present") < least_values), F.lit(False))
    k, few = F.col("t.kind"), F.coalesce(F.col("t.few"), F.lit(False))
    outcome = lambda decision, task, target, time, candidates, reason, warnings: F.struct(
        decision.alias("decision"), task.cast("string").alias("task"), target.cast("string").alias("target"), time.cast("string").alias("time_column"),
        candidates.cast("array<string>").alias("candidates"), reason.alias("reason"), F.array_compact(F.array(*warnings)).cast("array<string>").alias("warnings"),
    )
    decided = lambda confirm: F.when(confirm, "CONFIRMATION_REQUIRED").otherwise("AUTO_SELECTED")
    null, when = F.lit(None), lambda cond, code: F.when(cond, F.lit(code))

    classes, ambiguous = k.isin("BOOLEAN", "TEXT"), (k == "NUMERIC") & few
    unclear = k.isin("TEMPORAL", "OTHER")
    low_target, low_time = F.coalesce(F.col("t.low"), F.lit(False)), F.coalesce(F.col("m.low"), F.lit(False))
    candidates = (
        F.when(classes, _names("CLASSIFICATION", "RESIDUAL_ANOMALY")).when(ambiguous, _names("CLASSIFICATION", "REGRESSION", "RESIDUAL_ANOMALY"))
        .when(unclear, _names("REGRESSION", "CLASSIFICATION")).otherwise(_names("REGRESSION", "RESIDUAL_ANOMALY"))
    )
    told_by = F.when(several, "SEVERAL_TARGETS").when(k == "BOOLEAN", "BOOLEAN_TARGET").when(k == "TEXT", "TEXT_TARGET").when(ambiguous, "FEW_VALUES").when(k == "NUMERIC", "CONTINUOUS_TARGET").when(k == "TEMPORAL", "TEMPORAL_TARGET").otherwise("OTHER_TARGET")
    by_target = outcome(
        decided(several | ambiguous | unclear | low_target), F.get(candidates, F.lit(0)), F.col("_target"), null, candidates, told_by,
        [when(several, "SEVERAL_TARGETS"), when(ambiguous, "FEW_VALUES"), when(k == "TEMPORAL", "TEMPORAL_TARGET"), when(k == "OTHER", "OTHER_TARGET"), when(low_target, "LOW_CONFIDENCE_TARGET")],
    )
    timed = _names("TIME_SERIES_ANOMALY", "UNSUPERVISED_ANOMALY", "DRIFT_DETECTION") if prefer_time else _names("UNSUPERVISED_ANOMALY", "TIME_SERIES_ANOMALY", "DRIFT_DETECTION")
    sought = F.when(has_time, timed).otherwise(_names("UNSUPERVISED_ANOMALY"))
    why = F.when(has_time & several_times, "SEVERAL_TIMES").when(lacking, "TOO_FEW_TARGET_VALUES").otherwise("NO_TARGET")
    anomalies = outcome(
        decided(lacking | several_times | low_time), F.get(sought, F.lit(0)), null, F.col("_time"), sought, why,
        [when(lacking, "TOO_FEW_TARGET_VALUES"), when(several_times, "SEVERAL_TIMES"), when(low_time, "LOW_CONFIDENCE_TIME")],
    )
    by_user = outcome(F.lit("USER_CONFIRMED"), F.col("task_"), F.col("target_"), F.col("time_"), _related(F.col("task_"), has_time), F.lit("USER_CONFIRMED"), [null])
    refused = outcome(F.lit("REFUSED"), null, F.col("target_"), F.col("time_"), F.array(), F.col("_refused"), [null])
    out = F.when(F.col("_refused").isNotNull(), refused).when(F.col("task_").isNotNull(), by_user).when(k.isNull() | lacking, anomalies).otherwise(by_target)
    return b.withColumn("_o", out).select("table_name", "_o.*", "targets", "times").withColumn("needs_confirmation", F.col("decision") == "CONFIRMATION_REQUIRED")
