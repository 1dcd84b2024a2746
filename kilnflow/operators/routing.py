"""Routing of data sets: which industry, which column roles, which task. Works on tables of column profiles, for one data set or a catalog of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Keywords of each industry.
KEYWORDS = {
    "semiconductor": ("semiconductor", "wafer", "wafer_id", "lot_id", "die_id", "lithography", "photoresist", "etch", "deposition", "chamber_id", "overlay", "critical_dimension", "film_thickness", "sheet_resistance", "fab", "반도체", "웨이퍼", "식각", "증착", "노광"),
    "battery": ("battery", "battery_cell", "cell_id", "cycle_index", "state_of_charge", "state_of_health", "soc", "soh", "cathode", "anode", "electrolyte", "charge_capacity", "discharge_capacity", "coulombic_efficiency", "formation_cycle", "배터리", "이차전지", "양극", "음극", "전해질", "충전용량", "방전용량"),
    "automotive": ("automotive", "vehicle_id", "vin", "engine_rpm", "throttle_position", "brake_pressure", "steering_angle", "wheel_speed", "fuel_rate", "exhaust", "transmission_gear", "odometer", "vehicle_speed", "자동차", "차량", "엔진회전수", "브레이크압력", "조향각", "차속", "배기가스"),
}
#: What a keyword counts in each source, and the routing thresholds.
SOURCE_WEIGHTS = {"user_description": 4.0, "column_names": 2.0, "file_name": 1.0}
FULL_SCORE, MIN_SCORE, MIN_CONFIDENCE, MIN_MARGIN = 12.0, 1.0, 0.60, 2.0
#: Numeric targets with so few values, both ways, are classes.
MAX_CLASSES, MAX_CLASS_RATIO = 20, 0.05


def normalized(text: Column) -> Column:
    """Lower case; all but digits, a-z and Hangul become single spaces; padded by one at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]+", " ")), F.lit(" "))


def score_industries(metadata: DataFrame, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> DataFrame:
    """``metadata``: (dataset, source, text). Returns (dataset, industry, score, confidence, matches).

    A keyword counts once per source, where it stands as whole words in a row.
    """
    spark = metadata.sparkSession
    listed = spark.createDataFrame([(i, k, n) for n, (i, ks) in enumerate(keywords.items()) for k in ks], "industry string, keyword string, place int")
    words = F.broadcast(listed.withColumn("needle", normalized(F.col("keyword"))))  # the fixed list
    weight = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])
    texts = metadata.filter(F.col("text").isNotNull()).withColumn("hay", normalized(F.col("text")))
    hits = texts.join(words, F.contains(F.col("hay"), F.col("needle"))).select("dataset", "source", "industry", "keyword").distinct()
    scored = hits.groupBy("dataset", "industry").agg(F.sum(weight[F.col("source")]).alias("score"), F.count("*").alias("matches"))
    every = metadata.select("dataset").distinct().crossJoin(F.broadcast(listed.select("industry", "place").distinct()))  # industries
    out = every.join(scored, ["dataset", "industry"], "left").fillna({"score": 0.0, "matches": 0})
    return out.select("dataset", "industry", "place", "score", F.round(F.least(F.lit(1.0), F.col("score") / FULL_SCORE), 4).alias("confidence"), "matches")


def route_industry(scores: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """A row per data set: USER_CONFIRMED where ``confirmed`` (dataset, industry) has it, else AUTO_SELECTED, CONFIRMATION_REQUIRED (low confidence or margin) or FALLBACK_GENERIC."""
    w = Window.partitionBy("dataset").orderBy(F.desc("score"), F.desc("confidence"), F.asc("place"))
    top = scores.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w)).filter("rank = 1")
    decision = F.when(F.col("score") < MIN_SCORE, "FALLBACK_GENERIC").when((F.col("confidence") < MIN_CONFIDENCE) | (F.col("margin") < MIN_MARGIN), "CONFIRMATION_REQUIRED").otherwise("AUTO_SELECTED")
    routed = top.select("dataset", F.when(F.col("score") < MIN_SCORE, "generic").otherwise(F.col("industry")).alias("industry"), "score", "confidence", "margin", decision.alias("decision"))
    if confirmed is None:
        return routed
    by_user = confirmed.groupBy("dataset").agg(F.min("industry").alias("_user"))
    joined = routed.join(by_user, "dataset", "left")
    return joined.withColumn("industry", F.coalesce("_user", "industry")).withColumn("decision", F.when(F.col("_user").isNotNull(), "USER_CONFIRMED").otherwise(F.col("decision"))).drop("_user")


def tokens_of(name: Column) -> Column:
    """The words of a name: runs of digits, a-z and Hangul in lower case; none for a name without any."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), "[^0-9a-z가-힣]+", " "), " "), lambda w: w != "")


#: Whole names that tell a role, and what share of distinct values makes text a context or an identifier.
TIME_NAMES = ("timestamp", "datetime", "date", "time", "event time", "measurement time", "recorded at")
IDENTIFIER_NAMES = ("id", "uuid", "vin", "serial", "serial number")
TARGET_NAMES = ("target", "label", "response", "quality target", "prediction target")
CONTEXT_RATIO, IDENTIFIER_RATIO = 0.20, 0.90
#: Roles that a model may use.
MODEL_ROLES = ("CONTROLLABLE_PROCESS", "STATE_SENSOR", "CONTEXT", "DERIVED_FEATURE")


def hints_table(spark: SparkSession, synonyms: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, canonical, role) of a dictionary name -> (canonical name, role)."""
    return spark.createDataFrame([(k, c, r) for k, (c, r) in synonyms.items()], "name string, canonical string, role string")


def map_roles(columns: DataFrame, synonyms: dict[str, tuple[str, str]] | DataFrame | None = None, overrides: dict[str, str] | DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``columns``: (column_name, dtype, cardinality_ratio) of a profile. Adds role, confidence, use_in_model, canonical and alternatives by the first rule that holds.

    ``synonyms``: (name, canonical, role) rows, joined by words of the name; a
    canonical name also stands for itself; a synonym of several roles makes the
    column UNKNOWN and lists these roles as alternatives. ``overrides``:
    (column_name, role), exact. Rules: override, row id, canonical name,
    synonym, temporal type, a name of time, a name of an identifier or one that
    ends in "id", a name of a target, Boolean, text of few values, text of
    nearly as many values as rows. A null ratio tells nothing. ``by``: columns
    that synonyms and overrides share with ``columns``, as that of the table in
    a catalog.
    """
    spark = columns.sparkSession

    def relation(given: dict | DataFrame | None, made: Callable[[dict], DataFrame]) -> DataFrame:
        if isinstance(given, DataFrame):
            return given
        return made(given or {}).withColumns({b: F.lit(None).cast(columns.schema[b].dataType) for b in by})

    hints = relation(synonyms, lambda d: hints_table(spark, d))
    given = relation(overrides, lambda d: spark.createDataFrame(list(d.items()), "column_name string, role string"))
    words = lambda c: F.array_join(tokens_of(F.col(c)), " ")
    first = lambda name: F.min(F.struct("role", "canonical")).alias(name)
    canonical = hints.select(*by, words("canonical").alias("plain_"), "role", "canonical").filter("plain_ <> ''").groupBy(*by, "plain_").agg(first("canonical_"))
    synonym = hints.select(*by, words("name").alias("plain_"), "role", "canonical").filter("plain_ <> ''").groupBy(*by, "plain_").agg(first("synonym_"), F.array_sort(F.collect_set("role")).alias("roles_"))
    by_user = given.groupBy(*by, "column_name").agg(F.min("role").alias("given_"))
    names = columns.withColumn("plain_", words("column_name"))
    if "cardinality_ratio" not in columns.columns:
        names = names.withColumn("cardinality_ratio", F.lit(None).cast("double"))
    joined = names.join(by_user, [*by, "column_name"], "left").join(canonical, [*by, "plain_"], "left").join(synonym, [*by, "plain_"], "left")
    plain, dtype, ratio = F.col("plain_"), F.col("dtype"), F.col("cardinality_ratio")
    none = F.lit(None).cast("string")

    def rule(cond: Column, role: Column | str, confidence: float, name: Column = none, others: Column | None = None) -> Column:
        role = role if isinstance(role, Column) else F.lit(role)
        return F.when(cond, F.struct(role.alias("role"), F.lit(confidence).alias("confidence"), name.alias("canonical"), (F.array().cast("array<string>") if others is None else others).alias("alternatives")))

    found = F.coalesce(
        rule(F.col("given_").isNotNull(), F.col("given_"), 1.0), rule(F.col("column_name") == "_original_row_id", "IDENTIFIER", 1.0),
        rule(F.col("canonical_").isNotNull(), F.col("canonical_.role"), 0.98, F.col("canonical_.canonical")), rule(F.size("roles_") > 1, "UNKNOWN", 0.0, others=F.col("roles_")),
        rule(F.col("synonym_").isNotNull(), F.col("synonym_.role"), 0.95, F.col("synonym_.canonical")), rule(F.regexp_like(dtype, F.lit("^(date|timestamp|time)")), "TIME", 0.90), rule(plain.isin(*TIME_NAMES), "TIME", 0.88),
        rule(plain.isin(*IDENTIFIER_NAMES) | F.regexp_like(plain, F.lit("(^| )id$")), "IDENTIFIER", 0.88), rule(plain.isin(*TARGET_NAMES), "TARGET_QUALITY", 0.85), rule(dtype == "boolean", "CONTEXT", 0.80),
        rule((dtype == "string") & (ratio <= CONTEXT_RATIO), "CONTEXT", 0.75), rule((dtype == "string") & (ratio >= IDENTIFIER_RATIO), "IDENTIFIER", 0.70), rule(F.lit(True), "UNKNOWN", 0.0),
    )
    out = joined.withColumn("_r", found).select(*columns.columns, "_r.role", "_r.confidence", "_r.canonical", "_r.alternatives")
    return out.withColumn("use_in_model", F.col("role").isin(*MODEL_ROLES))


def route_task(targets: DataFrame) -> DataFrame:
    """``targets``: (dtype, unique_count, row_count) of a target column. Adds the task and whether it needs confirmation; without a target (dtype null) anomalies are sought."""
    few = (F.col("unique_count") <= MAX_CLASSES) & (F.col("unique_count") / F.col("row_count") <= MAX_CLASS_RATIO)
    text = F.col("dtype").isin("string", "boolean")
    return targets.withColumn("task", F.when(F.col("dtype").isNull(), "UNSUPERVISED_ANOMALY").when(text | few, "CLASSIFICATION").otherwise("REGRESSION")).withColumn("needs_confirmation", F.coalesce(~text & few, F.lit(False)))


def leaky_names(spark: SparkSession, features: list[str], target: str) -> DataFrame:
    """(feature, issue) of features whose names break a rule of leakage.name_issues()."""
    from kilnflow.operators.leakage import name_issues

    return name_issues(spark.createDataFrame([(f, None) for f in features], "feature string, role string"), target).select("feature", "issue")
