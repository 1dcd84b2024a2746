"""Queries of screening, final evaluation, operating points, routing and small table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnflow.operators import detectors, diagnose, evaluate, events as ev, leakage, models, prepare, profile, routing, screening
from kilnflow.operators.prepare import PARTITION
from kilnflow.plans.anomaly import BASE, FEATURES, LONG, flagged, process, rounded
from kilnflow.plans.preparation import GAPS, gaps, read

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


@query(f"""WITH {BASE}, l2 AS (SELECT covar_pop(y, hour) / var_pop(hour) AS b, avg(y) - covar_pop(y, hour) / var_pop(hour) * avg(hour) AS a FROM p WHERE part <> 'test'),
v AS (SELECT sqrt(avg(r * r)) AS validation_rmse FROM q WHERE part = 'validation'),
e AS (SELECT count(*) AS n_test, sqrt(avg((y - a - b * hour) ^ 2)) AS test_rmse, avg(abs(y - a - b * hour)) AS test_mae, 1 - sum((y - a - b * hour) ^ 2) / (var_pop(y) * count(*)) AS test_r2 FROM p, l2 WHERE part = 'test')
SELECT round(validation_rmse, 6) AS validation_rmse, n_test, round(test_rmse, 6) AS test_rmse, round(test_mae, 6) AS test_mae, round(test_r2, 6) AS test_r2, round(test_rmse - validation_rmse, 6) AS generalization_gap, test_rmse > validation_rmse AS performance_degraded FROM v, e""")
def final_evaluation(spark, sf_dir):
    out = screening.final_regression(process(spark, sf_dir), models.linear, ["hour"], "y")
    return rounded(out, "validation_rmse", "test_rmse", "test_mae", "test_r2", "generalization_gap")


#: Label of events: which of three classes of value; and the classes' counts by partition.
_CLASS = f"""{BASE}, cl AS (SELECT part, CASE WHEN y > 40 THEN 'high' WHEN y > 15 THEN 'middle' ELSE 'low' END AS label FROM p),
mf AS (SELECT label AS guess FROM cl WHERE part = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)"""


def _classes(spark, sf_dir):
    y = F.col("y")
    return process(spark, sf_dir).withColumn("label", F.when(y > 40, "high").when(y > 15, "middle").otherwise("low"))


_CLASS_METRICS = """SELECT round(count(*) FILTER (label = guess) / count(*), 9) AS accuracy, round(1.0 / count(DISTINCT label), 9) AS balanced_accuracy,
round(count(*) FILTER (label = guess) / count(*) / count(DISTINCT label), 9) AS macro_precision, round(1.0 / count(DISTINCT label), 9) AS macro_recall,
round(2 * (count(*) FILTER (label = guess) / count(*)) / (1 + count(*) FILTER (label = guess) / count(*)) / count(DISTINCT label), 9) AS macro_f1 FROM cl, mf WHERE part = 'validation'"""


@query(f"WITH {_CLASS} {_CLASS_METRICS}")
def most_frequent_baseline(spark, sf_dir):
    """Metrics of the most frequent class on validation rows."""
    guessed = screening.most_frequent(_classes(spark, sf_dir), "label").filter(F.col(PARTITION) == "validation")
    m = evaluate.classification_metrics(guessed, "label", "p")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query()
def classifier_screening(spark, sf_dir):
    t = process(spark, sf_dir).withColumn("label", (F.col("y") > 20).cast("double"))
    return screening.screen_classifiers(t, {"logistic": models.logistic}, FEATURES, "label")


_DETECT = f"""{BASE}, lv AS (SELECT part, u.feature, u.v FROM (UNPIVOT (SELECT part, y, k, hour FROM p) ON y, k, hour INTO NAME feature VALUE v) u),
fs AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS sd FROM lv WHERE part IN ({{fit}}) GROUP BY feature),
dz AS (SELECT part, feature, abs(v - m) / sd AS z, abs(v - m) / sd > 1.5 AS fl FROM lv JOIN fs USING (feature))"""


@query(f"""WITH {_DETECT.format(fit="'train'")}, a AS (SELECT feature, avg(fl::INT) FILTER (part = 'train') AS ft, avg(fl::INT) FILTER (part = 'validation') AS fv, stddev_pop(z) FILTER (part = 'validation') AS sd, avg(z) FILTER (part = 'validation' AND fl) - avg(z) FILTER (part = 'validation' AND NOT fl) AS d FROM dz GROUP BY feature),
b AS (SELECT feature, ft, fv, abs(ft - fv) AS gap, sd, d, d / greatest(sd, 1e-12) AS sep, (fv < 0.001)::INT + (fv > 0.25)::INT + (abs(ft - fv) > 0.10)::INT + (sd < 1e-12)::INT + (d IS NULL)::INT + coalesce(d < 0, false)::INT AS n_flags FROM a)
SELECT feature AS model, n_flags, round(ft, 6) AS train_fraction, round(fv, 6) AS validation_fraction, round(gap, 6) AS fraction_gap, round(sd, 6) AS std_score, round(sep, 6) AS separation,
row_number() OVER (ORDER BY n_flags, d IS NULL, sep DESC NULLS LAST, gap, sd DESC, CASE feature WHEN 'y' THEN 0 WHEN 'k' THEN 1 ELSE 2 END) AS rank FROM b""")
def detector_screening(spark, sf_dir):
    t = process(spark, sf_dir)
    out = screening.screen_detectors(t, {f: (lambda df, f=f: screening.deviation_scores(df, f)) for f in ("y", "k", "hour")})
    return rounded(out, "train_fraction", "validation_fraction", "fraction_gap", "std_score", "separation").drop("registry_rank", "flags", "error")


@query(f"""WITH {_DETECT.format(fit="'train', 'validation'")} SELECT part AS _data_partition, count(*) AS n_rows, count(*) FILTER (fl) AS n_anomalies, round(avg(fl::INT), 6) AS anomaly_fraction, round(min(z), 6) AS min_score, round(max(z), 6) AS max_score, round(avg(z), 6) AS mean_score, round(stddev_pop(z), 6) AS std_score FROM dz WHERE feature = 'y' GROUP BY part""")
def detector_final(spark, sf_dir):
    out = screening.final_detection(process(spark, sf_dir), lambda df: screening.deviation_scores(df, "y", fit_on=("train", "validation")))
    return rounded(out, "anomaly_fraction", "min_score", "max_score", "mean_score", "std_score")


@query()
def ml_explanation(spark, sf_dir):
    return screening.explain(models.ridge(process(spark, sf_dir).filter(F.col(PARTITION) == "train"), FEATURES, "y"), FEATURES)


@query(f"""WITH {BASE}, o AS (SELECT event_id, ts, s, k FROM d WHERE part = 'test')
SELECT 'EXPLICIT' AS mode, (SELECT min(event_id) FROM o) AS event_id UNION ALL SELECT 'TOP_RESIDUAL', (SELECT event_id FROM o ORDER BY s DESC, event_id LIMIT 1)
UNION ALL SELECT 'TOP_UNSUPERVISED', (SELECT event_id FROM o ORDER BY k DESC, event_id LIMIT 1) UNION ALL SELECT 'LATEST', (SELECT event_id FROM o ORDER BY ts DESC, event_id LIMIT 1)""")
def starting_points(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    least = test.agg(F.min("event_id").alias("event_id"))
    pick = lambda mode, **given: ev.choose_operating_point(test, "ts", "event_id", **given).select(F.lit(mode).alias("mode"), "event_id")
    out = pick("EXPLICIT", explicit=least).unionByName(pick("TOP_RESIDUAL", residual="_residual_anomaly_score", unsupervised="k"))
    return out.unionByName(pick("TOP_UNSUPERVISED", unsupervised="k")).unionByName(pick("LATEST"))


@query(f"""WITH {BASE}, {LONG}, top AS (SELECT event_id FROM d WHERE part = 'test' AND f ORDER BY s DESC, event_id LIMIT 20), nr AS (SELECT feature, count(*) AS n FROM x WHERE NOT f GROUP BY feature),
e AS (SELECT x.event_id, x.feature, x.place, value - ref AS df, CASE WHEN mad > 1e-12 / 1.4826 THEN abs(value - ref) / (1.4826 * mad) END AS z, n FROM x JOIN top USING (event_id) JOIN md USING (feature) JOIN mad USING (feature) JOIN nr USING (feature)),
e1 AS (SELECT *, CASE WHEN z IS NULL THEN (abs(df) > 1e-12)::INT ELSE (z >= 3.5)::INT END AS prevalence FROM e),
e2 AS (SELECT *, CASE WHEN z IS NOT NULL THEN z / (z + 1) WHEN abs(df) > 1e-12 THEN prevalence ELSE 0 END * least(1.0, n / 5) * (0.5 + 0.5 * prevalence) AS confidence FROM e1),
e3 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, prevalence DESC, place) AS rank FROM e2 WHERE confidence <> 0)
SELECT feature, round(sum(1 / (60 + rank)), 9) AS rrf_score, count(*) AS occurrences, round(avg(confidence), 6) AS mean_confidence FROM e3 GROUP BY feature""")
def diag_rrf_events(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    each = diagnose.compare_events(test, FEATURES, "_is_residual_anomaly", "_residual_anomaly_score", "event_id")
    return rounded(rounded(diagnose.aggregate_rrf(each), "rrf_score", digits=9), "mean_confidence").select("feature", "rrf_score", "occurrences", "mean_confidence")


@query(f"WITH t AS (SELECT {GAPS} FROM lineitem) SELECT 'qty' AS column_name, count(*) FILTER (qty IS NULL) AS null_count FROM t UNION ALL SELECT 'flag', count(*) FILTER (flag IS NULL) FROM t UNION ALL SELECT 'nothing', count(*) FROM t")
def null_sort_keys(spark, sf_dir):
    return prepare.null_keys(gaps(spark, sf_dir), ["qty", "flag", "discount", "nothing"])


@query(f"WITH t AS (SELECT {GAPS} FROM lineitem) SELECT coalesce(flag, '__MISSING__') AS flag, count(*) AS n FROM t GROUP BY 1")
def impute_constant(spark, sf_dir):
    t = gaps(spark, sf_dir)
    return prepare.impute(t, prepare.impute_values(t, {}, {"flag": "constant"})).groupBy("flag").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey::VARCHAR AS k, l_quantity::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT o_orderpriority, NULL, count(*) FROM orders GROUP BY 1""")
def union_supertypes(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    b = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"))
    return prepare.union_relaxed(a, b).groupBy("k", "v").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events), r AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)
SELECT count(*) AS n_left, count(*) AS n_right, count(*) FILTER (s.id <> r.id) AS n_different, count(*) FILTER (s.id <> r.id) = 0 AS same FROM s JOIN r USING (place)""")
def same_sequence(spark, sf_dir):
    t = read(spark, sf_dir, "events").select("event_id", "ts")
    return prepare.same_sequence(t, [F.col("ts"), F.col("event_id")], t, [F.col("event_id")], "event_id")


@query("""SELECT event_type AS message, min(event_id) AS first_place, count(*) AS occurrences FROM events GROUP BY 1 ORDER BY 2 LIMIT 200""")
def warnings_once(spark, sf_dir):
    return prepare.first_seen(read(spark, sf_dir, "events"), "event_type", "event_id").withColumnRenamed("event_type", "message")


#: Metadata of three data sets and the keywords that are looked for, in this query only.
_META = [("fab", "column_names", "lot_id wafer-id Chamber_ID etch"), ("fab", "user_description", "Film thickness after deposition, wafer by wafer"), ("cells", "column_names", "cell_id SOH voltage"), ("cells", "file_name", "battery_run.csv"), ("other", "column_names", "a b c")]
_WORDS = {"semiconductor": ("wafer", "lot_id", "etch", "deposition"), "battery": ("battery", "cell_id", "soh")}
_META_SQL = ", ".join(f"('{d}', '{s}', '{t}')" for d, s, t in _META)
_WORD_SQL = ", ".join(f"('{i}', {n}, '{w}')" for n, (i, ws) in enumerate(_WORDS.items()) for w in ws)
_ROUTE = f"""m(dataset, source, txt) AS (VALUES {_META_SQL}), w(industry, place, word) AS (VALUES {_WORD_SQL}),
norm AS (SELECT dataset, source, ' ' || trim(regexp_replace(lower(txt), '[^0-9a-z]+', ' ', 'g')) || ' ' AS hay FROM m),
hit AS (SELECT DISTINCT dataset, source, industry, word FROM norm JOIN w ON contains(hay, ' ' || replace(word, '_', ' ') || ' ')),
sc AS (SELECT d.dataset, i.industry, i.place, coalesce(sum(CASE source WHEN 'user_description' THEN 4.0 WHEN 'column_names' THEN 2.0 WHEN 'file_name' THEN 1.0 END), 0)::DOUBLE AS score, count(h.word) AS matches
  FROM (SELECT DISTINCT dataset FROM m) d CROSS JOIN (SELECT DISTINCT industry, place FROM w) i LEFT JOIN hit h ON h.dataset = d.dataset AND h.industry = i.industry GROUP BY 1, 2, 3),
cf AS (SELECT *, round(least(1.0, score / 12), 4) AS confidence FROM sc)"""


def _scores(spark):
    return routing.score_industries(spark.createDataFrame(_META, "dataset string, source string, text string"), _WORDS)


@query(f"WITH {_ROUTE} SELECT dataset, industry, score, confidence, matches FROM cf")
def industry_scores(spark, sf_dir):
    return _scores(spark).drop("place")


@query(f"""WITH {_ROUTE}, rk AS (SELECT *, row_number() OVER w AS k, score - lead(score) OVER w AS margin FROM cf WINDOW w AS (PARTITION BY dataset ORDER BY score DESC, confidence DESC, place))
SELECT dataset, CASE WHEN dataset = 'cells' THEN 'battery' WHEN score < 1 THEN 'generic' ELSE industry END AS industry, score, confidence, margin, CASE WHEN dataset = 'cells' THEN 'USER_CONFIRMED' WHEN score < 1 THEN 'FALLBACK_GENERIC' WHEN confidence < 0.6 OR margin < 2 THEN 'CONFIRMATION_REQUIRED' ELSE 'AUTO_SELECTED' END AS decision FROM rk WHERE k = 1""")
def industry_routes(spark, sf_dir):
    confirmed = spark.createDataFrame([("cells", "battery")], "dataset string, industry string")
    return routing.route_industry(_scores(spark), confirmed)


#: Columns of events under names and types of every rule, and the role that each has to get.
_ROLES = {
    "_original_row_id": ("event_id", "IDENTIFIER", 1.0), "Chamber Temp": ("value", "STATE_SENSOR", 0.98), "temp_c": ("value", "STATE_SENSOR", 0.95), "both": ("value", "UNKNOWN", 0.0), "moment": ("ts", "TIME", 0.90),
    "recorded_at": ("cast(unix_micros(cast(ts AS timestamp)) AS long)", "TIME", 0.88), "deposition_time": ("value", "UNKNOWN", 0.0), "cycle_time_setpoint": ("value", "UNKNOWN", 0.0), "Vehicle-ID": ("user_id", "IDENTIFIER", 0.88), "id_card_type": ("value", "UNKNOWN", 0.0),
    "serial number": ("user_id", "IDENTIFIER", 0.88), "label": ("value", "TARGET_QUALITY", 0.85), "yield_pct": ("value", "UNKNOWN", 0.0), "ok": ("value > 20", "CONTEXT", 0.80), "kind": ("event_type", "CONTEXT", 0.75), "note": ("cast(event_id AS string)", "IDENTIFIER", 0.70),
    "pairs": ("cast(floor(event_id / 2) AS string)", "UNKNOWN", 0.0), "user_choice": ("value", "TARGET_QUALITY", 1.0),
}


@query("""WITH t AS (SELECT count(*) AS n, count(DISTINCT event_type) / count(*) AS few, count(DISTINCT event_id) / count(*) AS all_, count(DISTINCT event_id // 2) / count(*) AS half FROM events)
SELECT column_name, CASE WHEN column_name = 'kind' AND few > 0.2 THEN 'UNKNOWN' WHEN column_name = 'note' AND all_ < 0.9 THEN 'UNKNOWN' WHEN column_name = 'pairs' AND half >= 0.9 THEN 'IDENTIFIER' ELSE role END AS role, confidence::DOUBLE AS confidence,
role IN ('CONTROLLABLE_PROCESS', 'STATE_SENSOR', 'CONTEXT', 'DERIVED_FEATURE') AS use_in_model FROM t, (VALUES """ + ", ".join(f"('{c}', '{r}', {k})" for c, (_, r, k) in _ROLES.items()) + """) AS v(column_name, role, confidence)""")
def column_roles(spark, sf_dir):
    """Roles from the profile of a table."""
    t = read(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, (e, _, _) in _ROLES.items()])
    types = spark.createDataFrame(t.dtypes, "column_name string, dtype string")
    columns = profile.column_profile(t).select("column_name", "cardinality_ratio").join(types, "column_name")
    hints = {"temp_c": ("chamber_temp", "STATE_SENSOR"), "Both": ("pressure", "CONTROLLABLE_PROCESS"), "both_": ("quality", "TARGET_QUALITY")}
    return routing.map_roles(columns, hints, {"user_choice": "TARGET_QUALITY"}).select("column_name", "role", "confidence", "use_in_model")


#: Feature names, and the rules that they break for the target "temperature".
_NAMED = {"temperature": "TARGET_INCLUDED_AS_FEATURE", "event_id": "IDENTIFIER_INCLUDED_AS_FEATURE", "temperature_residual": "TARGET_DERIVED_FEATURE", "next_temperature": "TARGET_DERIVED_FEATURE", "lead_k": "FUTURE_DERIVED_FEATURE", "completion_time": "OUTCOME_TIMESTAMP_FEATURE"}


@query(f"""WITH {BASE}, s AS (SELECT event_id, ts, user_id, part FROM p UNION ALL SELECT event_id, ts, user_id, 'test' FROM p WHERE part = 'train' AND y > 40),
o AS (SELECT 'ORIGINAL_ROW_ID_OVERLAP' AS issue, 'event_id' AS c, event_id AS k, part FROM s UNION ALL SELECT 'GROUP_PARTITION_OVERLAP', 'user_id', user_id, part FROM s),
ov AS (SELECT issue, c, string_agg(DISTINCT part, ',' ORDER BY CASE part WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END) AS parts FROM o JOIN (SELECT issue, k FROM o GROUP BY ALL HAVING count(DISTINCT part) > 1) USING (issue, k) GROUP BY ALL),
e AS (SELECT part, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY part),
tv AS (SELECT concat_ws(',', CASE WHEN a.hi > b.lo THEN 'train' END, CASE WHEN a.hi > b.lo OR b.hi > c.lo THEN 'validation' END, CASE WHEN b.hi > c.lo THEN 'test' END) AS parts FROM e a, e b, e c WHERE a.part = 'train' AND b.part = 'validation' AND c.part = 'test'),
sm AS (SELECT CASE WHEN count(*) > 0 THEN 'test' END AS parts FROM p WHERE part = 'train' AND y > 40)
SELECT issue, c AS columns, parts AS partitions, 'BLOCKER' AS severity FROM ov UNION ALL SELECT 'TIME_ORDER_VIOLATION', 'ts', parts, 'BLOCKER' FROM tv WHERE parts <> '' UNION ALL SELECT 'SPLIT_SUMMARY_MISMATCH', 'event_id', parts, 'BLOCKER' FROM sm WHERE parts IS NOT NULL
UNION ALL SELECT v.issue, v.c, '', 'BLOCKER' FROM (VALUES {", ".join(f"('{i}', '{c}')" for c, i in _NAMED.items())}, ('FUTURE_DERIVED_FEATURE', 'next_temperature')) v(issue, c)
UNION ALL SELECT v.issue, v.c, 'train,validation,test', v.s FROM (VALUES ('PREPROCESSING_FIT_SCOPE_UNKNOWN', 'k', 'WARNING'), ('PREPROCESSING_NOT_FIT_ON_TRAINING_DATA', 'hour', 'BLOCKER')) v(issue, c, s)""")
def leakage_report(spark, sf_dir):
    """A split some of whose train rows are test rows, too, with features of telling names."""
    t = process(spark, sf_dir)
    leaky = t.unionByName(t.filter((F.col(PARTITION) == "train") & (F.col("y") > 40)).withColumn(PARTITION, F.lit("test")))
    names = [(c, "IDENTIFIER" if c == "event_id" else None) for c in (*_NAMED, "chamber_temperature", "k", "hour")]
    steps = spark.createDataFrame([(["k"], None), (["hour"], False), (["y"], True)], "columns array<string>, on_train boolean")
    report = leakage.check(leaky, "event_id", spark.createDataFrame(names, "feature string, role string"), "temperature", "user_id", "ts", steps, t)
    return report.select("issue", F.array_join("columns", ",").alias("columns"), F.array_join("partitions", ",").alias("partitions"), "severity")


@query()
def detector_screening_fitted(spark, sf_dir):
    """Isolation forest, one-class machine and robust envelope, fitted on train rows and ranked on validation."""
    return screening.screen_fitted(process(spark, sf_dir), ["y", "k", "hour"])[0]


@query()
def detector_final_fitted(spark, sf_dir):
    """Score summaries of the three detectors, refitted on train and validation."""
    t = process(spark, sf_dir)
    out = [evaluate.score_summary(screening.final_fitted(t, ["y", "k", "hour"], fit)[0], "_anomaly_score", "_is_anomaly").select(F.lit(name).alias("model"), "*") for name, fit in detectors.FITS.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH t AS (SELECT 'value' AS column_name, 'double' AS dtype, count(DISTINCT value) AS u, count(*) AS n FROM events UNION ALL SELECT 'event_type', 'string', count(DISTINCT event_type), count(*) FROM events UNION ALL SELECT 'hour', 'int', count(DISTINCT hour(ts) // 3), count(*) FROM events UNION ALL SELECT 'none', NULL, 0, count(*) FROM events)
SELECT column_name, CASE WHEN dtype IS NULL THEN 'UNSUPERVISED_ANOMALY' WHEN dtype = 'string' OR (u <= 20 AND u / n <= 0.05) THEN 'CLASSIFICATION' ELSE 'REGRESSION' END AS task, coalesce(dtype <> 'string' AND u <= 20 AND u / n <= 0.05, false) AS needs_confirmation FROM t""")
def task_routes(spark, sf_dir):
    t = read(spark, sf_dir, "events")
    counts = t.agg(F.count("*").alias("row_count"), F.count_distinct("value").alias("a"), F.count_distinct("event_type").alias("b"), F.count_distinct(F.floor(F.hour("ts") / 3)).alias("c"))
    row = lambda name, dtype, u: F.struct(F.lit(name).alias("column_name"), F.lit(dtype).cast("string").alias("dtype"), u.cast("long").alias("unique_count"))
    rows = F.array(row("value", "double", F.col("a")), row("event_type", "string", F.col("b")), row("hour", "int", F.col("c")), row("none", None, F.lit(0)))
    targets = counts.select("row_count", F.explode(rows).alias("x")).select("row_count", "x.*")
    return routing.route_task(targets).select("column_name", "task", "needs_confirmation")


@query("""WITH i AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events), e AS (SELECT 1 AS place, lo::VARCHAR AS sample_id FROM i UNION ALL SELECT 2, 'x7' UNION ALL SELECT 3, ' ' || lo FROM i UNION ALL SELECT 4, hi::VARCHAR FROM i UNION ALL SELECT 5, (hi + 1)::VARCHAR FROM i),
v AS (SELECT *, try_cast(trim(sample_id) AS BIGINT) AS row_id FROM e), j AS (SELECT v.*, min(place) OVER (PARTITION BY v.row_id) AS first_place, value > 15 AS a, event_type FROM v LEFT JOIN events ON event_id = row_id)
SELECT place, sample_id, row_id, CASE WHEN a THEN event_type END AS kind, CASE WHEN row_id IS NULL THEN 'INVALID_ID' WHEN a IS NULL THEN 'OUTSIDE' WHEN place > first_place THEN 'DUPLICATE' WHEN a THEN 'MATCHED' ELSE 'UNMATCHED' END AS verdict FROM j""")
def event_verdicts(spark, sf_dir):
    t = read(spark, sf_dir, "events")
    ends = t.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    ids = [F.col("lo").cast("string"), F.lit("x7"), F.concat(F.lit(" "), F.col("lo").cast("string")), F.col("hi").cast("string"), (F.col("hi") + 1).cast("string")]
    shown = ends.select(F.posexplode(F.array(*ids)).alias("place", "sample_id")).select((F.col("place") + 1).alias("place"), "sample_id")
    return ev.judge_events(shown, t.select(F.col("event_id").alias("row_id"), (F.col("value") > 15).alias("is_anomaly"), F.col("event_type").alias("kind")))


@query("SELECT * FROM (VALUES ('temp', 1), ('flow', 3), ('rf', 4)) t(feature, rank)")
def context_features(spark, sf_dir):
    factors = spark.createDataFrame([("flow", 3), ("temp", 1), ("gone", 2), ("temp", 5), ("rf", 4), ("_original_row_id", 6), ("time", 7)], "feature string, rank int")
    return ev.context_features(factors, ["rf", "flow", "temp", "time", "_original_row_id"], most=3)


@query(f"WITH t AS (SELECT {GAPS} FROM lineitem) SELECT 'qty' AS column_name, count(DISTINCT qty) > 1 AS chosen FROM t UNION ALL SELECT 'flag', count(DISTINCT flag) > 1 FROM t UNION ALL SELECT 'discount', count(DISTINCT discount) > 1 FROM t UNION ALL SELECT 'nothing', false")
def identifier_choice(spark, sf_dir):
    return profile.identifier_choice(gaps(spark, sf_dir), ["qty", "flag", "discount", "nothing"])


@query("SELECT * FROM (VALUES ('ridge', 'fast', 1, 0, 'industry_profile', 1), ('dummy', '', 1, 0, 'registry', 2), ('linear', '', 2, 1, 'registry', 3), ('forest', '', 3, 1, 'industry_profile', 4)) t(model, variant, priority, place, source, rank)")
def registry_merge(spark, sf_dir):
    schema = "model string, variant string, priority int, place int"
    registry = spark.createDataFrame([("dummy", "", 1, 0), ("linear", "", 2, 1), ("forest", "", 9, 2)], schema)
    own = spark.createDataFrame([("ridge", "fast", 1, 0), ("forest", "", 3, 1)], schema)
    return screening.merge_candidates(registry, own, ["model", "variant"])
