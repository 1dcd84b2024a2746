"""Queries of calibration, detection, diagnosis, events and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnflow.operators import diagnose, evaluate, events as ev, leakage, models, prepare, recommend
from kilnflow.operators.evaluate import Calibration
from kilnflow.operators.prepare import PARTITION
from kilnflow.plans.preparation import LINE_KEY, read
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


def process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an ordered process table: target value, features k, hour and user, split by time."""
    t = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("value").cast("double").alias("y"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.hour("ts").cast("double").alias("hour"), F.col("user_id").cast("double").alias("user_id"))
    return prepare.split_time(t, [F.col("ts"), F.col("event_id")])


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of a line on the hour, scored by a calibration on validation; written once, as diagnosis reads it many times."""
    scored = cut(evaluate.residuals_of_line(process(spark, sf_dir), "hour", "y"), "residuals")
    return cut(evaluate.detect(scored, evaluate.calibrate(scored.filter(F.col(PARTITION) == "validation"))), "flagged")


FEATURES = ["k", "hour", "user_id"]
#: The same in SQL, up to the view ``d``: i, part, y, features, residual r, score s, flag f.
BASE = """t AS (SELECT event_id, ts, event_type, value::DOUBLE AS y, json_extract_string(props, '$.k')::DOUBLE AS k, hour(ts)::DOUBLE AS hour, user_id::DOUBLE AS user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
p AS (SELECT *, CASE WHEN i < n - 2 * ceil(n * 0.2) THEN 'train' WHEN i < n - ceil(n * 0.2) THEN 'validation' ELSE 'test' END AS part FROM t),
line AS (SELECT covar_pop(y, hour) / var_pop(hour) AS b, avg(y) - covar_pop(y, hour) / var_pop(hour) * avg(hour) AS a FROM p WHERE part = 'train'),
q AS (SELECT p.*, y - (a + b * hour) AS r, a + b * hour AS pred FROM p, line),
c0 AS (SELECT median(r) AS c FROM q WHERE part = 'validation'),
c1 AS (SELECT c, greatest(1.4826 * median(abs(r - c)), 1e-12) AS sc FROM q, c0 WHERE part = 'validation' GROUP BY c),
d AS (SELECT q.*, abs(r - c) AS dev, abs(r - c) / sc AS s, abs(r - c) / sc > 3.5 AS f FROM q, c1)"""
#: Long rows of the test part, and the median statistics by feature.
LONG = """x AS (SELECT event_id, f, r, s, u.feature, u.value, CASE u.feature WHEN 'k' THEN 0 WHEN 'hour' THEN 1 ELSE 2 END AS place FROM (UNPIVOT (SELECT event_id, f, r, s, k, hour, user_id FROM d WHERE part = 'test') ON k, hour, user_id INTO NAME feature VALUE value) u),
md AS (SELECT feature, any_value(place) AS place, median(value) FILTER (NOT f) AS ref, median(value) FILTER (f) AS ano FROM x GROUP BY feature),
mad AS (SELECT x.feature, median(abs(value - ref)) AS mad FROM x JOIN md USING (feature) WHERE NOT f GROUP BY x.feature),
g AS (SELECT feature, md.place, ref, ano, mad, 1.4826 * mad AS scale, count(*) FILTER (NOT f) AS n_reference, count(*) FILTER (f) AS n_anomalous,
  avg(CASE WHEN f THEN CASE WHEN 1.4826 * mad <= 1e-12 THEN (abs(value - ref) > 1e-12)::INT ELSE (abs(value - ref) / (1.4826 * mad) >= 3.5)::INT END END) AS prevalence,
  bool_or(f AND value > ref + 1e-12) AS high, bool_or(f AND value < ref - 1e-12) AS low FROM x JOIN md USING (feature) JOIN mad USING (feature) GROUP BY ALL)"""
GROUP = """gc AS (SELECT *, CASE WHEN scale > 1e-12 THEN abs(ano - ref) / scale END AS z FROM g),
gd AS (SELECT *, least(1.0, CASE WHEN scale > 1e-12 THEN z / (z + 1) WHEN abs(ano - ref) > 1e-12 THEN prevalence ELSE 0 END * least(1.0, n_reference / 5) * least(1.0, n_anomalous / 1) * (0.5 + 0.5 * prevalence)) AS confidence,
  CASE WHEN high AND low AND abs(ano - ref) <= 1e-12 THEN 'mixed' WHEN ano - ref > 1e-12 THEN 'positive' WHEN ano - ref < -1e-12 THEN 'negative' ELSE 'unknown' END AS direction FROM gc)"""
ASSOC = """rk AS (SELECT feature, value, r, s, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY feature ORDER BY r) + (count(*) OVER (PARTITION BY feature, r) - 1) / 2 AS rr, rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / 2 AS rs FROM (SELECT feature, value, round(r, 9) AS r, round(s, 9) AS s FROM x)),
co AS (SELECT feature, corr(rv, rr) AS rho_residual, corr(rv, rs) AS rho_score, count(*) AS n_rows FROM rk GROUP BY feature),
as0 AS (SELECT g.feature, g.place, ref, ano, greatest(scale, 1e-12) AS scale, n_reference, n_anomalous, rho_residual, rho_score, n_rows, abs(ano - ref) / greatest(scale, 1e-12) AS z, high, low FROM g JOIN co USING (feature)),
asp AS (SELECT x.feature, avg((abs(value - ref) / as0.scale >= 3.5)::INT) AS prevalence FROM x JOIN as0 USING (feature) WHERE f GROUP BY x.feature),
as1 AS (SELECT as0.*, prevalence, least(1.0, 0.45 * abs(rho_score) + 0.35 * z / (z + 1) + 0.20 * prevalence) AS raw_score,
  CASE WHEN high AND low AND abs(rho_residual) <= 1e-12 THEN 'mixed' WHEN rho_residual > 1e-12 THEN 'positive' WHEN rho_residual < -1e-12 THEN 'negative' ELSE 'unknown' END AS direction FROM as0 JOIN asp USING (feature)),
as2 AS (SELECT *, least(1.0, raw_score * least(1.0, n_rows / 5) * least(1.0, n_reference / 2) * least(1.0, n_anomalous / 1)) AS confidence FROM as1)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_GROUP_OUT = "SELECT feature, round(ref, 6) AS ref_median, round(ano, 6) AS anomaly_median, round(mad, 6) AS mad, round(z, 6) AS robust_z, round(prevalence, 6) AS prevalence, n_reference, n_anomalous, direction, round(confidence, 6) AS confidence"


@query(f"WITH {BASE}, {LONG}, {GROUP} {_GROUP_OUT}, row_number() OVER (ORDER BY confidence DESC, prevalence DESC, place) AS rank FROM gd WHERE confidence <> 0 QUALIFY rank <= 10")
def flagship_diagnosis(spark, sf_dir):
    """Which features differ most between residual-anomalous and normal rows in the held-out time slice."""
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    ranked = diagnose.rank_factors(diagnose.group_comparison(test, FEATURES, "_is_residual_anomaly"))
    return rounded(ranked, "ref_median", "anomaly_median", "mad", "robust_z", "prevalence", "confidence").select("feature", "ref_median", "anomaly_median", "mad", "robust_z", "prevalence", "n_reference", "n_anomalous", "direction", "confidence", "rank")


@query(f"WITH {BASE} SELECT count(*) AS n, round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(1 - sum(r * r) / (var_pop(y) * count(*)), 6) AS r2 FROM d WHERE part = 'test'")
def regression_metrics(spark, sf_dir):
    t = evaluate.residuals_of_line(process(spark, sf_dir), "hour", "y").filter(F.col(PARTITION) == "test")
    return rounded(evaluate.regression_metrics(t, "y", "_regression_prediction"), "mae", "rmse", "r2")


@query(f"WITH {BASE}, m AS (SELECT avg(y) AS mean FROM p WHERE part <> 'test') SELECT count(*) AS n, round(avg(abs(y - mean)), 6) AS mae, round(sqrt(avg((y - mean) ^ 2)), 6) AS rmse, round(1 - sum((y - mean) ^ 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p, m WHERE part = 'test'")
def mean_baseline(spark, sf_dir):
    return rounded(evaluate.mean_baseline(process(spark, sf_dir), "y"), "mae", "rmse", "r2")


@query(f"WITH {BASE} SELECT round(b, 9) AS slope, round(a, 9) AS intercept FROM line")
def fit_line(spark, sf_dir):
    return rounded(evaluate.fit_line(process(spark, sf_dir).filter(F.col(PARTITION) == "train"), "hour", "y"), "slope", "intercept", digits=9)


@query(f"WITH {BASE} SELECT round(c, 6) AS center, round(sc, 6) AS scale, 3.5 AS threshold FROM c1")
def residual_mad(spark, sf_dir):
    scored = evaluate.residuals_of_line(process(spark, sf_dir), "hour", "y")
    return rounded(evaluate.calibrate(scored.filter(F.col(PARTITION) == "validation")), "center", "scale")


_LINE = """t AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER () AS n FROM lineitem),
p AS (SELECT *, CASE WHEN i < n - 2 * ceil(n * 0.2) THEN 'train' WHEN i < n - ceil(n * 0.2) THEN 'validation' ELSE 'test' END AS part FROM t),
line AS (SELECT covar_pop(y, x) / var_pop(x) AS b, avg(y) - covar_pop(y, x) / var_pop(x) * avg(x) AS a FROM p WHERE part = 'train'),
q AS (SELECT part, y - (a + b * x) AS r FROM p, line), c0 AS (SELECT median(r) AS c FROM q WHERE part = 'validation'),
c1 AS (SELECT c, quantile_cont(abs(r - c), 0.99) AS th FROM q, c0 WHERE part = 'validation' GROUP BY c)"""


@query(f"WITH {_LINE} SELECT part AS _data_partition, count(*) AS n_rows, count(*) FILTER (abs(r - c) > th) AS n_anomalies, round(count(*) FILTER (abs(r - c) > th) / count(*), 6) AS anomaly_fraction, round(min(abs(r - c)), 4) AS min_score, round(max(abs(r - c)), 4) AS max_score, round(avg(abs(r - c)), 4) AS mean_score, round(stddev_pop(abs(r - c)), 4) AS std_score FROM q, c1 GROUP BY 1")
def residual_quantile(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select(*LINE_KEY, F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    scored = evaluate.residuals_of_line(prepare.split_time(t, [F.col(c) for c in LINE_KEY]), "x", "y")
    by = evaluate.calibrate(scored.filter(F.col(PARTITION) == "validation"), by=Calibration("QUANTILE"))
    out = evaluate.score_summary(evaluate.detect(scored, by))
    return rounded(rounded(out, "min_score", "max_score", "mean_score", "std_score", digits=4), "anomaly_fraction")


@query(f"WITH {BASE} SELECT part AS _data_partition, count(*) AS n_rows, count(*) FILTER (f) AS n_anomalies, round(count(*) FILTER (f) / count(*), 6) AS anomaly_fraction, round(min(s), 6) AS min_score, round(max(s), 6) AS max_score, round(avg(s), 6) AS mean_score, round(stddev_pop(s), 6) AS std_score FROM d GROUP BY 1")
def anomaly_fraction_by_partition(spark, sf_dir):
    return rounded(evaluate.score_summary(flagged(spark, sf_dir)), "anomaly_fraction", "min_score", "max_score", "mean_score", "std_score")


@query(f"""WITH {BASE}, a AS (SELECT avg(f::INT) FILTER (part = 'validation') AS f0, avg(f::INT) FILTER (part = 'test') AS f1, avg(s) FILTER (part = 'validation') AS m0, avg(s) FILTER (part = 'test') AS m1, stddev_pop(s) FILTER (part = 'validation') AS s0, stddev_pop(s) FILTER (part = 'test') AS s1 FROM d)
SELECT round(f1 - f0, 6) AS fraction_shift, round((m1 - m0) / s0, 6) AS mean_shift, round(s1 / s0, 6) AS std_ratio, abs((m1 - m0) / s0) > 1 AS mean_alarm, NOT (s1 / s0 BETWEEN 0.5 AND 2.0) AS std_alarm FROM a""")
def residual_shift(spark, sf_dir):
    return rounded(evaluate.shift(flagged(spark, sf_dir)), "fraction_shift", "mean_shift", "std_ratio")


@query(f"""WITH {BASE}, a AS (SELECT avg(f::INT) FILTER (part = 'train') AS ft, avg(f::INT) FILTER (part = 'validation') AS fv, min(s) FILTER (part = 'validation') AS lo, max(s) FILTER (part = 'validation') AS hi, avg(s) FILTER (part = 'validation') AS m, stddev_pop(s) FILTER (part = 'validation') AS sd, avg(s) FILTER (part = 'validation' AND f) AS ma, avg(s) FILTER (part = 'validation' AND NOT f) AS mb FROM d)
SELECT round(ft, 6) AS train_fraction, round(fv, 6) AS validation_fraction, round(abs(ft - fv), 6) AS fraction_gap, round(lo, 6) AS min_score, round(hi, 6) AS max_score, round(m, 6) AS mean_score, round(sd, 6) AS std_score, round(hi - lo, 6) AS score_range, round((ma - mb) / greatest(sd, 1e-12), 6) AS separation,
concat_ws(',', CASE WHEN fv < 0.001 THEN 'FRACTION_TOO_LOW' END, CASE WHEN fv > 0.25 THEN 'FRACTION_TOO_HIGH' END, CASE WHEN abs(ft - fv) > 0.10 THEN 'FRACTION_GAP' END, CASE WHEN sd < 1e-12 THEN 'NEARLY_CONSTANT' END, CASE WHEN ma IS NULL OR mb IS NULL THEN 'DEGENERATE' END, CASE WHEN ma < mb THEN 'NEGATIVE_SEPARATION' END) AS flags FROM a""")
def label_free_metrics(spark, sf_dir):
    m = evaluate.quality_flags(evaluate.label_free_metrics(flagged(spark, sf_dir), "_residual_anomaly_score", "_is_residual_anomaly"))
    return rounded(m, *[c for c in m.columns if c != "flags"]).withColumn("flags", F.array_join("flags", ","))


@query(f"WITH {BASE}, {LONG}, {ASSOC} SELECT feature, round(rho_residual, 6) AS rho_residual, round(rho_score, 6) AS rho_score, round(z, 6) AS group_z, round(prevalence, 6) AS prevalence, round(raw_score, 6) AS raw_score, round(confidence, 6) AS confidence, direction, row_number() OVER (ORDER BY raw_score DESC, abs(rho_score) DESC, prevalence DESC, confidence DESC, place) AS rank FROM as2")
def diag_residual_association(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    ranked = diagnose.rank_factors(diagnose.residual_association(test, FEATURES), "residual")
    names = ("rho_residual", "rho_score", "group_z", "prevalence", "raw_score", "confidence")
    return rounded(ranked, *names).select("feature", *names, "direction", "rank")


@query(f"""WITH {BASE}, {LONG}, {GROUP}, {ASSOC}, l AS (SELECT feature, place, row_number() OVER (ORDER BY confidence DESC, prevalence DESC, place) AS rank, confidence, ano - ref AS deviation, direction FROM gd WHERE confidence <> 0 UNION ALL
SELECT feature, place, row_number() OVER (ORDER BY raw_score DESC, abs(rho_score) DESC, prevalence DESC, confidence DESC, place), confidence, ano - ref, direction FROM as2 WHERE raw_score <> 0),
e AS (SELECT feature, sum(0.5 / (60 + rank)) AS rrf, count(*) AS n_sources, avg(confidence) * count(*) * 0.5 AS confidence, coalesce(sum(confidence * deviation) / nullif(sum(confidence), 0), avg(deviation)) AS deviation,
  bool_or(direction = 'mixed') OR (bool_or(direction = 'positive') AND bool_or(direction = 'negative')) AS conflict, bool_or(direction = 'positive') AS pos, bool_or(direction = 'negative') AS neg, min(place) AS place FROM l GROUP BY feature)
SELECT feature, round(rrf, 9) AS rrf_score, n_sources, round(confidence, 6) AS confidence, round(deviation, 6) AS deviation, conflict, CASE WHEN conflict THEN 'mixed' WHEN pos THEN 'positive' WHEN neg THEN 'negative' ELSE 'unknown' END AS direction, row_number() OVER (ORDER BY rrf DESC, n_sources DESC, confidence DESC, conflict, place) AS rank FROM e""")
def diag_ensemble(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    group = diagnose.rank_factors(diagnose.group_comparison(test, FEATURES, "_is_residual_anomaly")).withColumn("deviation", F.col("difference"))
    assoc = diagnose.rank_factors(diagnose.residual_association(test, FEATURES), "residual").withColumn("deviation", F.col("anomaly_median") - F.col("ref_median"))
    lists = [d.select(F.lit(name).alias("source"), "feature", "place", "rank", "confidence", "deviation", "direction") for name, d in (("group", group), ("residual", assoc))]
    fused = diagnose.fuse(lists[0].unionByName(lists[1]), {"group": 0.5, "residual": 0.5})
    return rounded(rounded(fused, "rrf_score", digits=9), "confidence", "deviation").select("feature", "rrf_score", "n_sources", "confidence", "deviation", "conflict", "direction", "rank")


@query(f"""WITH {BASE}, {LONG}, top AS (SELECT event_id FROM d WHERE part = 'test' AND f ORDER BY s DESC, event_id LIMIT 20),
nr AS (SELECT feature, count(*) AS n FROM x WHERE NOT f GROUP BY feature),
e AS (SELECT x.event_id, x.feature, x.place, value - ref AS difference, CASE WHEN mad > 1e-12 / 1.4826 THEN abs(value - ref) / (1.4826 * mad) END AS z, n FROM x JOIN top USING (event_id) JOIN md USING (feature) JOIN mad USING (feature) JOIN nr USING (feature)),
e1 AS (SELECT *, CASE WHEN z IS NULL THEN (abs(difference) > 1e-12)::INT ELSE (z >= 3.5)::INT END AS prevalence FROM e),
e2 AS (SELECT *, CASE WHEN z IS NOT NULL THEN z / (z + 1) WHEN abs(difference) > 1e-12 THEN prevalence ELSE 0 END * least(1.0, n / 5) * (0.5 + 0.5 * prevalence) AS confidence, CASE WHEN difference > 1e-12 THEN 'positive' WHEN difference < -1e-12 THEN 'negative' ELSE 'unknown' END AS direction FROM e1),
e3 AS (SELECT *, confidence / max(confidence) OVER (PARTITION BY event_id) AS norm FROM e2 WHERE confidence <> 0)
SELECT feature, round(avg(norm), 6) AS mean_score, round(avg(confidence), 6) AS mean_confidence, round(avg(difference), 6) AS mean_deviation, count(*) AS occurrences, CASE WHEN bool_or(direction = 'positive') AND bool_or(direction = 'negative') THEN 'mixed' WHEN bool_or(direction = 'positive') THEN 'positive' WHEN bool_or(direction = 'negative') THEN 'negative' ELSE 'unknown' END AS direction FROM e3 GROUP BY feature""")
def diag_top_events(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    each = diagnose.compare_events(test, FEATURES, "_is_residual_anomaly", "_residual_anomaly_score", "event_id")
    return rounded(diagnose.aggregate_events(each), "mean_score", "mean_confidence", "mean_deviation").select("feature", "mean_score", "mean_confidence", "mean_deviation", "occurrences", "direction")


_EACH = """top AS (SELECT event_id FROM d WHERE part = 'test' AND f ORDER BY s DESC, event_id LIMIT 20),
nr AS (SELECT feature, count(*) AS n_reference FROM x WHERE NOT f GROUP BY feature),
v0 AS (SELECT x.event_id, x.feature, x.place, value - ref AS difference, abs(value - ref) / greatest(1.4826 * mad, 1e-12) AS z, n_reference, n_rows, rho_residual, rho_score FROM x JOIN top USING (event_id) JOIN md USING (feature) JOIN mad USING (feature) JOIN nr USING (feature) JOIN co USING (feature)),
v1 AS (SELECT *, (z >= 3.5)::INT AS prevalence, least(1.0, 0.45 * abs(rho_score) + 0.35 * z / (z + 1) + 0.20 * (z >= 3.5)::INT) AS raw_score, CASE WHEN rho_residual > 1e-12 THEN 'positive' WHEN rho_residual < -1e-12 THEN 'negative' ELSE 'unknown' END AS direction FROM v0),
v2 AS (SELECT *, raw_score * least(1.0, n_rows / 5) * least(1.0, n_reference / 2) AS confidence, raw_score / max(raw_score) OVER (PARTITION BY event_id) AS norm, row_number() OVER (PARTITION BY event_id ORDER BY raw_score DESC, abs(rho_score) DESC, prevalence DESC, place) AS rank FROM v1 WHERE raw_score <> 0)"""


def _associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    return diagnose.associate_events(test, FEATURES, row_id="event_id")


@query(f"WITH {BASE}, {LONG}, {ASSOC}, {_EACH} SELECT event_id, feature, round(difference, 6) AS difference, round(z, 6) AS group_z, prevalence::DOUBLE AS prevalence, round(raw_score, 6) AS raw_score, round(confidence, 6) AS confidence, direction, round(norm, 6) AS normalized_score, rank FROM v2")
def diag_association_events(spark, sf_dir):
    """Residual association of each of the events of the highest residual scores."""
    names = ("difference", "group_z", "raw_score", "confidence", "normalized_score")
    return rounded(_associated(spark, sf_dir), *names).select("event_id", "feature", *names, "prevalence", "direction", "rank")


@query(f"WITH {BASE}, {LONG}, {ASSOC}, {_EACH} SELECT feature, round(avg(norm), 6) AS mean_score, round(avg(abs(rho_score)), 6) AS mean_correlation, round(avg(confidence), 6) AS mean_confidence, round(avg(difference), 6) AS mean_deviation, count(*) AS occurrences, any_value(direction) AS direction, row_number() OVER (ORDER BY avg(norm) DESC, avg(abs(rho_score)) DESC, avg(confidence) DESC, count(*) DESC, min(place)) AS rank FROM v2 GROUP BY feature")
def diag_association_top(spark, sf_dir):
    """The events' factors as one list."""
    names = ("mean_score", "mean_correlation", "mean_confidence", "mean_deviation")
    return rounded(diagnose.aggregate_events(_associated(spark, sf_dir), "residual"), *names).select("feature", *names, "occurrences", "direction", "rank")


@query(f"WITH {BASE} SELECT event_id, f AS flagged, round(s, 6) AS score, 'high' AS severity, row_number() OVER (ORDER BY f DESC, s DESC, event_id) AS rank FROM d WHERE part = 'test' AND (f OR (SELECT count(*) FROM d WHERE part = 'test' AND f) < 1) QUALIFY rank <= 5")
def events_topk(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    return rounded(ev.select_events(test, "_is_residual_anomaly", "_residual_anomaly_score", "event_id"), "score").select("event_id", "flagged", "score", "severity", "rank")


_TYPED = "h AS (SELECT event_id, part, user_id::DOUBLE / 1000 AS us, user_id % 97 = 0 AS uf FROM d)"


@query(f"""WITH {BASE}, {_TYPED}, b AS (SELECT event_id, f AS flagged, s AS score, 0 AS source FROM d WHERE part = 'test' UNION ALL SELECT event_id, uf, us, 1 FROM h WHERE part = 'test'),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY flagged DESC, source, score DESC) AS k FROM b)
SELECT event_id, flagged, round(score, 6) AS score, source::INT AS source, row_number() OVER (ORDER BY flagged DESC, score DESC, event_id) AS rank FROM o WHERE k = 1 QUALIFY rank <= 5""")
def events_mixed(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    a = test.select("event_id", F.col("_is_residual_anomaly").alias("flagged"), F.col("_residual_anomaly_score").alias("score"))
    b = test.select("event_id", (F.col("user_id") % 97 == 0).alias("flagged"), (F.col("user_id") / 1000).alias("score"))
    return rounded(ev.select_mixed_events(a, b, "event_id", least=10**6), "score").select("event_id", "flagged", "score", "source", "rank")


@query(f"""WITH {BASE}, b AS (SELECT event_id, f AS flagged, s AS score, 0 AS source FROM d WHERE part = 'test' UNION ALL SELECT event_id, user_id % 97 = 0, user_id::DOUBLE / 1000, 1 FROM d WHERE part = 'test' UNION ALL SELECT event_id, hour = 3, y, 2 FROM d WHERE part = 'test'),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY flagged DESC, source, score DESC) AS k FROM b)
SELECT event_id, flagged, round(score, 6) AS score, source::INT AS source, row_number() OVER (ORDER BY flagged DESC, score DESC, event_id) AS rank FROM o WHERE k = 1 QUALIFY rank <= 25""")
def events_of_three(spark, sf_dir):
    """The 25 foremost events of three detectors in order of priority."""
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test")
    rule = lambda flag, score: test.select("event_id", flag.alias("flagged"), score.cast("double").alias("score"))
    sources = [rule(F.col("_is_residual_anomaly"), F.col("_residual_anomaly_score")), rule(F.col("user_id") % 97 == 0, F.col("user_id") / 1000), rule(F.col("hour") == 3, F.col("y"))]
    return rounded(ev.select_events_of(sources, "event_id", most=25, least=10**6), "score").select("event_id", "flagged", "score", "source", "rank")


@query(f"WITH {BASE}, o AS (SELECT event_id, y, row_number() OVER (ORDER BY ts, event_id) AS place FROM d WHERE part = 'test'), e AS (SELECT event_id FROM d WHERE part = 'test' AND f) SELECT a.event_id, (b.place - a.place)::INT AS \"offset\", b.event_id AS row_event_id, round(b.y, 6) AS y FROM o a JOIN e USING (event_id) JOIN o b ON abs(b.place - a.place) <= 3")
def context_window(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test").select("event_id", "ts", "y", "_is_residual_anomaly")
    windows = ev.context_windows(test.select(F.col("event_id").alias("row_event_id"), "ts", "y"), test.filter("_is_residual_anomaly").select(F.col("event_id").alias("row_event_id")), [F.col("ts"), F.col("row_event_id")], row_id="row_event_id")
    return rounded(windows, "y").select("event_id", "offset", "row_event_id", "y")


@query(f"WITH {BASE}, a AS (SELECT event_id FROM d WHERE s > 3.5), b AS (SELECT event_id FROM d WHERE dev > 2 * (SELECT median(dev) FROM d) AND part <> 'train') SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NOT NULL AND b.event_id IS NOT NULL THEN 'shared' WHEN a.event_id IS NOT NULL THEN 'baseline_only' ELSE 'current_only' END AS status FROM a FULL JOIN b ON a.event_id = b.event_id")
def event_overlap(spark, sf_dir):
    from kilnflow.functions.ordering import exact_quantiles

    d = flagged(spark, sf_dir)
    m = exact_quantiles(d.select(F.lit(0).alias("g"), "_absolute_centered_residual"), "g", "_absolute_centered_residual", {"m": 0.5})
    b = d.filter(F.col(PARTITION) != "train").crossJoin(F.broadcast(m)).filter(F.col("_absolute_centered_residual") > 2 * F.col("m"))  # one row
    return ev.event_overlap(d.filter("_is_residual_anomaly"), b, "event_id")


@query("""WITH a AS (SELECT event_type AS feature, row_number() OVER (ORDER BY avg(value) DESC) AS rank FROM events GROUP BY 1), b AS (SELECT event_type AS feature, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1)
SELECT coalesce(a.feature, b.feature) AS feature, a.rank AS baseline_rank, b.rank AS current_rank, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'shared' WHEN b.rank IS NOT NULL THEN 'current_only' ELSE 'baseline_only' END AS status,
row_number() OVER (ORDER BY CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 0 WHEN b.rank IS NOT NULL THEN 1 ELSE 2 END, b.rank NULLS LAST, a.rank NULLS LAST, coalesce(a.feature, b.feature)) AS position FROM a FULL JOIN b ON a.feature = b.feature""")
def factor_overlap(spark, sf_dir):
    from pyspark.sql import Window

    t = read(spark, sf_dir, "events")
    types = Window.partitionBy(F.lit(0))  # a row per event type
    a = t.groupBy(F.col("event_type").alias("feature")).agg(F.avg("value").alias("v")).select("feature", F.row_number().over(types.orderBy(F.desc("v"))).alias("rank"), F.lit("positive").alias("direction"))
    least = t.agg(F.min("event_type").alias("m"))
    b = t.crossJoin(F.broadcast(least)).filter("event_type <> m").groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("n")).select("feature", F.row_number().over(types.orderBy(F.desc("n"), "feature")).alias("rank"), F.lit("positive").alias("direction"))
    return ev.factor_overlap(a, b).select("feature", "baseline_rank", "current_rank", "status", "position")


@query("WITH t AS (SELECT value > 50 AS f, row_number() OVER (ORDER BY ts, event_id) AS i FROM events), l AS (SELECT f, lag(f) OVER (ORDER BY i) AS p FROM t) SELECT count(*) FILTER (f) AS n_flagged, count(*) FILTER (f AND NOT coalesce(p, false)) AS n_islands FROM l")
def anomaly_islands(spark, sf_dir):
    t = read(spark, sf_dir, "events").select("ts", "event_id", (F.col("value") > 50).alias("f"))
    return ev.islands(t, "f", [F.col("ts"), F.col("event_id")])


@query(f"WITH {BASE} SELECT count(*) FILTER (f) AS n_detected, count(*) FILTER (f AND y > 150) AS n_hits, round(avg((y > 150)::INT), 9) AS base_rate, round(count(*) FILTER (f AND y > 150) / count(*) FILTER (f), 6) AS precision, round(count(*) FILTER (f AND y > 150) / count(*) FILTER (f) / avg((y > 150)::INT), 6) AS enrichment FROM d WHERE part = 'test'")
def enrichment(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test").withColumn("truth", F.col("y") > 150)
    return rounded(rounded(ev.enrichment(test, "_is_residual_anomaly", "truth"), "base_rate", digits=9), "precision", "enrichment")


@query("""WITH o AS (SELECT min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM events) SELECT plausibility, count(*) AS n FROM (SELECT CASE WHEN value < 0 OR value > 400 THEN 'OUTSIDE_DECLARED_DOMAIN' WHEN value < lo OR value > hi THEN 'OUTSIDE_OBSERVED_RANGE' ELSE 'PLAUSIBLE' END AS plausibility FROM (SELECT value::DOUBLE * 1.2 AS value FROM events), o) GROUP BY 1""")
def target_plausibility(spark, sf_dir):
    t = read(spark, sf_dir, "events")
    seen = prepare.observed_range(t, "value")
    return evaluate.plausibility(t.select((F.col("value").cast("double") * 1.2).alias("p")), "p", seen, (0.0, 400.0)).groupBy("plausibility").agg(F.count("*").alias("n"))


@query(f"""WITH {BASE}, m AS (SELECT sqrt(avg(r * r)) AS rmse, avg(abs(r)) AS mae FROM d WHERE part = 'test') SELECT 'rmse' AS metric, 'MAX' AS direction, 1000.0 AS threshold, round(rmse, 6) AS value, CASE WHEN rmse <= 1000 THEN 'ACCEPTABLE' ELSE 'UNACCEPTABLE' END AS status FROM m
UNION ALL SELECT 'mae', 'MIN', 1000.0, round(mae, 6), CASE WHEN mae >= 1000 THEN 'ACCEPTABLE' ELSE 'UNACCEPTABLE' END FROM m UNION ALL SELECT 'f1', 'MIN', 0.5, NULL, 'UNAVAILABLE'""")
def performance_acceptance(spark, sf_dir):
    m = regression_metrics(spark, sf_dir)
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("rmse", "mae")])).alias("x")).select("x.*")
    rules = spark.createDataFrame([("rmse", "MAX", 1000.0), ("mae", "MIN", 1000.0), ("f1", "MIN", 0.5)], "metric string, direction string, threshold double")
    return evaluate.acceptance(long, rules)


@query(f"WITH {BASE}, a AS (SELECT event_id, s, false AS f FROM d WHERE part = 'test'), b AS (SELECT *, row_number() OVER (ORDER BY s DESC, event_id) = 1 AS top FROM a) SELECT event_id, top AS flag FROM b")
def flag_top_if_none(spark, sf_dir):
    test = flagged(spark, sf_dir).filter(F.col(PARTITION) == "test").select("event_id", F.col("_residual_anomaly_score").alias("s"), F.lit(False).alias("flag"))
    return ev.flag_top_if_none(test, "flag", "s", "event_id").select("event_id", "flag")


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id LIMIT 1")
def operating_point(spark, sf_dir):
    return ev.latest_row(read(spark, sf_dir, "events").select("event_id", "value", "ts"), "ts", "event_id").select("event_id", "value")


#: Models that SQL can't express; rows only.
@query()
def ml_ridge(spark, sf_dir):
    t = process(spark, sf_dir).filter(F.col(PARTITION) != "test")
    model = models.ridge(t, FEATURES, "y")
    return spark.createDataFrame([(f, float(c)) for f, c in zip(FEATURES, model.coefficients)] + [("intercept", float(model.intercept))], "name string, coefficient double")


@query()
def ml_forest_regressor(spark, sf_dir):
    t = process(spark, sf_dir)
    model = models.forest_regressor(t.filter(F.col(PARTITION) != "test"), FEATURES, "y")
    return evaluate.regression_metrics(models.predict(model, t.filter(F.col(PARTITION) == "test"), FEATURES), "y", "p")


@query()
def ml_logistic(spark, sf_dir):
    t = process(spark, sf_dir).withColumn("label", (F.col("y") > 20).cast("double"))
    model = models.logistic(t.filter(F.col(PARTITION) != "test"), FEATURES, "label")
    return models.probabilities(model, t.filter(F.col(PARTITION) == "test"), FEATURES).select("event_id", "p1")


@query()
def ml_forest_classifier(spark, sf_dir):
    t = process(spark, sf_dir).withColumn("label", (F.col("y") > 20).cast("double"))
    model = models.forest_classifier(t.filter(F.col(PARTITION) != "test"), FEATURES, "label")
    return evaluate.classification_metrics(models.predict(model, t.filter(F.col(PARTITION) == "test"), FEATURES), "label", "p")


@query()
def model_screening(spark, sf_dir):
    return models.screen(process(spark, sf_dir), {"linear": models.linear, "ridge": models.ridge, "forest": models.forest_regressor}, FEATURES, "y")


@query()
def isolation_forest(spark, sf_dir):
    return models.isolation_forest(process(spark, sf_dir), ["y", *FEATURES], "event_id")


@query()
def elliptic_envelope(spark, sf_dir):
    return models.elliptic_envelope(process(spark, sf_dir), ["y", "hour"]).select("event_id", PARTITION, "_anomaly_score", "_is_anomaly")


@query()
def one_class(spark, sf_dir):
    return models.one_class(process(spark, sf_dir), ["y", *FEATURES]).select("event_id", PARTITION, "_anomaly_score", "_is_anomaly")


@query(f"""WITH {BASE}, {LONG}, {GROUP}, h AS (SELECT 0 AS place, 'LEAKAGE_BLOCKER' AS reason, EXISTS (SELECT user_id FROM p GROUP BY user_id HAVING count(DISTINCT part) > 1) AS holds
UNION ALL SELECT 2, 'MODEL_PERFORMANCE_UNACCEPTABLE', (SELECT 1 - sum(r * r) / (var_pop(y) * count(*)) FROM d WHERE part = 'test') < 0.5
UNION ALL SELECT 3, 'DIAGNOSIS_CONFIDENCE_TOO_LOW', coalesce((SELECT avg(confidence) FROM gd WHERE confidence <> 0), 0) < 0.20 UNION ALL SELECT 4, 'REFERENCE_SAMPLE_TOO_SMALL', (SELECT count(*) FROM d WHERE part = 'test' AND NOT f) < 5
UNION ALL SELECT 5, 'EXTRAPOLATION_RISK', (SELECT max(k) FROM d WHERE part = 'test') > (SELECT max(k) FROM d WHERE part = 'train')) SELECT place, reason, true AS blocks FROM h WHERE holds""")
def run_gate_reasons(spark, sf_dir):
    """What a run over events says against recommending: users in several parts, a poor line, the diagnosis, values not seen in training."""
    d = flagged(spark, sf_dir)
    test, train = d.filter(F.col(PARTITION) == "test"), d.filter(F.col(PARTITION) == "train")
    factors = diagnose.rank_factors(diagnose.group_comparison(test, FEATURES, "_is_residual_anomaly"))
    report = leakage.check(d, "event_id", spark.createDataFrame([(f, None) for f in FEATURES], "feature string, role string"), "y", group="user_id", time="ts")
    final = evaluate.regression_metrics(test, "y", "_regression_prediction")
    judged = evaluate.acceptance(final.select(F.lit("r2").alias("metric"), F.col("r2").alias("value")), spark.createDataFrame([("r2", "MIN", 0.5)], "metric string, direction string, threshold double"))
    seen = train.agg(F.max("k").alias("hi"))
    outside = test.agg(F.max("k").alias("value")).crossJoin(F.broadcast(seen)).filter("value > hi")  # one row
    return recommend.run_reasons(factors, test.agg(F.count_if(~F.col("_is_residual_anomaly")).alias("n_reference")), report, final, judged, outside)
