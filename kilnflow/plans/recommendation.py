"""Queries of constraints, grids, scenarios, scoring, ranking and what-if checks; variables and bounds come from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnflow.operators import recommend
from kilnflow.plans.preparation import read

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


VARIABLES = ["discount", "quantity", "tax"]
COEFFICIENTS = {"discount": -120.0, "quantity": 4.0, "tax": 35.5}
ANOMALY = {"discount": 2.0, "quantity": -0.05, "tax": 1.0}


def _bounds(spark: SparkSession, sf_dir: str, low: float, high: float) -> DataFrame:
    """(variable, minimum, maximum): shares of each variable's observed range."""
    t = read(spark, sf_dir, "lineitem").agg(*[f(F.col(f"l_{v}").cast("double")).alias(f"{n}_{v}") for v in VARIABLES for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda v: F.col(f"hi_{v}") - F.col(f"lo_{v}")
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), (F.col(f"lo_{v}") + low * span(v)).alias("minimum"), (F.col(f"lo_{v}") + high * span(v)).alias("maximum")) for v in VARIABLES])
    return t.select(F.explode(rows).alias("x")).select("x.*")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, value): the midpoint of each variable's observed range."""
    return _bounds(spark, sf_dir, 0.5, 0.5).select("variable", F.col("minimum").alias("value"))


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = _bounds(spark, sf_dir, 0.2, 1.0).withColumn("maximum", F.lit(None).cast("double"))
    return recommend.merge_constraints(_bounds(spark, sf_dir, 0.0, 0.9), _bounds(spark, sf_dir, 0.1, 1.0), user, _current(spark, sf_dir))


_B = """r AS (SELECT 'discount' AS variable, min(l_discount)::DOUBLE AS lo, max(l_discount)::DOUBLE AS hi FROM lineitem UNION ALL SELECT 'quantity', min(l_quantity)::DOUBLE, max(l_quantity)::DOUBLE FROM lineitem UNION ALL SELECT 'tax', min(l_tax)::DOUBLE, max(l_tax)::DOUBLE FROM lineitem),
c AS (SELECT variable, lo + 0.2::DOUBLE * (hi - lo) AS minimum, lo + 0.9::DOUBLE * (hi - lo) AS maximum, lo + 0.5::DOUBLE * (hi - lo) AS v FROM r),
pts AS (SELECT variable, value, maximum - minimum AS span, value = v AS is_current, value - v AS delta FROM (SELECT variable, minimum, maximum, v, minimum + i * (maximum - minimum) / 4 AS value FROM c, range(0, 5) t(i) WHERE abs(minimum + i * (maximum - minimum) / 4 - v) > 1e-12 UNION ALL SELECT variable, minimum, maximum, v, v FROM c)),
mv AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY abs(delta) / span, value) AS k, abs(delta) / span AS m FROM pts WHERE NOT is_current),
a AS (SELECT * FROM mv WHERE variable = 'discount'), b AS (SELECT * FROM mv WHERE variable = 'quantity'), x AS (SELECT * FROM mv WHERE variable = 'tax'),
raw AS (SELECT 0 AS n, 0 AS combo, 0 AS k0, 0 AS k1, 0 AS k2, NULL::DOUBLE AS d, NULL::DOUBLE AS q, NULL::DOUBLE AS t, 0.0::DOUBLE AS magnitude
UNION ALL SELECT 1, 0, k, 0, 0, value, NULL, NULL, m FROM a UNION ALL SELECT 1, 1, k, 0, 0, NULL, value, NULL, m FROM b UNION ALL SELECT 1, 2, k, 0, 0, NULL, NULL, value, m FROM x
UNION ALL SELECT 2, 0, a.k, b.k, 0, a.value, b.value, NULL, a.m + b.m FROM a, b UNION ALL SELECT 2, 1, a.k, x.k, 0, a.value, NULL, x.value, a.m + x.m FROM a, x UNION ALL SELECT 2, 2, b.k, x.k, 0, NULL, b.value, x.value, b.m + x.m FROM b, x
UNION ALL SELECT 3, 0, a.k, b.k, x.k, a.value, b.value, x.value, a.m + b.m + x.m FROM a, b, x),
sc AS (SELECT row_number() OVER (ORDER BY n, combo, k0, k1, k2) - 1 AS i, n, magnitude, coalesce(d, (SELECT v FROM c WHERE variable = 'discount')) AS discount, coalesce(q, (SELECT v FROM c WHERE variable = 'quantity')) AS quantity, coalesce(t, (SELECT v FROM c WHERE variable = 'tax')) AS tax FROM raw QUALIFY i < 500),
so AS (SELECT *, 10 - 120 * discount + 4 * quantity + 35.5 * tax AS quality, 0.5 + 2 * discount - 0.05 * quantity + tax AS anomaly FROM sc),
g AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE quality - (SELECT quality FROM so WHERE i = 0) END AS qg, CASE WHEN i = 0 THEN 0 ELSE (SELECT anomaly FROM so WHERE i = 0) - anomaly END AS ag FROM so),
h AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE 0.5 * coalesce(greatest(qg, 0) / nullif((SELECT max(greatest(qg, 0)) FROM g), 0), 0) + 0.5 * coalesce(greatest(ag, 0) / nullif((SELECT max(greatest(ag, 0)) FROM g), 0), 0) END AS benefit FROM g),
e AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE benefit - 0.10 * magnitude / (SELECT max(magnitude) FROM h) END AS composite FROM h),
el AS (SELECT *, i <> 0 AND qg >= 0 AND ag >= 0 AND (qg > 0 OR ag > 0) AND composite >= 1e-12 AS eligible FROM e)"""


@query(f"WITH {_B} SELECT variable, round(minimum, 9) AS minimum, round(maximum, 9) AS maximum, 3 AS n_sources, round(v, 9) AS current_value, 'RESOLVED' AS status, round(v - minimum, 9) AS lower_room, round(maximum - v, 9) AS upper_room, round((v - minimum) / (maximum - minimum), 9) AS relative_position FROM c")
def constraint_merge(spark, sf_dir):
    t = _constraints(spark, sf_dir)
    return t.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in t.dtypes])


@query(f"WITH {_B} SELECT variable, round(value, 9) AS value, is_current, round(delta, 9) AS delta, round(span, 9) AS span FROM pts")
def grid_points(spark, sf_dir):
    return recommend.grid_points(_constraints(spark, sf_dir)).select("variable", F.round("value", 9).alias("value"), "is_current", F.round("delta", 9).alias("delta"), F.round("span", 9).alias("span"))


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.scenarios(recommend.grid_points(_constraints(spark, sf_dir)), VARIABLES)


@query(f"WITH {_B} SELECT i AS scenario_index, printf('SCN-%06d', i) AS scenario_id, n AS change_count, round(magnitude, 9) AS magnitude, round(discount, 9) AS discount, round(quantity, 9) AS quantity, round(tax, 9) AS tax FROM sc")
def scenario_enumeration(spark, sf_dir):
    return _scenarios(spark, sf_dir).select(F.col("scenario_index").cast("long").alias("scenario_index"), "scenario_id", "change_count", F.round("magnitude", 9).alias("magnitude"), *[F.round(F.element_at("values", v), 9).alias(v) for v in VARIABLES])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recommend.score_linear(_scenarios(spark, sf_dir), COEFFICIENTS, 10.0)
    return recommend.score_linear(rows, ANOMALY, 0.5, "anomaly_score")


@query(f"WITH {_B} SELECT i AS scenario_index, round(quality, 6) AS quality_prediction, round(anomaly, 6) AS anomaly_score, round(qg, 6) AS quality_prediction_delta FROM g")
def scenario_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select(F.col("scenario_index").cast("long").alias("scenario_index"), F.round("quality_prediction", 6).alias("quality_prediction"), F.round("anomaly_score", 6).alias("anomaly_score"), F.round("quality_prediction_delta", 6).alias("quality_prediction_delta"))


@query(f"WITH {_B} SELECT i AS scenario_index, round(benefit, 6) AS benefit, round(composite, 6) AS composite, eligible FROM el")
def scenario_ranking(spark, sf_dir):
    ranked = recommend.rank_scenarios(_scored(spark, sf_dir))
    return ranked.select(F.col("scenario_index").cast("long").alias("scenario_index"), F.round("benefit", 6).alias("benefit"), F.round("composite", 6).alias("composite"), "eligible")


@query(f"WITH {_B}, pr AS (SELECT variable, value FROM mv WHERE k = 1), o AS (SELECT variable, value, lag(value) OVER w AS lower, lead(value) OVER w AS upper FROM pts WINDOW w AS (PARTITION BY variable ORDER BY value)), n AS (SELECT o.variable, lower, upper FROM o JOIN pr ON o.variable = pr.variable AND o.value = pr.value) SELECT variable, 'LOWER' AS direction, round(lower, 9) AS value FROM n WHERE lower IS NOT NULL UNION ALL SELECT variable, 'UPPER', round(upper, 9) FROM n WHERE upper IS NOT NULL")
def what_if_neighbours(spark, sf_dir):
    from pyspark.sql import Window

    points = recommend.grid_points(_constraints(spark, sf_dir))
    order = Window.partitionBy("variable").orderBy(F.abs("delta") / F.col("span"), "value")
    proposal = points.filter(~F.col("is_current")).withColumn("k", F.row_number().over(order)).filter("k = 1")
    return recommend.neighbours(points, proposal).withColumn("value", F.round("value", 9))


@query(f"WITH {_B} SELECT count(*) AS n_neighbours, count(*) FILTER (qg > 0) AS n_improving, CASE WHEN count(*) FILTER (qg > 0) = count(*) THEN 'STABLE' WHEN count(*) FILTER (qg > 0) = 0 THEN 'ISOLATED' ELSE 'MIXED' END AS stability FROM g WHERE n = 1")
def what_if_stability(spark, sf_dir):
    checked = _scored(spark, sf_dir).filter("change_count = 1").select((F.col("quality_prediction_delta") > 0).alias("improves"))
    return recommend.stability(checked, True)


_W = """best AS (SELECT discount, quantity, tax FROM el WHERE eligible ORDER BY composite DESC, benefit DESC, n, magnitude, i LIMIT 1),
ch AS (SELECT c.variable, CASE c.variable WHEN 'discount' THEN discount WHEN 'quantity' THEN quantity ELSE tax END AS value FROM c, best WHERE abs(CASE c.variable WHEN 'discount' THEN discount WHEN 'quantity' THEN quantity ELSE tax END - v) > 1e-12),
near AS (SELECT variable, value, lag(value) OVER w AS lower, lead(value) OVER w AS upper FROM pts WINDOW w AS (PARTITION BY variable ORDER BY value)),
nb AS (SELECT variable, kind, moved FROM (SELECT ch.variable, unnest(['LOWER_NEIGHBOR', 'UPPER_NEIGHBOR']) AS kind, unnest([lower, upper]) AS moved FROM ch JOIN near ON near.variable = ch.variable AND abs(near.value - ch.value) <= 1e-12) WHERE moved IS NOT NULL),
wi AS (SELECT 'BASELINE' AS kind, NULL AS variable, discount, quantity, tax FROM sc WHERE i = 0 UNION ALL SELECT 'PROPOSED_CENTER', NULL, discount, quantity, tax FROM best
UNION ALL SELECT kind, variable, CASE variable WHEN 'discount' THEN moved ELSE discount END, CASE variable WHEN 'quantity' THEN moved ELSE quantity END, CASE variable WHEN 'tax' THEN moved ELSE tax END FROM nb, best),
ws AS (SELECT *, 10 - 120 * discount + 4 * quantity + 35.5 * tax AS quality, 0.5 + 2 * discount - 0.05 * quantity + tax AS anomaly FROM wi),
wb AS (SELECT * FROM ws WHERE kind = 'BASELINE'), wp AS (SELECT * FROM ws WHERE kind = 'PROPOSED_CENTER'),
wc AS (SELECT ws.*, ws.kind <> 'BASELINE' AND ws.quality - wb.quality > 1e-12 AND wb.anomaly - ws.anomaly > 1e-12 AS improves, ws.quality - wp.quality >= -1e-12 AND wp.anomaly - ws.anomaly >= -1e-12 AS improves_or_matches FROM ws, wb, wp)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda rows: recommend.score_linear(recommend.score_linear(rows, COEFFICIENTS, 10.0), ANOMALY, 0.5, "anomaly_score")
    proposal = recommend.proposal_of(recommend.rank_scenarios(_scored(spark, sf_dir)))
    return recommend.what_if(recommend.grid_points(_constraints(spark, sf_dir)), proposal, score)


@query(f"WITH {_B}, {_W} SELECT kind, variable, round(discount, 9) AS discount, round(quantity, 9) AS quantity, round(tax, 9) AS tax, round(quality, 6) AS quality_prediction, round(anomaly, 6) AS anomaly_score, improves, improves_or_matches FROM wc")
def what_if_proposal(spark, sf_dir):
    """The proposed scenario and each of its neighbours, one value changed at a time."""
    t = _checked(spark, sf_dir)
    return t.select("kind", "variable", *[F.round(F.element_at("values", v), 9).alias(v) for v in VARIABLES], F.round("quality_prediction", 6).alias("quality_prediction"), F.round("anomaly_score", 6).alias("anomaly_score"), "improves", "improves_or_matches")


@query(f"WITH {_B}, {_W}, k AS (SELECT count(*) AS n_scenarios, count(*) FILTER (variable IS NOT NULL) AS n_neighbours, count(*) FILTER (variable IS NOT NULL AND improves) AS n_improving, bool_or(kind = 'PROPOSED_CENTER' AND improves) AS p FROM wc) SELECT n_scenarios, n_neighbours, n_improving, CASE WHEN NOT p THEN 'NOT_IMPROVING' WHEN n_neighbours = 0 THEN 'NO_NEIGHBORS' WHEN n_improving = n_neighbours THEN 'STABLE' WHEN n_improving = 0 THEN 'ISOLATED' ELSE 'MIXED' END AS stability FROM k")
def what_if_verdict(spark, sf_dir):
    return recommend.what_if_verdict(_checked(spark, sf_dir))


@query()
def what_if_fitted(spark, sf_dir):
    """The proposal by a regression and a forest that are fitted on the table, checked by the same fitted state."""
    from kilnflow.operators import detectors, models

    t = read(spark, sf_dir, "lineitem").select(*[F.col(f"l_{v}").cast("double").alias(v) for v in VARIABLES], F.col("l_extendedprice").cast("double").alias("y"))
    model, forest = models.linear(t, VARIABLES, "y"), detectors.fit_forest(t.select(*VARIABLES), VARIABLES)
    score = lambda rows: recommend.score_detected(recommend.score_fitted(rows, model, VARIABLES), forest)
    points = recommend.grid_points(_constraints(spark, sf_dir))
    ranked = recommend.rank_scenarios(score(recommend.scenarios(points, VARIABLES)))
    return recommend.what_if_verdict(recommend.what_if(points, recommend.proposal_of(ranked), score))


@query("""WITH f AS (SELECT * FROM (VALUES ('discount', 1, 0.9, true), ('quantity', 2, 0.1, true), ('tax', 3, 0.5, false), ('comment', 4, 0.8, true)) t(feature, rank, confidence, controllable))
SELECT feature, rank, CASE feature WHEN 'quantity' THEN 'LOW_CONFIDENCE' WHEN 'tax' THEN 'NOT_CONTROLLABLE' WHEN 'comment' THEN 'NO_CONSTRAINT' END AS reason, feature = 'discount' AS eligible FROM f""")
def safety_gate(spark, sf_dir):
    factors = spark.createDataFrame([("discount", 1, 0.9, True), ("quantity", 2, 0.1, True), ("tax", 3, 0.5, False), ("comment", 4, 0.8, True)], "feature string, rank int, confidence double, controllable boolean")
    return recommend.safety_gate(factors, _constraints(spark, sf_dir)).select("feature", "rank", "reason", "eligible")


def _factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("discount", 1, 0.9, True), ("quantity", 2, 0.6, True), ("tax", 3, 0.5, True), ("comment", 4, 0.8, True)], "feature string, rank int, confidence double, controllable boolean")


_GATE = "j AS (SELECT * FROM (VALUES ('discount', 1, 0.9::DOUBLE), ('quantity', 2, 0.6::DOUBLE), ('tax', 3, 0.5::DOUBLE)) t(feature, rank, confidence))"


@query("SELECT 'CAUTION' AS status, 3 AS n_eligible, 1 AS n_blocked, '' AS reasons UNION ALL SELECT 'REFUSED', 3, 1, 'LEAKAGE_BLOCKER' UNION ALL SELECT 'REFUSED', 0, 1, 'NO_ELIGIBLE_VARIABLE'")
def gate_decisions(spark, sf_dir):
    judged = recommend.safety_gate(_factors(spark), _constraints(spark, sf_dir))
    refused = recommend.gate_decision(judged, {"LEAKAGE_BLOCKER": True, "FINAL_EVALUATION_MISSING": False})
    return recommend.gate_decision(judged).unionByName(refused).unionByName(recommend.gate_decision(judged.filter("feature = 'comment'")))


@query(f"WITH {_B}, {_GATE} SELECT feature AS variable, rank AS diagnosis_rank, confidence, round(v, 9) AS current_value, round(minimum, 9) AS minimum, round(maximum, 9) AS maximum, round(v - minimum, 9) AS lower_room, round(maximum - v, 9) AS upper_room, round((v - minimum) / (maximum - minimum), 9) AS relative_position, abs(v - minimum) <= 1e-12 AS at_lower_bound, abs(v - maximum) <= 1e-12 AS at_upper_bound FROM j JOIN c ON c.variable = j.feature")
def candidate_selection(spark, sf_dir):
    constraints = _constraints(spark, sf_dir)
    t = recommend.select_candidates(_factors(spark), recommend.safety_gate(_factors(spark), constraints), constraints)
    return t.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in t.dtypes])


@query(f"WITH {_B}, f AS (SELECT regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE) AS b, regr_intercept(l_extendedprice::DOUBLE, l_quantity::DOUBLE) AS a FROM lineitem) SELECT i AS scenario_index, round(a + b * quantity, 4) AS quality_prediction, round(b * (quantity - (SELECT quantity FROM sc WHERE i = 0)), 4) AS quality_prediction_delta FROM sc, f")
def scenario_scores_fitted(spark, sf_dir):
    """Scenarios scored by a model that is fitted on the table."""
    from kilnflow.operators import models

    t = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("y"))
    scored = recommend.score_fitted(_scenarios(spark, sf_dir), models.linear(t, ["quantity"], "y"), ["quantity"])
    return scored.select(F.col("scenario_index").cast("long").alias("scenario_index"), F.round("quality_prediction", 4).alias("quality_prediction"), F.round("quality_prediction_delta", 4).alias("quality_prediction_delta"))


@query()
def scenario_scores_detector(spark, sf_dir):
    """Scenarios scored by a detector that is fitted on the table."""
    from kilnflow.operators import detectors

    t = read(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("double").alias("discount"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_tax").cast("double").alias("tax"))
    scored = recommend.score_detected(_scenarios(spark, sf_dir), detectors.fit_forest(t, VARIABLES))
    return scored.select("scenario_index", "scenario_id", "anomaly_score", "anomaly_score_delta")


@query(f"WITH {_B} SELECT 'GENERATED' AS status, 'CAUTION' AS safety_status, printf('SCN-%06d', i) AS scenario_id, i AS scenario_index, n AS change_count, round(qg, 6) AS quality_gain, round(ag, 6) AS anomaly_gain, round(composite, 6) AS composite FROM el WHERE eligible ORDER BY composite DESC, benefit DESC, n, magnitude, i LIMIT 1")
def recommendation_result(spark, sf_dir):
    score = lambda rows: recommend.score_linear(recommend.score_linear(rows, COEFFICIENTS, 10.0), ANOMALY, 0.5, "anomaly_score")
    _, out = recommend.run_stages(_factors(spark), _constraints(spark, sf_dir), score)
    return out.select("status", "safety_status", "scenario_id", F.col("scenario_index").cast("long").alias("scenario_index"), "change_count", *[F.round(c, 6).alias(c) for c in ("quality_gain", "anomaly_gain", "composite")])


@query("SELECT * FROM (VALUES ('SAFETY', 'CAUTION'), ('CONSTRAINT_RESOLUTION', 'RESOLVED'), ('CANDIDATE_SELECTION', 'SELECTED'), ('GRID_GENERATION', 'GENERATED'), ('SCENARIO_SCORING', 'SCORED'), ('SCENARIO_RANKING', 'RANKED'), ('RECOMMENDATION_GENERATION', 'GENERATED')) t(stage, status)")
def recommendation_stages(spark, sf_dir):
    score = lambda rows: recommend.score_linear(recommend.score_linear(rows, COEFFICIENTS, 10.0), ANOMALY, 0.5, "anomaly_score")
    done, _ = recommend.run_stages(_factors(spark), _constraints(spark, sf_dir), score)
    return spark.createDataFrame([(d["stage"], d["status"]) for d in done], "stage string, status string")


@query(f"WITH {_B} SELECT variable, round(minimum, 9) AS minimum, round(lo + 1.1::DOUBLE * (hi - lo), 9) AS maximum, 3 AS n_sources, true AS widened, 'RESOLVED' AS status FROM (SELECT variable, lo, hi, lo + 0.1::DOUBLE * (hi - lo) AS minimum FROM r)")
def constraint_widening(spark, sf_dir):
    """A user's upper bound beyond the others', with leave to widen."""
    user = _bounds(spark, sf_dir, 0.2, 1.1).withColumn("minimum", F.lit(None).cast("double"))
    t = recommend.merge_constraints(_bounds(spark, sf_dir, 0.0, 0.9), _bounds(spark, sf_dir, 0.1, 1.0), user, _current(spark, sf_dir), widen=True)
    return t.select("variable", F.round("minimum", 9).alias("minimum"), F.round("maximum", 9).alias("maximum"), "n_sources", "widened", "status")


@query(f"WITH {_B} SELECT i AS scenario_index, qg > 1e-12 AND ag > 1e-12 AS improves, qg >= -1e-12 AND ag >= -1e-12 AS improves_or_matches FROM g")
def what_if_improvements(spark, sf_dir):
    scored = _scored(spark, sf_dir).select("scenario_index", F.col("quality_prediction").alias("quality"), F.col("anomaly_score").alias("anomaly"))
    base = scored.filter("scenario_index = 0").select(F.col("quality").alias("reference_quality"), F.col("anomaly").alias("reference_anomaly"))
    out = recommend.improvements(scored.crossJoin(F.broadcast(base)))  # one row
    return out.select(F.col("scenario_index").cast("long").alias("scenario_index"), "improves", "improves_or_matches")


@query(f"""WITH {_B}, seen AS (SELECT min(l_quantity)::DOUBLE AS lo, 3 * max(l_quantity)::DOUBLE AS hi FROM lineitem), both_ AS (SELECT 'BASELINE' AS kind, quality FROM el WHERE i = 0
UNION ALL (SELECT 'PROPOSED', quality FROM el WHERE eligible ORDER BY composite DESC, benefit DESC, n, magnitude, i LIMIT 1))
SELECT kind, round(quality, 6) AS quality_prediction, CASE WHEN quality < lo OR quality > hi THEN 'OUTSIDE_OBSERVED_RANGE' ELSE 'PLAUSIBLE' END AS plausibility FROM both_, seen""")
def proposal_plausibility(spark, sf_dir):
    """Whether the predictions at the current and at the proposed values lie in the observed range."""
    from kilnflow.operators import evaluate

    ranked = recommend.rank_scenarios(_scored(spark, sf_dir))
    best = ranked.filter("eligible").orderBy("rank").limit(1).select(F.lit("PROPOSED").alias("kind"), "quality_prediction")
    both = ranked.filter("scenario_index = 0").select(F.lit("BASELINE").alias("kind"), "quality_prediction").unionByName(best)
    observed = read(spark, sf_dir, "lineitem").agg(F.min("l_quantity").cast("double").alias("minimum"), (3 * F.max("l_quantity")).cast("double").alias("maximum"))
    return evaluate.plausibility(both, "quality_prediction", observed).withColumn("quality_prediction", F.round("quality_prediction", 6))


@query("SELECT 'quantity' AS variable, 1 AS place")
def anomaly_candidates(spark, sf_dir):
    """Of discount (blocked), quantity, tax (not verified) and comment (without bounds) one may change."""
    names = [*VARIABLES, "comment"]
    features = spark.createDataFrame([(v, i) for i, v in enumerate(names)], "variable string, place int")
    stated = spark.createDataFrame([(v, "CONTROLLABLE_PROCESS", True, v != "tax") for v in names], "variable string, role string, confirmed boolean, verified boolean")
    return recommend.anomaly_candidates(features, _factors(spark), stated, _bounds(spark, sf_dir, 0.1, 0.9), _current(spark, sf_dir), ["discount"])
