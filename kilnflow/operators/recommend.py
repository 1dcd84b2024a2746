"""Set-point recommendation: constraints, grids, scenarios, scores, ranking, what-if checks.

Every relation here is bounded by a policy limit (ten variables, five points
each, five hundred scenarios), so window functions over the whole are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnflow.sources.shared import cut

TOLERANCE, MAX_SCENARIOS, MAX_CHANGES, POINTS = 1e-12, 500, 3, 5


def _all():
    """The window over all rows of a bounded relation."""
    return Window.partitionBy()


def merge_constraints(industry: DataFrame, request: DataFrame, user: DataFrame, current: DataFrame, widen: bool = False) -> DataFrame:
    """Per variable the tightest bounds of three sources (variable, minimum, maximum): the largest minimum and least maximum.

    With ``widen`` the user's bounds take the place of the others', and
    ``widened`` tells whether either one lies beyond them. Adds room below and
    above the current value (variable, value), and status: FIXED for a span
    under the tolerance, EMPTY for crossed bounds, OUTSIDE for a current value
    beyond them, OPEN without both bounds, else RESOLVED.
    """
    names = ["variable", "minimum", "maximum"]
    tightest = lambda df: df.groupBy("variable").agg(F.max("minimum").alias("minimum"), F.min("maximum").alias("maximum"), F.count("*").alias("n_sources"))
    base = industry.select(*names).unionByName(request.select(*names))
    if widen:
        b, u = tightest(base), tightest(user.select(*names)).withColumnsRenamed({"minimum": "_lo", "maximum": "_hi", "n_sources": "_n"})
        wider = F.coalesce(F.col("_lo") < F.col("minimum"), F.lit(False)) | F.coalesce(F.col("_hi") > F.col("maximum"), F.lit(False))
        n = F.coalesce("n_sources", F.lit(0)) + F.coalesce("_n", F.lit(0))
        tight = b.join(u, "variable", "full").select("variable", F.coalesce("_lo", "minimum").alias("minimum"), F.coalesce("_hi", "maximum").alias("maximum"), n.alias("n_sources"), wider.alias("widened"))
    else:
        tight = tightest(base.unionByName(user.select(*names)))
    joined = tight.join(current.select("variable", F.col("value").alias("current_value")), "variable")
    lo, hi, v = F.col("minimum"), F.col("maximum"), F.col("current_value")
    status = F.when(lo.isNull() | hi.isNull(), "OPEN").when(lo > hi, "EMPTY").when(hi - lo < TOLERANCE, "FIXED").when((v < lo) | (v > hi), "OUTSIDE").otherwise("RESOLVED")
    return joined.withColumn("status", status).withColumn("lower_room", v - lo).withColumn("upper_room", hi - v).withColumn("relative_position", F.when(hi > lo, (v - lo) / (hi - lo)))


def safety_gate(factors: DataFrame, constraints: DataFrame, minimum_confidence: float = 0.20, most: int = 10) -> DataFrame:
    """Eligibility of ranked factors (feature, rank, confidence, controllable) under their resolved constraints, at most ``most`` in rank order."""
    joined = factors.join(constraints.select(F.col("variable").alias("feature"), "status"), "feature", "left")
    reason = F.when(~F.col("controllable"), "NOT_CONTROLLABLE").when(F.col("confidence") < minimum_confidence, "LOW_CONFIDENCE").when(F.col("status").isNull(), "NO_CONSTRAINT").when(F.col("status") != "RESOLVED", F.col("status"))
    judged = joined.withColumn("reason", reason)
    place = F.when(F.col("reason").isNull(), F.row_number().over(Window.partitionBy(F.col("reason").isNull()).orderBy("rank")))
    return judged.withColumn("reason", F.when(place > most, "OVER_LIMIT").otherwise(F.col("reason"))).withColumn("eligible", F.col("reason").isNull())


def grid_points(constraints: DataFrame, points: int = POINTS) -> DataFrame:
    """(variable, value, is_current, delta, point_index): evenly spaced values between the bounds, and the current value.

    A spaced value within the tolerance of the current one gives way to it.
    """
    lo, hi, v = F.col("minimum"), F.col("maximum"), F.col("current_value")
    spaced = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + i * (hi - lo) / (points - 1))
    kept = F.concat(F.filter(spaced, lambda x: F.abs(x - v) > TOLERANCE), F.array(v))
    rows = constraints.select("variable", (hi - lo).alias("span"), "current_value", F.posexplode(F.array_sort(kept)).alias("point_index", "value"))
    return rows.select("variable", "value", "span", (F.col("value") == F.col("current_value")).alias("is_current"), (F.col("value") - F.col("current_value")).alias("delta"), "point_index")


def scenarios(points: DataFrame, variables: list[str], most: int = MAX_SCENARIOS, changes: int = MAX_CHANGES) -> DataFrame:
    """(scenario_index, scenario_id, values, changed, change_count, magnitude): the baseline, single changes, then combinations of more.

    Variables keep their order; a variable's points come by relative distance
    from the current value, then by value. Enumeration stops at ``most``.
    """
    change = F.col("is_current") == F.lit(False)
    order = Window.partitionBy("variable").orderBy(F.abs("delta") / F.col("span"), "value")
    place = F.array_position(F.array(*map(F.lit, variables)), F.col("variable")).cast("int") if variables else F.lit(0)
    moves = points.filter(change).withColumn("k", F.row_number().over(order)).select(place.alias("place"), "variable", "k", "value", (F.abs("delta") / F.col("span")).alias("m")).filter("place > 0")
    moves = cut(moves, "moves")  # a few points of each variable
    now = points.filter("is_current").groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", "value")))).alias("current"))
    rows = now.select(F.array().cast("array<int>").alias("places"), F.array().cast("array<int>").alias("ks"), F.array().cast("array<string>").alias("changed"), F.create_map().cast("map<string,double>").alias("new"), F.lit(0.0).alias("magnitude"))
    level = rows
    for n in range(1, min(changes, len(variables)) + 1):
        # Each combination grows by the moves of later variables: a join a level, however many variables there are.
        later = F.col("place") > F.coalesce(F.try_element_at("places", F.lit(-1)), F.lit(0))
        grown = level.join(F.broadcast(moves), later)
        level = grown.select(F.array_append("places", F.col("place")).alias("places"), F.array_append("ks", F.col("k")).alias("ks"), F.array_append("changed", F.col("variable")).alias("changed"), F.map_concat("new", F.create_map("variable", "value")).alias("new"), (F.col("magnitude") + F.col("m")).alias("magnitude"))
        rows = rows.unionByName(level)
    rows = rows.withColumn("n", F.size("places"))
    indexed = rows.withColumn("scenario_index", F.row_number().over(_all().orderBy("n", "places", "ks")) - 1).filter(F.col("scenario_index") < most).crossJoin(F.broadcast(now))  # one row
    merged = F.map_concat(F.map_filter("current", lambda k, _: ~F.array_contains("changed", k)), F.col("new"))
    return indexed.select("scenario_index", F.format_string("SCN-%06d", "scenario_index").alias("scenario_id"), merged.alias("values"), "changed", F.col("n").alias("change_count"), "magnitude")


def score_linear(rows: DataFrame, coefficients: dict[str, float], intercept: float, name: str = "quality_prediction") -> DataFrame:
    """Scenario rows with the prediction of a linear model over their values, and its difference from the baseline's."""
    total: Column = F.lit(float(intercept))
    for variable, c in coefficients.items():
        total = total + F.lit(float(c)) * F.element_at("values", variable)
    scored = rows.withColumn(name, total)
    return scored.withColumn(f"{name}_delta", F.col(name) - F.max(F.when(F.col("scenario_index") == 0, F.col(name))).over(_all()))


def rank_scenarios(scored: DataFrame, objective: str = "BOTH", direction: str = "MAXIMIZE", target: float | None = None, quality_weight: float = 0.5, anomaly_weight: float = 0.5, penalty: float = 0.10, least_advantage: float = 1e-12, most: int = 5000) -> DataFrame:
    """Rank scenarios (scenario_index, change_count, magnitude, quality_prediction, anomaly_score) against the baseline, index 0.

    Improvements count where positive, relative to the best; the change penalty
    grows with the relative magnitude. A scenario is eligible if no required
    component worsens, one improves and the composite reaches the advantage.
    The baseline is always kept.
    """
    base = lambda c: F.max(F.when(F.col("scenario_index") == 0, F.col(c))).over(_all())
    quality, anomaly = objective in ("QUALITY", "BOTH"), objective in ("ANOMALY", "BOTH")
    s, b = F.col("quality_prediction"), base("quality_prediction")
    gain = {"MAXIMIZE": s - b, "MINIMIZE": b - s}.get(direction)
    gain = F.abs(b - F.lit(target)) - F.abs(s - F.lit(target)) if gain is None else gain
    baseline = F.col("scenario_index") == 0
    rows = scored.withColumn("quality_gain", (F.when(baseline, 0.0).otherwise(gain) if quality else F.lit(None).cast("double")))
    rows = rows.withColumn("anomaly_gain", (F.when(baseline, 0.0).otherwise(base("anomaly_score") - F.col("anomaly_score")) if anomaly else F.lit(None).cast("double")))
    positive = lambda c: F.greatest(F.col(c), F.lit(0.0))
    share = lambda c: F.coalesce(F.try_divide(positive(c), F.max(positive(c)).over(_all())), F.lit(0.0))
    total = quality_weight + anomaly_weight
    benefit = (quality_weight * share("quality_gain") + anomaly_weight * share("anomaly_gain")) / total if quality and anomaly else share("quality_gain" if quality else "anomaly_gain")
    rows = rows.withColumn("benefit", F.when(baseline, 0.0).otherwise(benefit))
    cost = F.coalesce(F.try_divide(F.col("magnitude"), F.max("magnitude").over(_all())), F.lit(0.0))
    rows = rows.withColumn("composite", F.when(baseline, 0.0).otherwise(F.col("benefit") - penalty * cost))
    gains = [F.col(c) for c, on in (("quality_gain", quality), ("anomaly_gain", anomaly)) if on]
    met, better = F.lit(True), F.lit(False)
    for g in gains:
        met, better = met & (g >= 0), better | (g > 0)
    rows = rows.withColumn("met", met).withColumn("eligible", ~baseline & met & better & (F.col("composite") >= least_advantage))
    keys = [F.desc("composite"), F.desc("benefit"), F.desc("met"), F.desc("eligible"), F.asc("change_count"), F.asc("magnitude"), F.asc("scenario_index")]
    kept = rows.withColumn("_k", F.row_number().over(Window.partitionBy(baseline).orderBy(*keys))).filter(baseline | (F.col("_k") < most)).drop("_k")
    return kept.withColumn("rank", F.row_number().over(_all().orderBy(*keys)))


def neighbours(points: DataFrame, proposal: DataFrame) -> DataFrame:
    """(variable, direction, value): the grid values next below and above each proposed value (variable, value)."""
    order = Window.partitionBy("variable").orderBy("value")
    near = points.select("variable", "value", F.lag("value").over(order).alias("lower"), F.lead("value").over(order).alias("upper"))
    chosen = near.join(proposal.select("variable", F.col("value").alias("p")), "variable").filter(F.abs(F.col("value") - F.col("p")) <= TOLERANCE)
    both = F.array(F.struct(F.lit("LOWER").alias("direction"), F.col("lower").alias("value")), F.struct(F.lit("UPPER").alias("direction"), F.col("upper").alias("value")))
    return chosen.select("variable", F.explode(both).alias("x")).select("variable", "x.*").filter("value IS NOT NULL")


def _stability(n: Column, better: Column, improves: Column) -> Column:
    return F.when(~improves, "NOT_IMPROVING").when(n == 0, "NO_NEIGHBORS").when(better == n, "STABLE").when(better == 0, "ISOLATED").otherwise("MIXED")


def stability(checked: DataFrame, proposal_improves: bool) -> DataFrame:
    """One row: the class of neighbour checks (improves): NOT_IMPROVING, NO_NEIGHBORS, STABLE, ISOLATED or MIXED."""
    sums = checked.agg(F.count("*").alias("n"), F.count_if("improves").alias("better"))
    return sums.select(F.col("n").alias("n_neighbours"), F.col("better").alias("n_improving"), _stability(F.col("n"), F.col("better"), F.lit(proposal_improves)).alias("stability"))


#: The stages of a recommendation, in order.
STAGES = ("SAFETY", "CONSTRAINT_RESOLUTION", "CANDIDATE_SELECTION", "GRID_GENERATION", "SCENARIO_SCORING", "SCENARIO_RANKING", "RECOMMENDATION_GENERATION")


#: Reasons against recommending anything after a run, in the order of a decision.
RUN_REASONS = ("LEAKAGE_BLOCKER", "FINAL_EVALUATION_MISSING", "MODEL_PERFORMANCE_UNACCEPTABLE", "DIAGNOSIS_CONFIDENCE_TOO_LOW", "REFERENCE_SAMPLE_TOO_SMALL", "EXTRAPOLATION_RISK")


def run_reasons(factors: DataFrame, reference: DataFrame, leakage: DataFrame | None = None, final: DataFrame | None = None, performance: DataFrame | None = None, outside: DataFrame | None = None, minimum_confidence: float = 0.20, minimum_rows: int = 5) -> DataFrame:
    """(place, reason, blocks): what the tables of a run say against a recommendation, in the order of RUN_REASONS; warnings of leakage don't block.

    ``factors`` (confidence) of the diagnosis, whose mean must reach the
    minimum (without factors it is 0); ``reference``: one row (n_reference);
    ``leakage``: the report (severity); ``final``: the final evaluation;
    ``performance``: judged rules (status), which must all be ACCEPTABLE;
    ``outside``: current values outside of what the model has seen. A final
    evaluation or a judgement that is missing or has no rows blocks, too.
    """
    spark = factors.sparkSession
    some = lambda df, what: df.agg(what.alias("holds"))
    always = spark.range(1).select(F.lit(True).alias("holds"))
    rows = F.count("*")
    checks = [
        (0, None, leakage is not None and some(leakage, F.count_if(F.col("severity") == "BLOCKER") > 0)),
        (1, None, always if final is None else some(final, rows == 0)),
        (2, None, always if performance is None else some(performance, (rows == 0) | (F.count_if(F.coalesce(F.col("status") != "ACCEPTABLE", F.lit(True))) > 0))),
        (3, None, some(factors, F.coalesce(F.avg("confidence"), F.lit(0.0)) < minimum_confidence)),
        (4, None, some(reference, F.coalesce(F.min("n_reference"), F.lit(0)) < minimum_rows)),
        (5, None, outside is not None and some(outside, rows > 0)),
        (len(RUN_REASONS), "LEAKAGE_WARNING", leakage is not None and some(leakage, F.count_if(F.col("severity") == "WARNING") > 0)),
    ]
    out = None
    for place, warning, check in checks:
        if check is not False:
            one = check.filter("holds").select(F.lit(place).alias("place"), F.lit(warning or RUN_REASONS[min(place, len(RUN_REASONS) - 1)]).alias("reason"), F.lit(warning is None).alias("blocks"))
            out = one if out is None else out.unionByName(one)
    return out


def gate_decision(judged: DataFrame, blockers: dict[str, bool] | DataFrame | None = None, warnings: tuple[str, ...] = ()) -> DataFrame:
    """One row from safety_gate(): status, number of eligible and blocked variables, and the reasons.

    REFUSED with any global blocker or no eligible variable; CAUTION with a
    warning or a blocked variable; else APPROVED. ``blockers``: reason to
    whether it holds, or the rows of run_reasons(), with warnings among them.
    """
    sums = judged.agg(F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_blocked"))
    if isinstance(blockers, DataFrame):
        ordered = F.array_sort(F.collect_list(F.when(F.col("blocks"), F.struct("place", "reason"))))  # a row per reason
        stated = blockers.agg(F.transform(ordered, lambda x: x["reason"]).alias("held"), F.coalesce(F.bool_or(~F.col("blocks")), F.lit(False)).alias("warned"))
        sums = sums.crossJoin(F.broadcast(stated))  # one row
    else:
        held = [name for name, holds in (blockers or {}).items() if holds]
        sums = sums.withColumn("held", F.array(*map(F.lit, held)).cast("array<string>")).withColumn("warned", F.lit(bool(warnings)))
    none = F.col("n_eligible") == 0
    status = F.when((F.size("held") > 0) | none, "REFUSED").when(F.col("warned") | F.lit(bool(warnings)) | (F.col("n_blocked") > 0), "CAUTION").otherwise("APPROVED")
    reasons = F.concat("held", F.when(none, F.array(F.lit("NO_ELIGIBLE_VARIABLE"))).otherwise(F.array().cast("array<string>")))
    return sums.select(status.alias("status"), "n_eligible", "n_blocked", F.array_join(reasons, ",").alias("reasons"))


def select_candidates(factors: DataFrame, judged: DataFrame, constraints: DataFrame) -> DataFrame:
    """The variables to change, in the order of their diagnosis rank: eligible by the gate and with a resolved constraint, and whether the current value stands at a bound."""
    eligible = judged.filter("eligible").select(F.col("feature").alias("_eligible"))
    resolved = constraints.filter("status = 'RESOLVED'")
    rows = factors.join(eligible, F.col("feature") == F.col("_eligible")).join(resolved, F.col("feature") == F.col("variable"))
    at = lambda bound: F.abs(F.col("current_value") - F.col(bound)) <= TOLERANCE
    return rows.select("variable", F.col("rank").alias("diagnosis_rank"), "confidence", "current_value", "minimum", "maximum", "lower_room", "upper_room", "relative_position", at("minimum").alias("at_lower_bound"), at("maximum").alias("at_upper_bound"))


def score_fitted(rows: DataFrame, model, features: list[str], name: str = "quality_prediction") -> DataFrame:
    """Scenario rows with the prediction of a fitted model over their values, and its difference from the baseline's."""
    from kilnflow.operators.models import predict

    columns = rows.columns
    scored = predict(model, rows.select("*", *[F.element_at("values", f).alias(f) for f in features]), features, name).select(*columns, name)
    return scored.withColumn(f"{name}_delta", F.col(name) - F.max(F.when(F.col("scenario_index") == 0, F.col(name))).over(_all()))


def score_detected(rows: DataFrame, fitted, name: str = "anomaly_score") -> DataFrame:
    """Scenario rows with the score of a fitted detector over their values (null where one is missing), and its difference from the baseline's."""
    from kilnflow.operators.detectors import score

    columns = rows.columns
    scored = score(fitted, rows.select("*", *[F.element_at("values", f).alias(f) for f in fitted.features])).withColumnRenamed("_anomaly_score", name).select(*columns, name)
    return scored.withColumn(f"{name}_delta", F.col(name) - F.max(F.when(F.col("scenario_index") == 0, F.col(name))).over(_all()))


def recommendation(ranked: DataFrame, decision: DataFrame) -> DataFrame:
    """One row: status, scenario, its values and gains.

    REFUSED by the gate's status; READY_FOR_OPTIMIZATION where no scenario is eligible;
    else GENERATED with the first eligible one in rank order.
    """
    best = ranked.filter("eligible").orderBy("rank").limit(1)
    named = decision.select("status").withColumnRenamed("status", "safety_status")
    joined = named.join(best, F.lit(True), "left")  # one row each
    status = F.when(F.col("safety_status") == "REFUSED", "REFUSED").when(F.col("scenario_index").isNull(), "READY_FOR_OPTIMIZATION").otherwise("GENERATED")
    shown = lambda c: F.when(status == "GENERATED", F.col(c)).alias(c)
    return joined.select(status.alias("status"), "safety_status", *[shown(c) for c in ("scenario_id", "scenario_index", "change_count", "quality_gain", "anomaly_gain", "composite")])


def run_stages(factors: DataFrame, constraints: DataFrame, score, blockers: dict[str, bool] | DataFrame | None = None, most: int = MAX_SCENARIOS, changes: int = MAX_CHANGES, direction: str = "MAXIMIZE", target: float | None = None, tables: dict[str, DataFrame] | None = None) -> tuple[list[dict], DataFrame | None]:
    """All stages from the gate to the recommendation; ``score`` adds quality_prediction and anomaly_score to scenario rows.

    ``tables``, where given, receives the decision, the grid's points and the
    ranked scenarios. Returns (stage, status) of those that ran, and the recommendation. A refusal by the gate or a lack of candidates ends the run.
    """
    done: list[dict] = []
    judged = safety_gate(factors, constraints)
    decision = gate_decision(judged, blockers)
    kept = {} if tables is None else tables
    kept["decision"] = decision
    status = decision.first().status
    done.append({"stage": STAGES[0], "status": status})
    if status == "REFUSED":
        return done, None
    n_open = constraints.filter("status = 'RESOLVED'").count()
    done.append({"stage": STAGES[1], "status": "RESOLVED" if n_open == constraints.count() else "PARTIAL"})
    candidates = select_candidates(factors, judged, constraints)
    names = [r.variable for r in candidates.orderBy("diagnosis_rank").collect()]  # ten at most
    done.append({"stage": STAGES[2], "status": "SELECTED" if names else "NO_CANDIDATES"})
    if not names:
        return done, None
    every = grid_points(constraints)
    points = every.filter(F.col("variable").isin(names) | F.col("is_current"))  # variables that stay keep their current value
    done.append({"stage": STAGES[3], "status": "GENERATED"})
    scored = cut(score(scenarios(points, names, most, changes)), "scenario-scores")
    done.append({"stage": STAGES[4], "status": "SCORED"})
    ranked = rank_scenarios(scored, direction=direction, target=target)
    kept["points"], kept["ranked"] = points, ranked
    done.append({"stage": STAGES[5], "status": "RANKED"})
    out = recommendation(ranked, decision)
    done.append({"stage": STAGES[6], "status": out.first().status})
    return done, out


def improvements(rows: DataFrame, objective: str = "BOTH", direction: str = "MAXIMIZE", target: float | None = None) -> DataFrame:
    """``rows`` (quality, reference_quality, anomaly, reference_anomaly) with improves and improves_or_matches.

    Gains within the tolerance are none. For BOTH, quality and anomaly have to
    improve, or improve or match, each. A missing value that counts gives null.
    """
    q, r = F.col("quality"), F.col("reference_quality")
    quality = {"MAXIMIZE": q - r, "MINIMIZE": r - q}.get(direction)
    quality = F.abs(r - F.lit(target)) - F.abs(q - F.lit(target)) if quality is None else quality
    gains = [g for g, on in ((quality, "QUALITY"), (F.col("reference_anomaly") - F.col("anomaly"), "ANOMALY")) if objective in (on, "BOTH")]
    known = F.lit(True)
    for g in gains:
        known = known & g.isNotNull()
    worst = F.when(known, F.least(F.lit(float("inf")), *gains))
    return rows.withColumn("improves", worst > TOLERANCE).withColumn("improves_or_matches", worst >= -TOLERANCE)


def proposal_of(ranked: DataFrame) -> DataFrame:
    """(place, variable, value): the changes of the first eligible scenario in rank order; no rows where none is eligible."""
    best = ranked.filter("eligible").orderBy("rank").limit(1)
    return best.select(F.posexplode("changed").alias("place", "variable"), "values").select("place", "variable", F.element_at("values", F.col("variable")).alias("value"))


def what_if_scenarios(points: DataFrame, proposal: DataFrame) -> DataFrame:
    """The scenarios of a check: the current values, the proposed ones, and those with one proposed value replaced by the grid value next below or above.

    ``points`` (variable, value, is_current) of all variables; ``proposal``
    (place, variable, value), a row per change, snapped to its grid point.
    Columns: place, scenario_id, kind, variable (replaced, else null), values,
    first (the place of the first scenario of equal values, to twelve places).
    A change at either end of its grid has one neighbour. Raises where a
    proposed value isn't on the grid.
    """
    order = Window.partitionBy("variable").orderBy("value")
    near = points.select("variable", "value", F.lag("value").over(order).alias("lower"), F.lead("value").over(order).alias("upper"))
    asked = proposal.select(F.col("place").cast("int").alias("change"), "variable", F.col("value").alias("asked")).join(near.withColumnRenamed("variable", "variable_"), (F.col("variable") == F.col("variable_")) & (F.abs(F.col("value") - F.col("asked")) <= TOLERANCE), "left")
    off = F.raise_error(F.concat(F.lit("a proposed value is not on the grid: "), "variable")).cast("double")
    changes = cut(asked.select("change", "variable", F.coalesce("value", off).alias("value"), "lower", "upper"), "changes")
    pairs = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    now = points.filter("is_current").agg(pairs("variable", "value").alias("current"))
    new = changes.agg(pairs("variable", "value").alias("new"))
    replaced = lambda new: F.map_concat(F.map_filter("current", lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    centre = now.crossJoin(F.broadcast(new)).select("current", replaced(F.col("new")).alias("proposed"))  # one row each
    nothing = F.lit(None).cast("string").alias("variable")
    row = lambda at, kind, values: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), nothing, F.col(values).alias("values"))
    ends = centre.select(F.explode(F.array(row(-2, "BASELINE", "current"), row(-1, "PROPOSED_CENTER", "proposed"))).alias("x")).select("x.*")
    sides = F.array(*[F.struct((2 * F.col("change") + i).alias("at"), F.lit(kind).alias("kind"), F.col(c).alias("value")) for i, (kind, c) in enumerate((("LOWER_NEIGHBOR", "lower"), ("UPPER_NEIGHBOR", "upper")))])
    moves = changes.select("variable", F.explode(sides).alias("x")).select("variable", "x.*").filter("value IS NOT NULL").crossJoin(F.broadcast(centre))  # one row
    one = moves.select("at", "kind", "variable", F.transform_values("proposed", lambda k, v: F.when(k == F.col("variable"), F.col("value")).otherwise(v)).alias("values"))
    rows = ends.unionByName(one).withColumn("place", F.row_number().over(_all().orderBy("at")) - 1)
    key = F.transform(F.array_sort(F.map_entries("values")), lambda e: F.struct(e["key"], F.round(e["value"], 12)))
    return rows.withColumn("first", F.min("place").over(Window.partitionBy(key))).select("place", F.format_string("WIF-%06d", "place").alias("scenario_id"), "kind", "variable", "values", "first")


def what_if(points: DataFrame, proposal: DataFrame, score, objective: str = "BOTH", direction: str = "MAXIMIZE", target: float | None = None) -> DataFrame:
    """what_if_scenarios() scored by ``score``, as run_stages() calls it: adds quality_prediction and anomaly_score, improves (on the current values) and improves_or_matches (the proposed ones).

    Scenarios of equal values are scored once. The current values never improve
    on themselves. A missing value that the objective counts gives null.
    """
    rows = cut(what_if_scenarios(points, proposal), "what-if")
    asked = rows.filter("place = first").withColumnRenamed("place", "scenario_index")
    scored = score(asked).select(F.col("scenario_index").alias("first"), F.col("quality_prediction").alias("quality"), F.col("anomaly_score").alias("anomaly"))
    known = cut(rows.join(scored, "first"), "what-if-scores")
    for kind, flag in (("BASELINE", "improves"), ("PROPOSED_CENTER", "improves_or_matches")):
        reference = known.filter(F.col("kind") == kind).select(F.col("quality").alias("reference_quality"), F.col("anomaly").alias("reference_anomaly"))
        judged = improvements(known.select("place", "quality", "anomaly").crossJoin(F.broadcast(reference)), objective, direction, target).select("place", flag)  # one row
        rows = rows.join(judged, "place")
    rows = rows.withColumn("improves", F.when(F.col("kind") == "BASELINE", False).otherwise(F.col("improves")))
    values = known.select("place", F.col("quality").alias("quality_prediction"), F.col("anomaly").alias("anomaly_score"))
    return rows.join(values, "place")


def what_if_verdict(checked: DataFrame) -> DataFrame:
    """One row of what_if(): scenarios, neighbours, those that improve, and the stability of the proposal."""
    near, better = F.col("kind").isin("LOWER_NEIGHBOR", "UPPER_NEIGHBOR"), F.coalesce("improves", F.lit(False))
    centre = F.coalesce(F.bool_or((F.col("kind") == "PROPOSED_CENTER") & better), F.lit(False))
    sums = checked.agg(F.count("*").alias("n_scenarios"), F.count_if(near).alias("n_neighbours"), F.count_if(near & better).alias("n_improving"), centre.alias("_improves"))
    return sums.select("n_scenarios", "n_neighbours", "n_improving", _stability(F.col("n_neighbours"), F.col("n_improving"), F.col("_improves")).alias("stability"))


def anomaly_candidates(features: DataFrame, factors: DataFrame, stated: DataFrame, constraints: DataFrame, current: DataFrame, blocked: list[str]) -> DataFrame:
    """(variable, place): what may change in a run without a target, in the order of ``features`` (variable, place).

    A variable must be among the diagnosis factors (feature), stated as
    controllable by role, confirmed and verified (variable, role, confirmed,
    verified), have two finite bounds (variable, minimum, maximum, one row
    each) that hold its current value (variable, value), and not be blocked:
    identifiers, time, excluded columns and the cohort's column.
    """
    allowed = stated.filter("confirmed AND verified AND role = 'CONTROLLABLE_PROCESS'").select("variable").distinct()
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    inside = constraints.filter(finite("minimum") & finite("maximum")).join(current, "variable").filter(F.col("value").between(F.col("minimum"), F.col("maximum"))).select("variable")
    open_ = features.filter(~F.col("variable").isin(*blocked)) if blocked else features
    diagnosed = factors.select(F.col("feature").alias("variable")).distinct()
    return open_.join(diagnosed, "variable", "left_semi").join(allowed, "variable", "left_semi").join(inside, "variable", "left_semi").select("variable", "place")
