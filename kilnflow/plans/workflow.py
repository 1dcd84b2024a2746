"""The whole analysis of one table: from the scan to ranked factors and a manifest, with refusals as results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnflow.operators import catalog, detectors, diagnose, evaluate, events as ev, leakage, models, prepare, profile, recommend, screening
from kilnflow.operators.prepare import PARTITION, Range, RefusedError
from kilnflow.plans.reporting import run_manifest
from kilnflow.sources import tables
from kilnflow.sources.shared import cut
from kilnflow.sources.tables import ROW_ID


@dataclass(frozen=True)
class Request:
    """What to analyse. Rows are scored by the best of ``detectors`` (names in detectors.FITS), with a target by its residuals, too.

    A target whose values look like classes is refused unless ``task`` is
    REGRESSION. ``description`` and ``industry`` (the user's choice) tell which
    names mean what; ``roles`` (column, role) win over these. An identifier
    among the features is a leak.

    With a target and ``bounds`` (variable, minimum, maximum), set-points of the
    ``controllable`` features are recommended if the run allows it: the final
    evaluation (its columns) must satisfy ``accept`` (metric, MIN or MAX, threshold).
    """

    path: str
    order_by: list[str]
    features: list[str]
    target: str | None = None
    time: str | None = None
    cohort: Range | None = None
    test: float = 0.2
    validation: float = 0.2
    max_events: int = 5
    top_factors: int = 10
    context_radius: int = 3
    bounds: tuple[tuple[str, float, float], ...] = ()
    controllable: tuple[str, ...] = ()
    accept: tuple[tuple[str, str, float], ...] = (("test_r2", "MIN", 0.0),)
    direction: str = "MAXIMIZE"
    wanted: float | None = None
    detectors: tuple[str, ...] = tuple(detectors.FITS)
    task: str | None = None
    description: str | None = None
    industry: str | None = None
    roles: tuple[tuple[str, str], ...] = ()


@dataclass
class Report:
    """Stages in the order that they ran, and the tables that they made, lazily."""

    status: str = "SUCCEEDED"
    stages: list[dict[str, Any]] = field(default_factory=list)
    results: dict[str, DataFrame] = field(default_factory=dict)
    manifest: dict[str, Any] = field(default_factory=dict)


def recommended(spark: SparkSession, request: Request, report: Report, train, scored: DataFrame, framed: DataFrame, flag: str, score: str) -> list[dict[str, str]]:
    """The stages of a recommendation from the highest-scored test row, with the model and a forest fitted on the train part; results in ``report``."""
    fitted, test = scored.filter(F.col(PARTITION) == "train"), scored.filter(F.col(PARTITION) == "test")
    start = ev.choose_operating_point(test, request.time, ROW_ID, residual=score)
    now = {f: float(v) for f, v in start.select(*request.features).first().asDict().items()}
    bounds = spark.createDataFrame(list(request.bounds), "variable string, minimum double, maximum double")
    none, current = bounds.limit(0), spark.createDataFrame(list(now.items()), "variable string, value double")
    constraints = cut(recommend.merge_constraints(bounds, none, none, current), "constraints")
    factors = cut(report.results["factors"].withColumn("controllable", F.col("feature").isin(*request.controllable)), "factors")
    final = report.results["final"]
    metrics = [m for m in dict.fromkeys(m for m, _, _ in request.accept) if m in final.columns]
    values = final.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*") if metrics else spark.createDataFrame([], "metric string, value double")
    judged = evaluate.acceptance(values, spark.createDataFrame(list(request.accept), "metric string, direction string, threshold double"))
    seen = fitted.select(F.explode(F.array(*[F.struct(F.lit(f).alias("variable"), F.col(f).cast("double").alias("v")) for f in request.features])).alias("x")).groupBy("x.variable").agg(F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
    outside = current.join(seen, "variable").filter(~F.col("value").between(F.col("lo"), F.col("hi"))).filter(F.col("variable").isin(*[b[0] for b in request.bounds]))
    reference = framed.agg(F.count_if(~diagnose.decode_flag(F.col(flag))).alias("n_reference"))
    report.results["reasons"] = cut(recommend.run_reasons(factors, reference, report.results["leakage"], final, judged, outside), "reasons")
    forest = detectors.fit_forest(fitted.select(*request.features), request.features)
    rest = F.create_map(*[x for f, v in now.items() for x in (F.lit(f), F.lit(v))])
    whole = F.map_concat(F.map_filter(rest, lambda k, _: ~F.array_contains(F.map_keys("values"), k)), "values")
    score_rows = lambda rows: recommend.score_detected(recommend.score_fitted(rows.withColumn("values", whole), train, request.features), forest)
    tables_: dict[str, DataFrame] = {}
    stages, out = recommend.run_stages(factors, constraints, score_rows, report.results["reasons"], direction=request.direction, target=request.wanted, tables=tables_)
    report.results["decision"] = tables_["decision"]
    if out is not None:
        report.results["recommendation"] = out
        if stages[-1]["status"] == "GENERATED":
            report.results["what_if"] = recommend.what_if(tables_["points"], recommend.proposal_of(tables_["ranked"]), score_rows, direction=request.direction, target=request.wanted)
    return stages


def column_facts(df: DataFrame, profiled: DataFrame) -> DataFrame:
    """What catalog.roles() needs of one table, named data, from its profile; counts of 0 for a table without rows."""
    types = [("data", i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    known = df.sparkSession.createDataFrame(types, "table_name string, place int, column_name string, dtype string")
    return known.join(profiled.select("column_name", "row_count", "null_count", "unique_count"), "column_name", "left").fillna(0, ["row_count", "null_count", "unique_count"])


def routed(spark: SparkSession, request: Request, report: Report, facts: DataFrame, done: Callable[..., None]) -> DataFrame:
    """The roles of all columns; the industry, the task and the roles are stages, and a task other than regression on a target is refused."""
    told = [("data", "file_name", request.path.rstrip("/").rsplit("/", 1)[-1])] + ([("data", "user_description", request.description)] if request.description else [])
    confirmed = spark.createDataFrame([("data", request.industry)], "table_name string, industry string") if request.industry else None
    report.results["industry"] = cut(catalog.industries(facts, spark.createDataFrame(told, "table_name string, source string, text string"), confirmed), "industry")
    industry = report.results["industry"].first()
    done("INDUSTRY_ROUTING", industry=industry.industry, decision=industry.decision)
    overrides = spark.createDataFrame([("data", *r) for r in request.roles], "table_name string, column_name string, role string")
    wrong = catalog.unknown_overrides(facts, overrides).first() if request.roles else None
    if wrong:
        raise RefusedError(wrong.reason)
    report.results["roles"] = mapped = cut(catalog.roles(facts, report.results["industry"], overrides), "roles")
    if request.target:
        asked = spark.createDataFrame([("data", None, request.target, request.time)], "table_name string, task string, target string, time_column string")
        report.results["task"] = cut(catalog.tasks(mapped, asked), "task")
        found = report.results["task"].first()
        task = request.task or found.task
        if task != "REGRESSION":
            raise RefusedError(found.reason if task is None else f"TASK_{task}")
        done("TASK_ROUTING", inferred=found.task, task=task, warnings=list(found.warnings))
    done("ROLE_MAPPING", features=len(request.features))
    return mapped


def run(spark: SparkSession, request: Request) -> Report:
    """Run all stages; a refusal ends the run and is its last stage."""
    report = Report()

    def done(stage: str, **facts: Any) -> None:
        report.stages.append({"stage": stage, "executed": True, **facts})

    stage = "LOAD"
    try:
        df = tables.load(spark, request.path, [F.col(c) for c in request.order_by])
        done(stage, columns=len(df.columns))
        stage = "PROFILE"
        report.results["profile"] = cut(profile.column_profile(df.drop(ROW_ID)), "profile")
        report.results["preview"], report.results["samples"] = profile.preview(df, ROW_ID), profile.samples(df, ROW_ID)
        facts = column_facts(df.drop(ROW_ID), report.results["profile"])
        done(stage)
        stage = "VALIDATE"
        report.results["issues"] = profile.validate(df, (ROW_ID,))
        report.results["quality"] = profile.quality_score(report.results["issues"])
        done(stage)
        if request.target:
            stage = "TARGET"
            verdict = profile.target_suitability(df, request.target).first()
            if not verdict.suitable:
                raise RefusedError(verdict.refusal_code)
            done(stage)
        stage = "COHORT_FILTER"
        if request.cohort:
            df = prepare.cohort(df, request.cohort)
            if df.isEmpty():
                raise RefusedError("EMPTY_COHORT")
        done(stage)
        stage = "ROUTING"
        mapped = routed(spark, request, report, facts, done)
        stage = "SPLIT"
        keep = [ROW_ID, *dict.fromkeys(c for c in [request.time, request.target, *request.features] if c)]
        df = df.select(*keep)
        df = prepare.split_time(df, [F.col(request.time), F.col(ROW_ID)], request.test, request.validation) if request.time else prepare.split_random(df, ROW_ID, request.test, request.validation)
        prepare.check_split(df)
        done(stage, strategy="TIME" if request.time else "RANDOM")
        stage = "PREPROCESS"
        df = prepare.impute(df, prepare.impute_values(df.filter(F.col(PARTITION) == "train"), dict.fromkeys(request.features, "median")))
        done(stage)
        stage = "LEAKAGE_CHECK"
        named = spark.createDataFrame([(f,) for f in request.features], "feature string").join(mapped.select(F.col("column_name").alias("feature"), "role"), "feature", "left")
        report.results["leakage"] = cut(leakage.check(df, ROW_ID, named, request.target, time=request.time), "leakage")
        try:
            leakage.assert_safe(report.results["leakage"])
        except leakage.LeakageError as e:
            raise RefusedError("LEAKAGE") from e
        done(stage)
        if request.target:
            stage = "MODELS"
            df = df.filter(F.col(request.target).isNotNull()).withColumn(request.target, F.col(request.target).cast("double"))
            report.results["screening"] = models.screen(df, {"linear": models.linear, "ridge": models.ridge}, request.features, request.target)
            best = report.results["screening"].filter("rank IS NOT NULL AND model <> 'mean'").orderBy("rank").first()
            if best is None:
                raise RefusedError("NO_MODEL")
            fit = {"linear": models.linear, "ridge": models.ridge}[best.model]
            train = fit(df.filter(F.col(PARTITION) == "train"), request.features, request.target)
            scored = models.predict(train, df, request.features, "_regression_prediction").withColumn("_regression_residual", F.col(request.target) - F.col("_regression_prediction"))
            report.results["metrics"] = evaluate.regression_metrics(scored.filter(F.col(PARTITION) == "test"), request.target, "_regression_prediction")
            done(stage, model=best.model)
            stage = "FINAL_EVALUATION"
            report.results["final"] = screening.final_regression(df, fit, request.features, request.target)
            done(stage)
            stage = "RESIDUAL_CALIBRATION"
            scored = evaluate.detect(scored, evaluate.calibrate(scored.filter(F.col(PARTITION) == "validation")))
            flag, score = "_is_residual_anomaly", "_residual_anomaly_score"
            done(stage)
        else:
            scored, flag, score = df, "_is_anomaly", "_anomaly_score"
        if request.detectors:
            stage = "ANOMALY_SCREENING"
            if not set(request.detectors) <= set(detectors.FITS):
                raise RefusedError("NO_SUCH_DETECTOR")
            report.results["detector_screening"], _ = screening.screen_fitted(df, request.features, {d: detectors.FITS[d] for d in request.detectors})
            chosen = report.results["detector_screening"].filter("error IS NULL").orderBy("rank").first()
            if chosen is None:
                raise RefusedError("NO_DETECTOR")
            done(stage, detector=chosen.model)
            stage = "ANOMALY_FINAL_EVALUATION"
            scored, _ = screening.final_fitted(scored, request.features, detectors.FITS[chosen.model])
            scored = cut(scored, "detected")
            report.results["detector_final"] = evaluate.score_summary(scored, "_anomaly_score", "_is_anomaly")
            done(stage)
        elif not request.target:
            raise RefusedError("NO_DETECTOR")
        stage = "EVENTS"
        test = scored.filter(F.col(PARTITION) == "test")
        report.results["scored"] = scored
        report.results["summary"] = evaluate.score_summary(scored, score, flag)
        judged = [test.select(ROW_ID, F.col(f).alias("flagged"), F.col(x).alias("score")) for f, x in [(flag, score), *([("_is_anomaly", "_anomaly_score")] if request.target and request.detectors else [])]]
        report.results["events"] = ev.select_events_of(judged, ROW_ID, request.max_events)
        done(stage)
        stage = "DIAGNOSIS"
        framed = ev.flag_top_if_none(test, flag, score, ROW_ID)
        group = diagnose.rank_factors(diagnose.group_comparison(framed, request.features, flag), "group", request.top_factors)
        report.results["factors"] = group
        if request.target:
            assoc = diagnose.rank_factors(diagnose.residual_association(framed, request.features, flag), "residual", request.top_factors)
            pick = lambda name, d, dev: d.select(F.lit(name).alias("source"), "feature", "place", "rank", "confidence", dev.alias("deviation"), "direction")
            both = pick("group", group, F.col("difference")).unionByName(pick("residual", assoc, F.col("anomaly_median") - F.col("ref_median")))
            report.results["factors"] = diagnose.fuse(both, {"group": 0.5, "residual": 0.5}, top=request.top_factors)
        order = [F.col(request.time or ROW_ID), F.col(ROW_ID)] if request.time else [F.col(ROW_ID)]
        report.results["context"] = ev.context_windows(test.select(*dict.fromkeys([ROW_ID, *([request.time] if request.time else []), *request.features])), report.results["events"].select(ROW_ID), order, request.context_radius)
        done(stage)
        if request.target and request.bounds:
            stage = "RECOMMENDATION"
            steps = recommended(spark, request, report, train, scored, framed, flag, score)
            done(stage, steps=steps)
    except RefusedError as e:
        report.status = "REFUSED"
        report.stages.append({"stage": stage, "executed": True, "refusal": str(e)})
    data = "" if stage == "LOAD" else str(tables.table_fingerprint(tables.scan(spark, request.path)).first().hash_xor)
    report.manifest = run_manifest(data, asdict(request), report.stages, report.status)
    return report
