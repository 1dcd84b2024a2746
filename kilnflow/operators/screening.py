"""Ranking of candidate models, baselines, and evaluation after a refit on train and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnflow.operators import detectors, evaluate, models
from kilnflow.operators.prepare import PARTITION
from kilnflow.sources.shared import cut

#: A candidate's own failures. Others, such as a lost cluster, end the screening.
FAILURES = (ValueError, TypeError, ArithmeticError, AnalysisException, IllegalArgumentException)


def _ranked(results: DataFrame, keys: list[Column]) -> DataFrame:
    """``results`` with the rank of each candidate; one that failed, without its first key, has none. A row per candidate comes in."""
    order = Window.partitionBy(F.lit(0)).orderBy(*keys)
    return results.withColumn("rank", F.row_number().over(order))


def rank_regressors(results: DataFrame) -> DataFrame:
    """(model, rmse, mae, r2, registry_rank) by RMSE, MAE, R2 where there is one, and place in the registry; failed ones (no rmse) come last and have no rank."""
    ranked = _ranked(results, [F.asc_nulls_last("rmse"), F.asc_nulls_last("mae"), F.desc_nulls_last("r2"), F.asc("registry_rank")])
    return ranked.withColumn("rank", F.when(F.col("rmse").isNotNull(), F.col("rank")))


def rank_classifiers(results: DataFrame) -> DataFrame:
    """(model, macro_f1, balanced_accuracy, accuracy, registry_rank) by these, highest first; failed ones (no macro_f1) have no rank."""
    ranked = _ranked(results, [F.desc_nulls_last("macro_f1"), F.desc_nulls_last("balanced_accuracy"), F.desc_nulls_last("accuracy"), F.asc("registry_rank")])
    return ranked.withColumn("rank", F.when(F.col("macro_f1").isNotNull(), F.col("rank")))


def rank_detectors(results: DataFrame) -> DataFrame:
    """Detectors by penalties (``n_flags``), those with normal and anomalous validation rows first (others have no separation), separation, fraction gap, spread of scores (wide first), place in the registry."""
    degenerate = F.col("separation").isNull()
    return _ranked(results, [F.asc("n_flags"), degenerate.asc(), F.desc_nulls_last("separation"), F.asc_nulls_last("fraction_gap"), F.desc_nulls_last("std_score"), F.asc("registry_rank")])


def most_frequent(df: DataFrame, label: str, fit_on: tuple[str, ...] = ("train",)) -> DataFrame:
    """``df`` with ``p``: the most frequent label of the fitted partitions, the least among equals; nulls don't count."""
    counts = df.filter(F.col(PARTITION).isin(*fit_on) & F.col(label).isNotNull()).groupBy(F.col(label).alias("p")).agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(counts.orderBy(F.desc("_n"), F.asc("p")).limit(1).select("p")))  # one row


def screen_classifiers(df: DataFrame, candidates: dict[str, Callable], features: list[str], label: str) -> DataFrame:
    """Fit each candidate on train and rank by metrics on validation; the most frequent label is the baseline, the first of the registry. A failure is a row with an error."""
    df = cut(df, "classifiers")
    valid = df.filter(F.col(PARTITION) == "validation")
    names = ("macro_f1", "balanced_accuracy", "accuracy")
    rows: list[tuple] = []
    for place, (name, fit) in enumerate([("most_frequent", None), *candidates.items()]):
        try:
            guessed = most_frequent(df, label).filter(F.col(PARTITION) == "validation") if fit is None else models.predict(fit(df.filter(F.col(PARTITION) == "train"), features, label), valid, features)
            m = evaluate.classification_metrics(guessed, label, "p").first()
            rows.append((name, *[float(m[n]) for n in names], place, None))
        except FAILURES as e:  # a candidate's failure is its result
            rows.append((name, None, None, None, place, str(e)[:200]))
    return rank_classifiers(df.sparkSession.createDataFrame(rows, "model string, macro_f1 double, balanced_accuracy double, accuracy double, registry_rank int, error string"))


def final_regression(df: DataFrame, fit: Callable, features: list[str], target: str) -> DataFrame:
    """One row: validation RMSE of the model fitted on train, test metrics of it refitted on train and validation, their gap and whether the test is worse."""
    df = cut(df, "final")

    def metrics(fit_on: tuple[str, ...], on: str) -> DataFrame:
        model = fit(df.filter(F.col(PARTITION).isin(*fit_on)), features, target)
        return evaluate.regression_metrics(models.predict(model, df.filter(F.col(PARTITION) == on), features), target, "p")

    before = metrics(("train",), "validation").select(F.col("rmse").alias("validation_rmse"))
    after = metrics(("train", "validation"), "test").select(F.col("n").alias("n_test"), F.col("rmse").alias("test_rmse"), F.col("mae").alias("test_mae"), F.col("r2").alias("test_r2"))
    gap = F.col("test_rmse") - F.col("validation_rmse")
    return before.crossJoin(after).withColumn("generalization_gap", gap).withColumn("performance_degraded", gap > 0)  # one row each


def final_classification(df: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """One row from the metrics of classification_metrics(): the gap is how far F1 falls from validation to test."""
    both = validation.select(F.col("macro_f1").alias("validation_f1")).crossJoin(test.select(F.col("macro_f1").alias("test_f1")))
    gap = F.col("validation_f1") - F.col("test_f1")
    return both.withColumn("generalization_gap", gap).withColumn("performance_degraded", gap > 0)


def deviation_scores(df: DataFrame, feature: str, threshold: float = 1.5, fit_on: tuple[str, ...] = ("train",)) -> DataFrame:
    """``df`` with _anomaly_score, the distance of ``feature`` from the fitted mean in fitted deviations, and _is_anomaly beyond ``threshold``; a constant feature scores 0."""
    stats = df.filter(F.col(PARTITION).isin(*fit_on)).agg(F.avg(feature).alias("_m"), F.stddev_pop(feature).alias("_s"))
    scored = df.crossJoin(F.broadcast(stats))  # one row
    score = F.when(F.col("_s") > evaluate.MIN_SCALE, F.abs(F.col(feature) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return scored.withColumn("_anomaly_score", score).withColumn("_is_anomaly", F.col("_anomaly_score") > threshold).drop("_m", "_s")


def screen_detectors(df: DataFrame, candidates: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Score by each detector (a function that adds _anomaly_score and _is_anomaly, fitted on train) and rank by label-free metrics on train and validation.

    Test rows take no part. A detector that fails is a row with an error, after all others.
    """
    known = cut(df.filter(F.col(PARTITION) != "test"), "detectors")
    rows: list[tuple] = []
    names = ("train_fraction", "validation_fraction", "fraction_gap", "std_score", "separation")
    for place, (name, detect) in enumerate(candidates.items()):
        try:
            m = evaluate.quality_flags(evaluate.label_free_metrics(detect(known), "_anomaly_score", "_is_anomaly")).first()
            rows.append((name, place, len(m.flags), *[None if m[n] is None else float(m[n]) for n in names], ",".join(m.flags), None))
        except FAILURES as e:  # a candidate's failure is its result
            rows.append((name, place, 1_000, None, None, None, None, None, None, str(e)[:200]))
    schema = "model string, registry_rank int, n_flags int, " + ", ".join(f"{n} double" for n in names) + ", flags string, error string"
    return rank_detectors(df.sparkSession.createDataFrame(rows, schema))


def screen_fitted(df: DataFrame, features: list[str], fits: dict[str, Callable[[DataFrame, list[str]], detectors.Fitted]] = detectors.FITS) -> tuple[DataFrame, detectors.Fitted | None]:
    """Detectors fitted on train rows alone, scored on train and validation and ranked as in screen_detectors(); and the fitted first one (None if all fail)."""
    done: dict[str, detectors.Fitted] = {}

    def detect(name: str, fit: Callable) -> Callable[[DataFrame], DataFrame]:
        def run(known: DataFrame) -> DataFrame:
            done[name] = fit(known.filter(F.col(PARTITION) == "train"), features)
            return detectors.score(done[name], known)

        return run

    ranked = cut(screen_detectors(df, {name: detect(name, fit) for name, fit in fits.items()}), "screened-detectors")
    best = ranked.filter("error IS NULL").orderBy("rank").first()
    return ranked, done[best.model] if best else None


def final_fitted(df: DataFrame, features: list[str], fit: Callable[[DataFrame, list[str]], detectors.Fitted]) -> tuple[DataFrame, detectors.Fitted]:
    """All rows scored by a detector refitted on train and validation, and the detector; test rows have no part in the fit."""
    fitted = fit(df.filter(F.col(PARTITION).isin("train", "validation")), features)
    return detectors.score(fitted, df), fitted


def final_detection(df: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score summary by partition of a detector that is refitted on train and validation."""
    return evaluate.score_summary(detect(df), "_anomaly_score", "_is_anomaly")


def explain(model, features: list[str]) -> DataFrame:
    """(feature, value, kind, rank): coefficients by size, or importances, largest first; equals keep the features' order."""
    from pyspark.sql import SparkSession

    linear = hasattr(model, "coefficients")
    values = (model.coefficients if linear else model.featureImportances).toArray().tolist()
    order = sorted(range(len(features)), key=lambda i: (-abs(values[i]), i))
    rows = [(features[i], float(values[i]), "coefficient" if linear else "importance", k + 1) for k, i in enumerate(order)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, value double, kind string, rank int")


def merge_candidates(registry: DataFrame, profile: DataFrame, identity: list[str]) -> DataFrame:
    """Candidates (``identity`` columns, priority, place) of both, with source and rank: a profile's replaces the registry's of the same identity; by priority, then profiles before the registry, then place."""
    listed = ["priority", "place"]
    own = profile.select(*identity, *listed).withColumn("source", F.lit("industry_profile"))
    rest = registry.join(profile.select(*identity).distinct(), identity, "left_anti").select(*identity, *listed).withColumn("source", F.lit("registry"))
    return _ranked(own.unionByName(rest), [F.asc("priority"), F.asc("source"), F.asc("place")])
