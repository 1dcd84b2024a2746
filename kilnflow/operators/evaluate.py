"""Metrics of regression and classification, residual calibration and detection, and score summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kilnflow.functions.ordering import exact_quantiles
from kilnflow.operators.prepare import PARTITION

MAD_TO_SIGMA, MIN_SCALE, MAD_THRESHOLD, QUANTILE = 1.4826, 1e-12, 3.5, 0.99


def regression_metrics(df: DataFrame, actual: str = "y", predicted: str = "p") -> DataFrame:
    """One row: n, MAE, RMSE and R2; R2 is null for fewer than two rows or a constant target."""
    e = F.col(actual) - F.col(predicted)
    sums = df.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_sse"), (F.var_pop(actual) * F.count("*")).alias("_sst"))
    return sums.select("n", "mae", "rmse", F.when((F.col("n") >= 2) & (F.col("_sst") > 0), 1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"))


def classification_metrics(df: DataFrame, actual: str = "y", predicted: str = "p") -> DataFrame:
    """One row: accuracy, balanced accuracy over actual classes, and precision, recall and F1 as plain means over all labels; 0 for empty classes."""
    cells = df.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("given"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("given"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = sides.groupBy("label").agg(*[F.sum(c).cast("double").alias(c) for c in ("actual", "given", "hit")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumn("p", zero(F.col("hit"), F.col("given"))).withColumn("r", zero(F.col("hit"), F.col("actual")))
    per = per.withColumn("f", zero(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return per.agg(zero(F.sum("hit"), F.sum("actual")).alias("accuracy"), F.avg(F.when(F.col("actual") > 0, F.col("r"))).alias("balanced_accuracy"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"))


def mean_baseline(df: DataFrame, target: str) -> DataFrame:
    """Metrics of predicting the mean of train and validation on the test rows."""
    mean = df.filter(F.col(PARTITION) != "test").agg(F.avg(target).alias("p"))
    return regression_metrics(df.filter(F.col(PARTITION) == "test").crossJoin(F.broadcast(mean)).select(F.col(target).alias("y"), "p"))  # one row


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept) of least squares; a constant x has slope 0."""
    fitted = df.agg(F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"), F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    slope = F.when(F.col("_v") > 0, F.try_divide(F.col("_c"), F.col("_v"))).otherwise(0.0)
    return fitted.select(slope.alias("slope"), (F.col("_y") - slope * F.col("_x")).alias("intercept"))


def residuals_of_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """``df`` with prediction and residual of a line fitted on its train rows."""
    line = fit_line(df.filter(F.col(PARTITION) == "train"), x, y)
    joined = df.crossJoin(F.broadcast(line))  # one row
    return joined.withColumn("_regression_prediction", F.col("intercept") + F.col("slope") * F.col(x)).withColumn("_regression_residual", F.col(y) - F.col("_regression_prediction")).drop("slope", "intercept")


@dataclass(frozen=True)
class Calibration:
    """How residuals become scores: MAD or QUANTILE, the threshold, and whether it counts itself."""

    method: str = "MAD"
    threshold: float = MAD_THRESHOLD
    quantile: float = QUANTILE
    center: bool = True
    inclusive: bool = False


def calibrate(residuals: DataFrame, residual: str = "_regression_residual", by: Calibration = Calibration()) -> DataFrame:
    """One row (center, scale, threshold). MAD: scaled median of absolute deviations; QUANTILE: scale 1 and an exact quantile of absolute deviations."""
    rows = residuals.select(F.lit(0).alias("g"), F.col(residual).cast("double").alias("r"))
    center = exact_quantiles(rows, "g", "r", {"center": 0.5}) if by.center else rows.select("g").distinct().withColumn("center", F.lit(0.0))
    deviations = rows.join(F.broadcast(center), "g").select("g", "center", F.abs(F.col("r") - F.col("center")).alias("d"))  # one row
    q = exact_quantiles(deviations, "g", "d", {"q": 0.5 if by.method == "MAD" else by.quantile})
    both = center.join(q, "g")
    if by.method == "MAD":
        return both.select("center", F.greatest(F.lit(MAD_TO_SIGMA) * F.col("q"), F.lit(MIN_SCALE)).alias("scale"), F.lit(float(by.threshold)).alias("threshold"))
    return both.select("center", F.lit(1.0).alias("scale"), F.col("q").alias("threshold"))


def detect(df: DataFrame, calibration: DataFrame, residual: str = "_regression_residual", inclusive: bool = False) -> DataFrame:
    """``df`` with the absolute centered residual, the score, the flag and the raw prediction (-1 flagged, 1 not)."""
    joined = df.crossJoin(F.broadcast(calibration))  # one row
    score = F.abs(F.col(residual) - F.col("center")) / F.col("scale")
    flag = F.col("_residual_anomaly_score") >= F.col("threshold") if inclusive else F.col("_residual_anomaly_score") > F.col("threshold")
    return (
        joined.withColumn("_absolute_centered_residual", F.abs(F.col(residual) - F.col("center")))
        .withColumn("_residual_anomaly_score", score)
        .withColumn("_is_residual_anomaly", flag)
        .withColumn("_residual_anomaly_raw_prediction", F.when(flag, -1).otherwise(1).cast("long"))
        .drop("center", "scale", "threshold")
    )


def score_summary(df: DataFrame, score: str = "_residual_anomaly_score", flag: str = "_is_residual_anomaly") -> DataFrame:
    """A row per partition: counts, anomaly fraction, and min, max, mean (kept within them) and population deviation of the score."""
    sums = df.groupBy(PARTITION).agg(F.count("*").alias("n_rows"), F.count_if(flag).alias("n_anomalies"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("m"), F.stddev_pop(score).alias("std_score"))
    return sums.select(PARTITION, "n_rows", "n_anomalies", (F.col("n_anomalies") / F.col("n_rows")).alias("anomaly_fraction"), "min_score", "max_score", F.least(F.greatest("m", "min_score"), "max_score").alias("mean_score"), "std_score")


def label_free_metrics(df: DataFrame, score: str, flag: str) -> DataFrame:
    """One row over train and validation: fractions, their gap, validation scores' spread, and separation of flagged from other scores."""
    part = lambda p: F.col(PARTITION) == p
    fraction = lambda p: F.try_divide(F.count_if(part(p) & F.col(flag)).cast("double"), F.count_if(part(p)).cast("double"))
    v = F.when(part("validation"), F.col(score))
    sums = df.agg(fraction("train").alias("train_fraction"), fraction("validation").alias("validation_fraction"), F.min(v).alias("min_score"), F.max(v).alias("max_score"), F.avg(v).alias("mean_score"), F.stddev_pop(v).alias("std_score"), F.avg(F.when(F.col(flag), v)).alias("_a"), F.avg(F.when(~F.col(flag), v)).alias("_b"))
    return sums.select("train_fraction", "validation_fraction", F.abs(F.col("train_fraction") - F.col("validation_fraction")).alias("fraction_gap"), "min_score", "max_score", "mean_score", "std_score", (F.col("max_score") - F.col("min_score")).alias("score_range"), ((F.col("_a") - F.col("_b")) / F.greatest("std_score", F.lit(MIN_SCALE))).alias("separation"))


def quality_flags(metrics: DataFrame, least: float = 0.001, most: float = 0.25, gap: float = 0.10, spread: float = 1e-12) -> DataFrame:
    """``metrics`` of label_free_metrics() with the array of policy limits that it breaks. DEGENERATE: no flagged, or nothing but flagged, validation rows, so that there is no separation."""
    f = F.col("validation_fraction")
    flags = F.array_compact(F.array(F.when(f < least, F.lit("FRACTION_TOO_LOW")), F.when(f > most, F.lit("FRACTION_TOO_HIGH")), F.when(F.col("fraction_gap") > gap, F.lit("FRACTION_GAP")), F.when(F.col("std_score") < spread, F.lit("NEARLY_CONSTANT")), F.when(F.col("separation").isNull(), F.lit("DEGENERATE")), F.when(F.col("separation") < 0, F.lit("NEGATIVE_SEPARATION"))))
    return metrics.withColumn("flags", flags)


def shift(df: DataFrame, score: str = "_residual_anomaly_score", flag: str = "_is_residual_anomaly", base: str = "validation", new: str = "test") -> DataFrame:
    """One row: shift of the anomaly fraction, of the mean in base deviations, and the ratio of deviations, with alarms outside 0.5 to 2 and above 1."""
    of = lambda p, c: F.when(F.col(PARTITION) == p, c)
    s, f = F.col(score), F.col(flag).cast("double")
    sums = df.agg(F.avg(of(base, f)).alias("f0"), F.avg(of(new, f)).alias("f1"), F.avg(of(base, s)).alias("m0"), F.avg(of(new, s)).alias("m1"), F.stddev_pop(of(base, s)).alias("s0"), F.stddev_pop(of(new, s)).alias("s1"))
    out = sums.select((F.col("f1") - F.col("f0")).alias("fraction_shift"), ((F.col("m1") - F.col("m0")) / F.greatest("s0", F.lit(MIN_SCALE))).alias("mean_shift"), (F.col("s1") / F.greatest("s0", F.lit(MIN_SCALE))).alias("std_ratio"))
    return out.withColumn("mean_alarm", F.abs("mean_shift") > 1.0).withColumn("std_alarm", ~F.col("std_ratio").between(0.5, 2.0))


def plausibility(df: DataFrame, prediction: str, observed: DataFrame, declared: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """``df`` with the status of each prediction: outside the declared domain, else outside the observed range, else plausible. ``observed``: one row (minimum, maximum)."""
    p, out = F.col(prediction), F.lit(False)
    for bound, below in zip(declared, (True, False)):
        if bound is not None:
            out = out | (p < bound if below else p > bound)
    status: Column = F.when(p.isNull() | F.isnan(p), "UNAVAILABLE").when(out, "OUTSIDE_DECLARED_DOMAIN").when((p < F.col("minimum")) | (p > F.col("maximum")), "OUTSIDE_OBSERVED_RANGE").otherwise("PLAUSIBLE")
    return df.crossJoin(F.broadcast(observed)).withColumn("plausibility", status).drop("minimum", "maximum")  # one row


def acceptance(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """``metrics``: (metric, value); ``rules``: (metric, direction MIN or MAX, threshold). Adds each rule's status; a missing value is UNAVAILABLE."""
    ok = F.when(F.col("direction") == "MIN", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return rules.join(metrics, "metric", "left").withColumn("status", F.when(F.col("value").isNull(), "UNAVAILABLE").when(ok, "ACCEPTABLE").otherwise("UNACCEPTABLE"))
