"""Streams scored by a calibration that batch data fitted, and windowed shift against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def score_stream(stream: DataFrame, slope: float, intercept: float, center: float, scale: float, threshold: float, x: str, y: str) -> DataFrame:
    """Residual, score and flag of each row; a stateless projection, the same for batch and stream."""
    residual = F.col(y) - (F.lit(intercept) + F.lit(slope) * F.col(x))
    scored = stream.withColumn("_regression_residual", residual).withColumn("_residual_anomaly_score", F.abs(F.col("_regression_residual") - F.lit(center)) / F.lit(scale))
    return scored.withColumn("_is_residual_anomaly", F.col("_residual_anomaly_score") > F.lit(threshold))


def windowed_shift(scored: DataFrame, time: str, base_fraction: float, base_mean: float, base_std: float, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Per tumbling window: rows, anomaly fraction and its shift, and the mean score's shift in base deviations. Later rows than the watermark allows are left out."""
    late = scored.withWatermark(time, lateness)
    sums = late.groupBy(F.window(time, window)).agg(F.count("*").alias("n_rows"), F.avg(F.col("_is_residual_anomaly").cast("double")).alias("anomaly_fraction"), F.avg("_residual_anomaly_score").alias("mean_score"))
    return sums.select(F.col("window.start").alias("window_start"), "n_rows", "anomaly_fraction", (F.col("anomaly_fraction") - base_fraction).alias("fraction_shift"), ((F.col("mean_score") - base_mean) / max(base_std, 1e-12)).alias("mean_shift"))
