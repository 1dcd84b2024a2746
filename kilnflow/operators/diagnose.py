"""Which features set anomalous rows apart: group comparison, residual association, and their fusion.

Features are unpivoted to (feature, value) rows, so all features share each
shuffle; medians and ranks come from counts of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnflow.functions.ordering import average_ranks, exact_quantiles
from kilnflow.functions.statistics import correlation
from kilnflow.operators.evaluate import MAD_TO_SIGMA, MIN_SCALE
from kilnflow.sources.shared import cut

Z_THRESHOLD, TOLERANCE, RRF = 3.5, 1e-12, 60.0
POSITIVE, NEGATIVE, MIXED, UNKNOWN = "positive", "negative", "mixed", "unknown"


def decode_flag(flag: Column) -> Column:
    """A Boolean or 0/1 indicator as Boolean; anything else, null included, raises."""
    n = flag.cast("int")
    return F.when(F.assert_true(F.coalesce(n.isin(0, 1), F.lit(False)), F.lit("an anomaly indicator must be 0 or 1")).isNull(), n == 1)


def long_features(df: DataFrame, features: list[str], keep: dict[str, Column]) -> DataFrame:
    """A row per row and feature: feature, place (its order), value, and the ``keep`` columns. NaN and infinite values raise."""

    def finite(f: str) -> Column:
        v = F.col(f).cast("double")
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{f} has a value that is not finite")).cast("double")).otherwise(v)

    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("place"), finite(f).alias("value")) for i, f in enumerate(features)])
    return df.select(*[c.alias(k) for k, c in keep.items()], F.explode(cells).alias("x")).select(*keep, "x.*")


def _group_medians(rows: DataFrame) -> DataFrame:
    """(feature, ref_median, anomaly_median, mad) of long rows with ``flag``: medians, and the deviation median of reference rows."""
    keyed = rows.withColumn("k", F.struct("feature", "flag"))
    medians = exact_quantiles(keyed, "k", "value", {"m": 0.5}).select("k.feature", "k.flag", "m")
    both = medians.groupBy("feature").agg(F.max(F.when(~F.col("flag"), F.col("m"))).alias("ref_median"), F.max(F.when(F.col("flag"), F.col("m"))).alias("anomaly_median"))
    both = both.filter("ref_median IS NOT NULL AND anomaly_median IS NOT NULL")
    deviations = rows.filter(~F.col("flag")).join(F.broadcast(both.select("feature", "ref_median")), "feature").select("feature", F.abs(F.col("value") - F.col("ref_median")).alias("d"))  # a row per feature
    return both.join(exact_quantiles(deviations, "feature", "d", {"mad": 0.5}), "feature")


def group_comparison(df: DataFrame, features: list[str], flag: str, minimum_reference_rows: int = 5, minimum_anomaly_rows: int = 1, repeatability: bool = True, threshold: float = Z_THRESHOLD, single_event: bool = False) -> DataFrame:
    """A row per feature: medians, MAD, robust z, prevalence, direction and confidence of flagged against other rows.

    Where the MAD vanishes the z is null, prevalence is the share of flagged
    rows away from the median, and it stands in for the effect.
    """
    rows = cut(long_features(df, features, {"flag": decode_flag(F.col(flag))}).filter("value IS NOT NULL"), "long-features")
    fitted = F.broadcast(_group_medians(rows).withColumn("scale", MAD_TO_SIGMA * F.col("mad")))  # a row per feature
    gap = F.abs(F.col("value") - F.col("ref_median"))
    flat = F.col("scale") <= MIN_SCALE
    away = F.when(flat, gap > TOLERANCE).otherwise(F.try_divide(gap, F.col("scale")) >= threshold)
    stats = rows.join(fitted, "feature").groupBy("feature", "place", "ref_median", "anomaly_median", "mad", "scale").agg(
        F.count_if(~F.col("flag")).alias("n_reference"), F.count_if("flag").alias("n_anomalous"), F.avg(F.when(F.col("flag"), away.cast("double"))).alias("prevalence"),
        F.bool_or(F.col("flag") & (F.col("value") > F.col("ref_median") + TOLERANCE)).alias("high"), F.bool_or(F.col("flag") & (F.col("value") < F.col("ref_median") - TOLERANCE)).alias("low"),
    )
    diff = F.col("anomaly_median") - F.col("ref_median")
    stats = stats.withColumn("difference", diff).withColumn("robust_z", F.when(~flat, F.abs(diff) / F.col("scale")))
    effect = F.when(~flat, F.col("robust_z") / (F.col("robust_z") + 1)).when(F.abs("difference") > TOLERANCE, F.col("prevalence")).otherwise(0.0)
    support = F.least(F.lit(1.0), F.col("n_reference") / minimum_reference_rows) * (F.lit(1.0) if single_event else F.least(F.lit(1.0), F.col("n_anomalous") / minimum_anomaly_rows))
    repeat = 0.5 + 0.5 * F.col("prevalence") if repeatability else F.lit(1.0)
    direction = F.when(F.col("high") & F.col("low") & (F.abs("difference") <= TOLERANCE), MIXED).when(F.col("difference") > TOLERANCE, POSITIVE).when(F.col("difference") < -TOLERANCE, NEGATIVE).otherwise(UNKNOWN)
    return stats.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), effect * support * repeat))).withColumn("direction", direction).drop("high", "low")


def rank_correlations(rows: DataFrame, others: list[str]) -> DataFrame:
    """(feature, rho_<other>...) of long rows: correlation of average ranks of ``value`` and of each other column; 0 where one is constant.

    All columns are ranked by one running total over (feature, column, value).
    """
    names = ["value", *others]
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in enumerate(names)])
    stacked = rows.select("feature", F.explode(cells).alias("x")).select(F.struct("feature", "x.k").alias("g"), "x.v")
    ranks = cut(average_ranks(stacked, "g", "v", "rank_").select("g.feature", "g.k", "v", "rank_"), "ranks")
    ranked = rows.groupBy("feature", *names).agg(F.count("*").alias("n"))
    for k, c in enumerate(names):
        own = ranks.filter(F.col("k") == k).select(F.col("feature").alias("f_"), F.col("v").alias("v_"), F.col("rank_").alias(f"r{k}"))
        ranked = ranked.join(own, (F.col("feature") == F.col("f_")) & (F.col(c) == F.col("v_"))).drop("f_", "v_")
    n = F.sum("n").cast("double")
    mean = lambda c: F.sum(c * F.col("n")) / n
    r = lambda k: F.col(f"r{k}")
    keys = range(len(names))
    sums = ranked.groupBy("feature").agg(*[mean(r(k)).alias(f"m{k}") for k in keys], *[mean(r(k) * r(k)).alias(f"s{k}") for k in keys], *[mean(r(0) * r(k)).alias(f"c{k}") for k in keys if k])
    sd = lambda k: F.sqrt(F.greatest(F.col(f"s{k}") - F.col(f"m{k}") ** 2, F.lit(0.0)))
    rho = lambda k: F.when((sd(0) <= MIN_SCALE) | (sd(k) <= MIN_SCALE), 0.0).otherwise(F.try_divide(F.col(f"c{k}") - F.col("m0") * F.col(f"m{k}"), sd(0) * sd(k)))
    return sums.select("feature", *[F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho(k))).alias(f"rho_{c}") for k, c in enumerate(names) if k])


def spearman(rows: DataFrame, other: str) -> DataFrame:
    """(feature, rho): rank_correlations() with one other column."""
    return rank_correlations(rows, [other]).withColumnRenamed(f"rho_{other}", "rho")


def residual_association(df: DataFrame, features: list[str], flag: str = "_is_residual_anomaly", residual: str = "_regression_residual", score: str = "_residual_anomaly_score", weights: tuple[float, float, float] = (0.45, 0.35, 0.20), minimum: tuple[int, int, int] = (5, 2, 1), threshold: float = Z_THRESHOLD, single_event: bool = False) -> DataFrame:
    """A row per feature: rank correlations with residual and score, group deviation, prevalence, raw score, direction and confidence.

    ``minimum``: rows in all, reference rows and flagged rows of full support.
    Residuals and scores that agree to nine places are ties in their ranks, so
    that the last bits of a difference don't part them.
    """
    rows = cut(long_features(df, features, {"flag": decode_flag(F.col(flag)), "residual": F.round(residual, 9), "score": F.round(score, 9)}).filter("value IS NOT NULL"), "long-features")
    medians = _group_medians(rows.select("feature", "flag", "value")).withColumn("scale", F.greatest(MAD_TO_SIGMA * F.col("mad"), F.lit(MIN_SCALE)))
    fitted = F.broadcast(medians)  # a row per feature
    gap = F.abs(F.col("value") - F.col("ref_median")) / F.col("scale")
    stats = rows.join(fitted, "feature").groupBy("feature", "place", "ref_median", "anomaly_median", "mad", "scale").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("flag")).alias("n_reference"), F.count_if("flag").alias("n_anomalous"), F.avg(F.when(F.col("flag"), (gap >= threshold).cast("double"))).alias("prevalence"),
        F.bool_or(F.col("flag") & (F.col("value") > F.col("ref_median") + TOLERANCE)).alias("high"), F.bool_or(F.col("flag") & (F.col("value") < F.col("ref_median") - TOLERANCE)).alias("low"),
    )
    stats = stats.join(rank_correlations(rows, ["residual", "score"]), "feature")
    z = F.abs(F.col("anomaly_median") - F.col("ref_median")) / F.col("scale")
    stats = stats.withColumn("group_z", z)
    raw = weights[0] * F.abs("rho_score") + weights[1] * F.col("group_z") / (F.col("group_z") + 1) + weights[2] * F.col("prevalence")
    stats = stats.withColumn("raw_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    direction = F.when(F.col("high") & F.col("low") & (F.abs("rho_residual") <= TOLERANCE), MIXED).when(F.col("rho_residual") > TOLERANCE, POSITIVE).when(F.col("rho_residual") < -TOLERANCE, NEGATIVE).otherwise(UNKNOWN)
    part = lambda n, least: F.least(F.lit(1.0), F.col(n) / least)
    confidence = F.col("raw_score") * part("n_rows", minimum[0]) * part("n_reference", minimum[1]) * (F.lit(1.0) if single_event else part("n_anomalous", minimum[2]))
    return stats.withColumn("direction", direction).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).drop("high", "low")


def rank_factors(stats: DataFrame, method: str = "group", top: int = 10) -> DataFrame:
    """The first ``top`` factors with rank and score relative to the largest; features without a score are left out. One row per feature comes in."""
    raw = "confidence" if method == "group" else "raw_score"
    keys = [F.desc("confidence"), F.desc("prevalence"), F.asc("place")] if method == "group" else [F.desc("raw_score"), F.desc(F.abs("rho_score")), F.desc("prevalence"), F.desc("confidence"), F.asc("place")]
    scored = stats.filter(F.col(raw) != 0.0)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)))
    return ranked.withColumn("normalized_score", F.try_divide(F.col(raw), F.max(raw).over(Window.partitionBy(F.lit(0))))).filter(F.col("rank") <= top)


def _votes(rule: str) -> Column:
    """Direction of several; ``robust`` lets known signs win over mixed ones, ``residual`` and ``ensemble`` make any mixed one win."""
    has = lambda d: F.bool_or(F.col("direction") == d)
    both = has(POSITIVE) & has(NEGATIVE)
    signed = F.when(both, MIXED).when(has(POSITIVE), POSITIVE).when(has(NEGATIVE), NEGATIVE)
    if rule == "robust":
        return F.coalesce(signed, F.when(has(MIXED), MIXED).otherwise(UNKNOWN))
    return F.when(has(MIXED), MIXED).otherwise(F.coalesce(signed, F.lit(UNKNOWN)))


def aggregate_events(factors: DataFrame, rule: str = "robust", top: int = 10) -> DataFrame:
    """Factors of several events (event_id, feature, place, normalized_score, confidence, difference, direction) as one ranked list of means.

    By the ``residual`` rule, with rho_score, the mean of its sizes breaks ties of the mean score first.
    """
    related = [F.avg(F.abs("rho_score")).alias("mean_correlation")] if rule == "residual" else []
    sums = factors.groupBy("feature").agg(F.avg("normalized_score").alias("mean_score"), F.avg("confidence").alias("mean_confidence"), F.avg("difference").alias("mean_deviation"), F.count("*").alias("occurrences"), F.min("place").alias("place"), _votes(rule).alias("direction"), *related)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_score"), *([F.desc("mean_correlation")] if related else []), F.desc("mean_confidence"), F.desc("occurrences"), F.asc("place"))
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def aggregate_rrf(factors: DataFrame, constant: float = RRF) -> DataFrame:
    """Factors of several events by the sum of 1 / (constant + rank)."""
    return factors.groupBy("feature").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("rrf_score"), F.count("*").alias("occurrences"), F.avg("confidence").alias("mean_confidence"), _votes("ensemble").alias("direction"))


def fuse(sources: DataFrame, weights: dict[str, float], constant: float = RRF, minimum_support: int = 1, penalize_partial: bool = True, top: int = 10) -> DataFrame:
    """Weighted reciprocal rank fusion of factor lists (source, feature, place, rank, confidence, deviation, direction).

    Weights are shared out anew among the sources that are there. Confidence is
    the weighted mean times the covered weight; deviation is weighted by
    confidence, the plain mean where all confidences are 0; opposed or mixed
    directions are a conflict.
    """
    spark = sources.sparkSession
    table = F.broadcast(spark.createDataFrame(list(weights.items()), "source string, _w double"))  # a row per method
    present = sources.select("source").distinct().join(table, "source").agg(F.sum("_w").alias("_all"), F.count("*").alias("_methods"))
    weighted = sources.join(table, "source").crossJoin(F.broadcast(present)).withColumn("w", F.col("_w") / F.col("_all"))  # one row
    deviation, c = F.coalesce("deviation", F.lit(0.0)), F.col("confidence")
    has = lambda d: F.bool_or(F.col("direction") == d)
    fused = weighted.groupBy("feature").agg(
        F.sum(F.col("w") / (constant + F.col("rank"))).alias("rrf_score"), F.count("*").alias("n_sources"), (F.sum(F.col("w") * c) / F.sum("w")).alias("_base"), F.sum("w").alias("_coverage"),
        F.coalesce(F.try_divide(F.sum(c * deviation), F.sum(c)), F.avg(deviation)).alias("deviation"), _votes("ensemble").alias("direction"), (has(MIXED) | (has(POSITIVE) & has(NEGATIVE))).alias("conflict"), F.min("place").alias("place"), F.max("_methods").alias("_methods"),
    ).filter(F.col("n_sources") >= minimum_support)
    confidence = F.col("_base") * (F.col("_coverage") if penalize_partial else F.lit(1.0))
    fused = fused.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).withColumn("partial", F.col("n_sources") < F.col("_methods"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rrf_score"), F.desc("n_sources"), F.desc("confidence"), F.asc("conflict"), F.asc("place"))
    ranked = fused.withColumn("rank", F.row_number().over(order)).withColumn("normalized_score", F.try_divide(F.col("rrf_score"), F.max("rrf_score").over(Window.partitionBy(F.lit(0)))))
    return ranked.filter(F.col("rank") <= top).drop("_base", "_coverage", "_methods")


def _reference_scale(rows: DataFrame) -> DataFrame:
    """(feature, ref_median, mad, n_reference) of long reference rows."""
    medians = exact_quantiles(rows, "feature", "value", {"ref_median": 0.5})
    deviations = rows.join(F.broadcast(medians), "feature").select("feature", F.abs(F.col("value") - F.col("ref_median")).alias("d"))  # a row per feature
    return medians.join(exact_quantiles(deviations, "feature", "d", {"mad": 0.5}), "feature").join(rows.groupBy("feature").agg(F.count("*").alias("n_reference")), "feature")


def _top_flagged(df: DataFrame, features: list[str], flag: str, score: str, row_id: str, events: int) -> DataFrame:
    """Long rows (event_id, feature, place, value) of the flagged rows of the highest scores, equal ones by id."""
    top = df.filter(decode_flag(F.col(flag))).orderBy(F.desc(score), F.asc(row_id)).limit(events)
    return long_features(top, features, {"event_id": F.col(row_id)}).filter("value IS NOT NULL")


def compare_events(df: DataFrame, features: list[str], flag: str, score: str, row_id: str, events: int = 20) -> DataFrame:
    """Group comparison of each of the top flagged rows alone against all reference rows: (event_id, feature, ...).

    The events are a bounded top-k list; reference medians and scales are
    computed once for all of them.
    """
    rows = long_features(df, features, {"flag": decode_flag(F.col(flag))}).filter("value IS NOT NULL")
    fitted = _reference_scale(rows.filter(~F.col("flag")))
    each = _top_flagged(df, features, flag, score, row_id, events).join(F.broadcast(fitted), "feature")
    s, d = MAD_TO_SIGMA * F.col("mad"), F.col("value") - F.col("ref_median")
    flat = s <= MIN_SCALE
    z = F.when(~flat, F.abs(d) / s)
    prevalence = F.when(flat, F.abs(d) > TOLERANCE).otherwise(z >= Z_THRESHOLD).cast("double")
    effect = F.when(~flat, z / (z + 1)).when(F.abs(d) > TOLERANCE, prevalence).otherwise(0.0)
    direction = F.when(d > TOLERANCE, POSITIVE).when(d < -TOLERANCE, NEGATIVE).otherwise(UNKNOWN)
    out = each.select("event_id", "feature", "place", d.alias("difference"), z.alias("robust_z"), prevalence.alias("prevalence"), direction.alias("direction"), (effect * F.least(F.lit(1.0), F.col("n_reference") / 5) * (0.5 + 0.5 * prevalence)).alias("confidence"))
    w = Window.partitionBy("event_id")
    return out.filter("confidence <> 0").withColumn("normalized_score", F.col("confidence") / F.max("confidence").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), F.desc("prevalence"), F.asc("place"))))


def associate_events(df: DataFrame, features: list[str], flag: str = "_is_residual_anomaly", residual: str = "_regression_residual", score: str = "_residual_anomaly_score", row_id: str = "_original_row_id", events: int = 20, weights: tuple[float, float, float] = (0.45, 0.35, 0.20), minimum: tuple[int, int] = (5, 2), threshold: float = Z_THRESHOLD, top: int = 10) -> DataFrame:
    """Residual association of each of the top flagged rows alone: (event_id, feature, ...), the first ``top`` factors of each event.

    Rank correlations are those over all rows and the same for all events, so
    all columns are ranked once; of an event its own values count, measured by
    the median and scale of the rows that aren't flagged. ``minimum``: rows in
    all and reference rows of full support. A null value leaves its feature out
    of that event; without flagged or without reference rows there are none.
    Equal residuals, scores and values share their ranks, to nine places.
    """
    rows = cut(long_features(df, features, {"flag": decode_flag(F.col(flag)), "residual": F.round(residual, 9), "score": F.round(score, 9)}).filter("value IS NOT NULL"), "long-features")
    fitted = _reference_scale(rows.filter(~F.col("flag")).select("feature", "value")).withColumn("scale", F.greatest(MAD_TO_SIGMA * F.col("mad"), F.lit(MIN_SCALE)))
    related = rank_correlations(rows, ["residual", "score"]).join(rows.groupBy("feature").agg(F.count("*").alias("n_rows")), "feature")
    each = _top_flagged(df, features, flag, score, row_id, events).join(F.broadcast(fitted.join(related, "feature")), "feature")  # a row per feature
    d = F.col("value") - F.col("ref_median")
    each = each.withColumn("difference", d).withColumn("group_z", F.abs(d) / F.col("scale")).withColumn("prevalence", (F.col("group_z") >= threshold).cast("double"))
    raw = weights[0] * F.abs("rho_score") + weights[1] * F.col("group_z") / (F.col("group_z") + 1) + weights[2] * F.col("prevalence")
    support = F.least(F.lit(1.0), F.col("n_rows") / minimum[0]) * F.least(F.lit(1.0), F.col("n_reference") / minimum[1])
    direction = F.when(F.col("rho_residual") > TOLERANCE, POSITIVE).when(F.col("rho_residual") < -TOLERANCE, NEGATIVE).otherwise(UNKNOWN)
    each = each.withColumn("raw_score", F.least(F.lit(1.0), raw)).filter("raw_score <> 0").withColumn("confidence", F.col("raw_score") * support).withColumn("direction", direction)
    w = Window.partitionBy("event_id")  # a row per feature
    order = w.orderBy(F.desc("raw_score"), F.desc(F.abs("rho_score")), F.desc("prevalence"), F.desc("confidence"), F.asc("place"))
    ranked = each.withColumn("normalized_score", F.col("raw_score") / F.max("raw_score").over(w)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("event_id", "feature", "place", "difference", "group_z", "prevalence", "rho_residual", "rho_score", "raw_score", "confidence", "direction", "normalized_score", "rank")


__all__ = ["aggregate_events", "aggregate_rrf", "associate_events", "compare_events", "correlation", "decode_flag", "fuse", "group_comparison", "long_features", "rank_correlations", "rank_factors", "residual_association", "spearman"]
