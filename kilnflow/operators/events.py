"""Anomaly events: selection, context windows, overlap of runs, islands, enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from kilnflow.functions.ordering import with_positions
from kilnflow.sources.tables import ROW_ID


def flag_top_if_none(df: DataFrame, flag: str, score: str, row_id: str = ROW_ID) -> DataFrame:
    """``df``; where no row is flagged, the one with the highest score (then least id) is."""
    top = df.select(F.col(score).alias("_s"), F.col(row_id).alias("_id")).orderBy(F.desc("_s"), F.asc("_id")).limit(1)
    state = df.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("_any")).crossJoin(top.select("_id"))
    return df.crossJoin(F.broadcast(state)).withColumn(flag, F.when(F.col("_any"), F.col(flag)).otherwise(F.col(row_id) == F.col("_id"))).drop("_any", "_id")  # one row


def select_events(df: DataFrame, flag: str, score: str, row_id: str = ROW_ID, most: int = 5, least: int = 1) -> DataFrame:
    """Up to ``most`` rows: flagged ones by score, then id; below ``least`` flagged ones the highest other scores fill up to ``most``."""
    one = df.groupBy(row_id).agg(F.max(F.struct(F.col(flag).alias("flagged"), F.col(score).alias("score"))).alias("x")).select(row_id, "x.*")
    hits = one.filter("flagged").agg(F.count("*").alias("_hits"))
    ranked = one.orderBy(F.desc("flagged"), F.desc("score"), F.asc(row_id)).limit(most)
    kept = ranked.crossJoin(F.broadcast(hits)).filter(F.col("flagged") | (F.col("_hits") < least)).drop("_hits")  # one row
    severity = F.when(F.col("score") >= 0, "high").otherwise("moderate")
    return kept.withColumn("severity", severity).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("flagged"), F.desc("score"), F.asc(row_id))))


def select_mixed_events(residual: DataFrame, unsupervised: DataFrame, row_id: str = ROW_ID, most: int = 5, least: int = 1) -> DataFrame:
    """Events of two detectors, each (row_id, flagged, score): an id that both flag is the residual one's; unflagged ones only fill up."""
    return select_events_of([residual, unsupervised], row_id, most, least)


def select_events_of(sources: list[DataFrame], row_id: str = ROW_ID, most: int = 5, least: int = 1) -> DataFrame:
    """Events of any number of detectors, each (row_id, flagged, score), in order of priority; ``source`` is the detector's place.

    An id is that of the first detector that flags it or, if none does, of the
    first that has it. Unflagged ids only fill up. Of repeated rows of a
    detector the flagged one of the highest score counts.
    """
    every = reduce(DataFrame.unionByName, [s.select(row_id, "flagged", "score", F.lit(i).alias("source")) for i, s in enumerate(sources)])
    one = every.groupBy(row_id).agg(F.min(F.struct((~F.col("flagged")).alias("not_flagged"), "source", (-F.col("score")).alias("neg"))).alias("x"))
    rows = one.select(row_id, (~F.col("x.not_flagged")).alias("flagged"), (-F.col("x.neg")).alias("score"), F.col("x.source").alias("source"))
    return select_events(rows, "flagged", "score", row_id, most, least).join(rows.select(row_id, "source"), row_id)


def latest_row(df: DataFrame, order_key: str, row_id: str = ROW_ID) -> DataFrame:
    """The operating point: the row latest by key, then of the least id."""
    return df.orderBy(F.desc_nulls_last(order_key), F.asc(row_id)).limit(1)


def choose_operating_point(df: DataFrame, time: str | None, row_id: str = ROW_ID, explicit: DataFrame | None = None, residual: str | None = None, unsupervised: str | None = None) -> DataFrame:
    """The row to start from: of the explicit id (one row with ``row_id``), else of the top residual score, else of the top unsupervised score, else the latest by ``time``, else of the largest id. Ties go to the least id."""
    if explicit is not None:
        return df.join(F.broadcast(explicit.select(row_id).distinct()), row_id, "left_semi")  # one row
    key = residual or unsupervised or time
    return df.orderBy(F.desc_nulls_last(key), F.asc(row_id)).limit(1) if key else df.orderBy(F.desc(row_id)).limit(1)


def context_windows(df: DataFrame, event_ids: DataFrame, order_by: list, radius: int = 3, row_id: str = ROW_ID) -> DataFrame:
    """(event_id, offset, row columns): the rows within ``radius`` places of each event.

    Each event is exploded into its places, so the join is by equality however many events there are.
    """
    placed = with_positions(df, order_by, "_place")
    events = placed.join(event_ids.select(F.col(row_id).alias("_event")), F.col(row_id) == F.col("_event")).select(F.col("_event").alias("event_id"), F.col("_place").alias("_at"))
    wanted = events.select("event_id", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("offset"), "_at").select("event_id", "offset", (F.col("_at") + F.col("offset")).alias("_wanted"))
    return placed.join(wanted, F.col("_place") == F.col("_wanted")).select("event_id", "offset", *[F.col(f"`{c}`") for c in df.columns])


def event_overlap(baseline: DataFrame, current: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """(row_id, status): shared, baseline_only or current_only."""
    a, b = baseline.select(row_id).distinct().withColumn("_a", F.lit(True)), current.select(row_id).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a") & F.col("_b"), "shared").when(F.col("_a"), "baseline_only").otherwise("current_only")
    return a.join(b, row_id, "full_outer").select(row_id, status.alias("status"))


def factor_overlap(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Two ranked factor lists (feature, rank, direction) side by side: shared ones first, then current only, then baseline only."""
    a = baseline.select("feature", F.col("rank").alias("baseline_rank"), F.col("direction").alias("baseline_direction"))
    b = current.select("feature", F.col("rank").alias("current_rank"), F.col("direction").alias("current_direction"))
    both = a.join(b, "feature", "full_outer")
    group = F.when(F.col("baseline_rank").isNotNull() & F.col("current_rank").isNotNull(), 0).when(F.col("current_rank").isNotNull(), 1).otherwise(2)
    status = F.element_at(F.array(F.lit("shared"), F.lit("current_only"), F.lit("baseline_only")), group + 1)
    order = Window.partitionBy(F.lit(0)).orderBy(group, F.asc_nulls_last("current_rank"), F.asc_nulls_last("baseline_rank"), "feature")
    return both.withColumn("status", status).withColumn("position", F.row_number().over(order))


def islands(df: DataFrame, flag: str, order_by: list) -> DataFrame:
    """One row: flagged rows, and runs of them that follow each other in the order."""
    placed = with_positions(df.select("*"), order_by, "_place").filter(flag).select("_place")
    previous = placed.select((F.col("_place") + 1).alias("_place"), F.lit(True).alias("_follows"))
    marked = placed.join(previous, "_place", "left")
    return marked.agg(F.count("*").alias("n_flagged"), F.count_if(F.col("_follows").isNull()).alias("n_islands"))


def enrichment(df: DataFrame, detected: str, truth: str) -> DataFrame:
    """One row: detected rows, their precision, the base rate, and precision over base rate."""
    sums = df.agg(F.count_if(detected).alias("n_detected"), F.count_if(F.col(detected) & F.col(truth)).alias("n_hits"), F.avg(F.col(truth).cast("double")).alias("base_rate"))
    precision = F.try_divide(F.col("n_hits").cast("double"), F.col("n_detected").cast("double"))
    return sums.select("n_detected", "n_hits", "base_rate", precision.alias("precision"), F.when(F.col("base_rate") > 0, precision / F.col("base_rate")).alias("enrichment"))


def judge_events(events: DataFrame, truth: DataFrame) -> DataFrame:
    """``events`` (place, sample_id as text) with row_id, kind and verdict against ``truth`` (row_id, is_anomaly, kind; one row each).

    INVALID_ID for what is no whole number, OUTSIDE for an id that ``truth``
    lacks, DUPLICATE for all but the first place of an id, else MATCHED or
    UNMATCHED. An anomaly's kind is kept.
    """
    rows = events.withColumn("row_id", F.trim("sample_id").try_cast("long"))
    first = rows.filter("row_id IS NOT NULL").groupBy("row_id").agg(F.min("place").alias("_first"))
    joined = rows.join(first, "row_id", "left").join(truth.select("row_id", "is_anomaly", "kind"), "row_id", "left")
    verdict = F.when(F.col("row_id").isNull(), "INVALID_ID").when(F.col("is_anomaly").isNull(), "OUTSIDE").when(F.col("place") > F.col("_first"), "DUPLICATE").when(F.col("is_anomaly"), "MATCHED").otherwise("UNMATCHED")
    return joined.select("place", "sample_id", "row_id", F.when(F.col("is_anomaly"), F.col("kind")).alias("kind"), verdict.alias("verdict"))


def context_features(factors: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """(feature, rank): the ``most`` first factors (feature, rank) that are among ``columns`` and not the row id, each at its first rank."""
    known = factors.filter(F.col("feature").isin(*columns) & (F.col("feature") != ROW_ID)) if columns else factors.limit(0)
    return known.groupBy("feature").agg(F.min("rank").alias("rank")).orderBy("rank", "feature").limit(most)
