"""Operators on small tables with values worked out by hand, and on odd ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnflow.functions.ordering import average_ranks, exact_quantiles, with_positions, with_running_total
from kilnflow.functions.statistics import first_seen_mode
from kilnflow.operators import diagnose, evaluate, events, models, prepare, profile, recommend, routing
from kilnflow.operators.prepare import PARTITION, Range, RefusedError
from kilnflow.sources import tables
from kilnflow.sources.tables import ROW_ID


def test_positions_and_running_totals(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(2).cast("long").alias("n")).repartition(7)
    rows = with_positions(df, [F.desc("k")]).collect()
    assert all(r._position == 999 - r.k for r in rows)
    totals = with_running_total(df, [F.col("k")], "n", "before").collect()
    assert all(r.before == 2 * r.k for r in totals)


def test_quantiles_and_ranks_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    values = {g: np.round(rng.normal(size=n), 1) for g, n in (("a", 101), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    for r in exact_quantiles(df, "g", "v", {"m": 0.5, "q": 0.99}).collect():
        assert r.m == pytest.approx(np.median(values[r.g])) and r.q == pytest.approx(np.quantile(values[r.g], 0.99))
    for r in exact_quantiles(df, "g", "v", {"n": 0.25}, "nearest").collect():
        s = np.sort(values[r.g])
        assert r.n == pytest.approx(s[int(math.floor((len(s) - 1) * 0.25 + 0.5))])
    ranks = {(r.g, r.v): r.r for r in average_ranks(df, "g", "v", "r").collect()}
    for g, vs in values.items():
        for v in set(vs):
            assert ranks[g, float(v)] == pytest.approx(np.mean(np.flatnonzero(np.sort(vs) == v) + 1))


def test_first_seen_mode(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, None)], "i long, v string")
    assert first_seen_mode(df, "v", "i").first().v == "b"


def test_load_and_refusals(spark, tmp_path):
    (tmp_path / "t.csv").write_text("lot_id,temperature,pressure\nA,1.5,3\nB,,4\nC,2.5,5\n")
    df = tables.load(spark, str(tmp_path / "t.csv"))
    assert [(r.lot_id, r[ROW_ID]) for r in df.orderBy(ROW_ID).collect()] == [("A", 0), ("B", 1), ("C", 2)]
    df.write.parquet(str(tmp_path / "p.parquet"))
    with pytest.raises(tables.TableError):
        tables.load(spark, str(tmp_path / "p.parquet"))
    for bad in ("missing.csv", "t.txt"):
        with pytest.raises(tables.TableError):
            tables.scan(spark, str(tmp_path / bad))
    assert tables.from_csv_bytes(spark, b"a,b\n1,2\n3,4\n", 1)[0].count() == 2
    assert tables.table_fingerprint(df).first() == tables.table_fingerprint(df.repartition(3)).first()


def test_profile_and_issues(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, "1", None, nan), (2.0, " 2.5 ", None, inf), (None, "x", None, 1.0), (2.0, "4", None, 1.0), (2.0, "5", None, 2.0)], "a double, s string, n double, f double")
    got = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert got["a"].unique_count == 3 and got["a"].null_count == 1 and got["n"].is_constant and got["a"].mean_value == 1.75
    issues = {(r.column_name, r.issue_type) for r in profile.validate(df).collect()}
    assert issues == {("n", "ALL_NULL_COLUMN"), ("s", "NUMERIC_STRING_COLUMN"), ("f", "NAN_VALUES"), ("f", "INFINITE_VALUES")}
    assert profile.quality_score(profile.validate(df)).first().score == 100 - 30 - 1.5 - 8 - 30
    empty = profile.validate(df.limit(0)).collect()
    assert [r.issue_type for r in empty] == ["EMPTY_DATASET"]


@pytest.mark.parametrize(("values", "code"), [([None, None], "TARGET_ALL_NULL"), ([1.0, 1.0], "TARGET_CONSTANT"), ([1.0, 2.0], None)])
def test_target(spark, values, code):
    assert profile.target_suitability(spark.createDataFrame([(v,) for v in values], "y double"), "y").first().refusal_code == code


def test_monotonic_over_bucket_edges(spark):
    df = spark.range(9000).select(F.col("id").alias("k"), F.col("id").alias("up"), F.when(F.col("id") == 4096, -1).otherwise(F.col("id")).alias("dip"))
    assert {r.column_name: r.non_decreasing for r in profile.column_suggestions(df, "k").collect()} == {"up": True, "dip": False}


def test_sort_is_stable_and_checks_keys(spark):
    df = spark.createDataFrame([(0, "b", 2), (1, "a", 1), (2, "b", 1), (3, None, 1)], f"{ROW_ID} long, k string, v long")
    assert [r[ROW_ID] for r in prepare.stable_sort(df, ["k"]).collect()] == [1, 0, 2, 3]
    assert [r[ROW_ID] for r in prepare.stable_sort(df, ["k"], True, False).collect()] == [3, 0, 2, 1]
    assert prepare.null_keys(df, ["k", "v"]).collect()[0].column_name == "k"
    for bad in ([], ["k", "k"], ["none"]):
        with pytest.raises(RefusedError):
            prepare.stable_sort(df, bad)


def test_cohort(spark):
    df = spark.createDataFrame([(10, 1.0), (11, 2.0), (12, None), (13, 3.0)], f"{ROW_ID} long, x double")
    assert [r[ROW_ID] for r in prepare.cohort(df, Range("x", 1, 3, False, True)).orderBy(ROW_ID).collect()] == [11, 13]
    with pytest.raises(RefusedError):
        prepare.cohort(df.withColumn("s", F.lit("a")), Range("s"))
    assert [r[0] for r in prepare.removed_rows(df, df.filter("x > 1")).orderBy(ROW_ID).collect()] == [10, 12]


def test_split_parts_cover_and_do_not_overlap(spark):
    df = spark.range(103).select(F.col("id").alias(ROW_ID), (F.col("id") % 10).cast("string").alias("g"))
    for parts in (prepare.split_time(df, [F.desc(ROW_ID)]), prepare.split_random(df), prepare.split_group(df, "g")):
        assert parts.count() == 103 and parts.select(ROW_ID).distinct().count() == 103
        assert {r[0] for r in parts.select(PARTITION).distinct().collect()} == {"train", "validation", "test"}
        prepare.check_split(parts)
    assert prepare.split_time(df, [F.col(ROW_ID)]).filter(F.col(PARTITION) == "test").agg(F.min(ROW_ID)).first()[0] == 103 - 21
    assert prepare.shared_keys(prepare.split_group(df, "g"), "g").isEmpty()
    assert prepare.permuted_groups(spark, list("abcde")).count() == 5
    with pytest.raises(RefusedError):
        prepare.check_split(prepare.split_time(df.limit(1), [F.col(ROW_ID)]))


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0, "b"), (1, None, 5.0, None), (2, 3.0, 5.0, "a"), (3, 8.0, 5.0, "a"), (4, 4.0, 5.0, "b")], f"{ROW_ID} long, t double, p double, s string")
    values = prepare.impute_values(df, {"t": "median"}, {"s": "most_frequent"})
    assert values == {"t": 3.5, "s": "b"}
    assert [r.t for r in prepare.impute(df, values).orderBy(ROW_ID).collect()] == [1.0, 3.5, 3.0, 8.0, 4.0]
    fitted = {r.column_name: r for r in prepare.scaling(df, ["t", "p"]).collect()}
    assert fitted["p"].scale == 1.0 and fitted["t"].scale == pytest.approx(np.std([1, 3, 8, 4]))
    assert prepare.scale(df, prepare.scaling(df, ["p"])).agg(F.max("p")).first()[0] == 0.0


def test_metrics(spark):
    assert evaluate.regression_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")).first() == (2, 0.5, math.sqrt(0.5), 0.5)
    assert evaluate.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double")).first().r2 is None
    m = evaluate.classification_metrics(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "y string, p string")).first()
    assert m.accuracy == 0.5 and m.balanced_accuracy == 0.5 and m.macro_recall == pytest.approx(1 / 3)


def test_residual_calibration(spark):
    r = [0.0, 1.0, -1.0, 2.0, 10.0]
    df = spark.createDataFrame([(v,) for v in r], "_regression_residual double")
    c = evaluate.calibrate(df).first()
    assert (c.center, c.threshold) == (1.0, 3.5) and c.scale == pytest.approx(1.4826 * np.median(np.abs(np.array(r) - 1)))
    flagged = evaluate.detect(df, evaluate.calibrate(df)).filter("_is_residual_anomaly").collect()
    assert [x._regression_residual for x in flagged] == [10.0] and flagged[0]._residual_anomaly_raw_prediction == -1
    q = evaluate.calibrate(df, by=evaluate.Calibration("QUANTILE", center=False)).first()
    assert q.threshold == pytest.approx(np.quantile(np.abs(r), 0.99))
    assert evaluate.calibrate(df.filter("_regression_residual = 0")).first().scale == 1e-12


def test_group_comparison(spark):
    rows = [(i, float(i % 3), 5.0, 0) for i in range(9)] + [(9, 50.0, 5.0, 1), (10, 60.0, 5.5, 1)]
    df = spark.createDataFrame(rows, "id long, pressure double, stable double, flag int")
    got = {r.feature: r for r in diagnose.group_comparison(df, ["pressure", "stable"], "flag").collect()}
    z = (55 - 1) / 1.4826
    assert got["pressure"].robust_z == pytest.approx(z) and got["pressure"].direction == "positive" and got["pressure"].confidence == pytest.approx(z / (z + 1))
    assert got["stable"].robust_z is None and got["stable"].prevalence == 0.5 and got["stable"].confidence == pytest.approx(0.5 * 0.75)
    ranked = diagnose.rank_factors(diagnose.group_comparison(df, ["pressure", "stable"], "flag")).orderBy("rank").collect()
    assert [r.feature for r in ranked] == ["pressure", "stable"] and ranked[0].normalized_score == 1.0
    with pytest.raises(Exception, match="indicator"):
        diagnose.group_comparison(df.withColumn("flag", F.lit(2)), ["pressure"], "flag").collect()


def test_spearman_constant_and_ties(spark):
    x, y = [1, 2, 2, 3, 5, 5, 7], [2, 1, 4, 4, 6, 9, 9]
    df = spark.createDataFrame([("f", float(a), float(b)) for a, b in zip(x, y)] + [("c", 1.0, float(b)) for b in y], "feature string, value double, other double")
    rank = lambda v: np.array([np.mean(np.flatnonzero(np.sort(v) == k) + 1) for k in v])
    got = {r.feature: r.rho for r in diagnose.spearman(df, "other").collect()}
    assert got["f"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and got["c"] == 0.0


def test_fusion(spark):
    rows = [("group", "a", 0, 1, 0.9, 2.0, "positive"), ("group", "b", 1, 2, 0.5, None, "negative"), ("residual", "a", 0, 1, 0.3, 4.0, "negative")]
    df = spark.createDataFrame(rows, "source string, feature string, place int, rank int, confidence double, deviation double, direction string")
    got = {r.feature: r for r in diagnose.fuse(df, {"group": 0.5, "residual": 0.5, "absent": 1.0}).collect()}
    assert got["a"].conflict and got["a"].rrf_score == pytest.approx(1 / 61) and got["a"].deviation == pytest.approx((0.9 * 2 + 0.3 * 4) / 1.2)
    assert got["b"].partial and got["b"].confidence == pytest.approx(0.25) and got["b"].deviation == 0.0
    assert diagnose.aggregate_rrf(df).count() == 2


def test_events(spark):
    df = spark.createDataFrame([(i, i in (2, 5), float(i)) for i in range(8)], f"{ROW_ID} long, f boolean, s double")
    assert [r[ROW_ID] for r in events.select_events(df, "f", "s").orderBy("rank").collect()] == [5, 2]
    assert [r[ROW_ID] for r in events.select_events(df, "f", "s", least=3).orderBy("rank").collect()] == [5, 2, 7, 6, 4]
    assert events.flag_top_if_none(df.withColumn("f", F.lit(False)), "f", "s").filter("f").first()[ROW_ID] == 7
    assert events.flag_top_if_none(df, "f", "s").filter("f").count() == 2
    near = events.context_windows(df, df.filter(f"{ROW_ID} = 1").select(ROW_ID), [F.col(ROW_ID)])
    assert sorted((r.offset, r[ROW_ID]) for r in near.collect()) == [(-1, 0), (0, 1), (1, 2), (2, 3), (3, 4)]
    assert events.islands(df, "f", [F.col(ROW_ID)]).first() == (2, 2)
    assert events.enrichment(df, "f", "f").first().enrichment == 4.0


def test_recommendation(spark):
    rows = lambda *r: spark.createDataFrame(r, "variable string, minimum double, maximum double")
    current = spark.createDataFrame([("t", 5.0), ("p", 9.0), ("f", 1.0)], "variable string, value double")
    got = {r.variable: r for r in recommend.merge_constraints(rows(("t", 0.0, 10.0), ("p", 0.0, 4.0)), rows(("t", 2.0, None), ("f", 1.0, 1.0)), rows(("p", 5.0, None)), current).collect()}
    assert (got["t"].minimum, got["t"].maximum, got["t"].status) == (2.0, 10.0, "RESOLVED") and got["p"].status == "EMPTY" and got["f"].status == "FIXED"
    fixed = recommend.merge_constraints(rows(("t", 0.0, 10.0)), rows(("t", 0.0, 8.0)), rows(), current)
    points = recommend.grid_points(fixed)
    assert sorted(r.value for r in points.collect()) == [0.0, 2.0, 4.0, 5.0, 6.0, 8.0]
    cases = recommend.scenarios(points, ["t"]).orderBy("scenario_index").collect()
    assert [r["values"]["t"] for r in cases] == [5.0, 4.0, 6.0, 2.0, 8.0, 0.0] and cases[1].scenario_id == "SCN-000001"
    assert recommend.scenarios(points, ["t"], most=3).count() == 3
    ranked = recommend.rank_scenarios(recommend.score_linear(recommend.score_linear(recommend.scenarios(points, ["t"]), {"t": 1.0}, 0.0), {"t": 0.0}, 1.0, "anomaly_score"), "QUALITY").orderBy("rank").collect()
    assert ranked[0]["values"]["t"] == 8.0 and ranked[0].eligible and not any(r.eligible for r in ranked if r["values"]["t"] <= 5.0)
    near = recommend.neighbours(points, spark.createDataFrame([("t", 8.0)], "variable string, value double")).collect()
    assert [(r.direction, r.value) for r in near] == [("LOWER", 6.0)]
    assert recommend.stability(spark.createDataFrame([(True,), (False,)], "improves boolean"), True).first().stability == "MIXED"


def test_models_find_planted_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[:20] += 8
    df = spark.createDataFrame([(i, "train", *map(float, r)) for i, r in enumerate(x)], f"id long, {PARTITION} string, a double, b double, c double")
    for out in (models.isolation_forest(df, ["a", "b", "c"], "id", trees=50), models.elliptic_envelope(df, ["a", "b", "c"])):
        flagged = {r.id for r in out.filter("_is_anomaly").collect()}
        assert len(flagged) == 20 and len(flagged & set(range(20))) >= 18


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [3.0, -2.0] + 5 + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    assert models.ridge(df, ["a", "b"], "y").coefficients.toArray() == pytest.approx(want)


def test_routing(spark):
    meta = spark.createDataFrame([("d1", "column_names", "wafer_id"), ("d1", "column_names", "film_thickness"), ("d1", "user_description", "Wafer etch, deposition"), ("d2", "file_name", "x.csv"), ("d3", "user_description", "battery")], "dataset string, source string, text string")
    got = {r.dataset: (r.industry, r.decision) for r in routing.route_industry(routing.score_industries(meta)).collect()}
    assert got == {"d1": ("semiconductor", "AUTO_SELECTED"), "d2": ("generic", "FALLBACK_GENERIC"), "d3": ("battery", "CONFIRMATION_REQUIRED")}
    cols = spark.createDataFrame([("lot", "string", 5), ("event_time", "bigint", 9), ("x", "boolean", 2), ("label", "double", 90), ("yield", "double", 90), ("z", "double", 90)], "column_name string, dtype string, unique_count int")
    roles = {r.column_name: r.role for r in routing.map_roles(cols, {"lot": ("lot_id", "IDENTIFIER")}, {"z": "TARGET_QUALITY"}).collect()}
    assert roles == {"lot": "IDENTIFIER", "event_time": "TIME", "x": "CONTEXT", "label": "TARGET_QUALITY", "yield": "UNKNOWN", "z": "TARGET_QUALITY"}
    assert {r.feature: r.issue for r in routing.leaky_names(spark, ["yield", "yield_lag", "yield_error", "next_temp", "temp"], "yield").collect()} == {"yield": "TARGET_INCLUDED_AS_FEATURE", "yield_error": "TARGET_DERIVED_FEATURE", "next_temp": "FUTURE_DERIVED_FEATURE"}
    assert routing.route_task(spark.createDataFrame([("double", 3, 1000)], "dtype string, unique_count int, row_count int")).first().task == "CLASSIFICATION"
