"""Ranking, baselines, final evaluation, operating points and small table operators on tables worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kilnflow.operators import events, evaluate, models, prepare, recommend, routing, screening
from kilnflow.operators.prepare import PARTITION
from kilnflow.sources import tables
from kilnflow.sources.tables import ROW_ID


def ranks(df):
    return {r.model: r["rank"] for r in df.collect()}


def test_candidates_are_ranked_by_their_keys(spark):
    reg = spark.createDataFrame([("a", 1.0, 1.0, 0.5, 0), ("b", 1.0, 0.5, 0.1, 1), ("c", None, None, None, 2), ("d", 1.0, 1.0, 0.5, 3)], "model string, rmse double, mae double, r2 double, registry_rank int")
    assert ranks(screening.rank_regressors(reg)) == {"b": 1, "a": 2, "d": 3, "c": None}
    cls = spark.createDataFrame([("a", 0.5, 0.6, 0.9, 0), ("b", 0.5, 0.7, 0.1, 1), ("c", None, None, None, 2)], "model string, macro_f1 double, balanced_accuracy double, accuracy double, registry_rank int")
    assert ranks(screening.rank_classifiers(cls)) == {"b": 1, "a": 2, "c": None}
    det = spark.createDataFrame([("flat", 0, 0, 0.0, None, 0.0), ("wide", 1, 0, 2.0, 1.0, 0.1), ("near", 2, 0, 2.0, 1.0, 0.05), ("flagged", 3, 1, 9.0, 9.0, 0.0)], "model string, registry_rank int, n_flags int, std_score double, separation double, fraction_gap double")
    assert ranks(screening.rank_detectors(det)) == {"near": 1, "wide": 2, "flat": 3, "flagged": 4}


def test_failing_candidates_are_rows(spark):
    rows = [(i, float(i), float(i % 2), "train" if i < 8 else "validation") for i in range(12)]
    df = spark.createDataFrame(rows, f"i long, x double, label double, {PARTITION} string")

    def broken(*_):
        raise ValueError("no fit")

    out = {r.model: r for r in screening.screen_classifiers(df, {"broken": broken}, ["x"], "label").collect()}
    assert out["broken"].error == "no fit" and out["broken"]["rank"] is None and out["most_frequent"]["rank"] == 1
    found = {r.model: r for r in screening.screen_detectors(df, {"x": lambda d: screening.deviation_scores(d, "x"), "broken": broken}).collect()}
    assert found["x"]["rank"] == 1 and found["broken"].error == "no fit" and found["broken"]["rank"] == 2


def test_most_frequent_takes_the_least_among_equals(spark):
    df = spark.createDataFrame([("b", "train"), ("a", "train"), (None, "train"), (None, "train"), ("b", "test")], f"label string, {PARTITION} string")
    assert {r.p for r in screening.most_frequent(df, "label").collect()} == {"a"}


def test_final_evaluation_of_a_line(spark):
    rows = [(float(i), 2.0 * i + 1 + (5 if i >= 16 else 0), "train" if i < 12 else "validation" if i < 16 else "test") for i in range(20)]
    out = screening.final_regression(spark.createDataFrame(rows, f"x double, y double, {PARTITION} string"), models.linear, ["x"], "y").first()
    assert out.validation_rmse == pytest.approx(0, abs=1e-6) and out.test_rmse == pytest.approx(5) and out.performance_degraded and out.n_test == 4


def test_final_classification_gap(spark):
    m = lambda f: spark.createDataFrame([(f,)], "macro_f1 double")
    out = screening.final_classification(m(0.0), m(0.8), m(0.9)).first()
    assert out.generalization_gap == pytest.approx(-0.1) and not out.performance_degraded


def test_constant_feature_scores_nothing(spark):
    df = spark.createDataFrame([(1.0, "train"), (1.0, "train"), (5.0, "test")], f"x double, {PARTITION} string")
    assert {(r._anomaly_score, r._is_anomaly) for r in screening.deviation_scores(df, "x").collect()} == {(0.0, False)}


def test_explanation_orders_by_size(spark):
    rows = [(float(i), float(i * i % 7), 3.0 * i - 10.0 * (i * i % 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = screening.explain(models.linear(df, ["a", "b"], "y"), ["a", "b"]).orderBy("rank").collect()
    assert [(r.feature, round(r.value, 6)) for r in got] == [("b", -10.0), ("a", 3.0)]


def test_operating_points(spark):
    df = spark.createDataFrame([(1, 5, 0.1, 0.9), (2, 9, 0.8, 0.2), (3, 9, 0.8, None), (4, None, None, 0.9)], f"{ROW_ID} long, t long, r double, u double")
    at = lambda **k: events.choose_operating_point(df, k.pop("time", "t"), **k).first()[ROW_ID]
    assert at(explicit=spark.createDataFrame([(3,)], f"{ROW_ID} long")) == 3
    assert at(residual="r", unsupervised="u") == 2 and at(unsupervised="u") == 1 and at() == 2 and at(time=None) == 4


def test_relaxed_union_and_sequences(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2.5, 7, None)], "i double, s long, other date")
    out = prepare.union_relaxed(a, b)
    assert dict(out.dtypes) == {"i": "double", "s": "string", "other": "date"} and out.count() == 2
    t = spark.createDataFrame([(1, 1), (2, 2), (None, 3)], f"{ROW_ID} long, k long")
    same = prepare.same_sequence(t, [F.col("k")], t, [F.col("k")]).first()
    assert same.same and same.n_left == 3
    less = prepare.same_sequence(t, [F.col("k")], t.filter("k < 3"), [F.desc("k")]).first()
    assert not less.same and less.n_different == 3
    seen = prepare.first_seen(spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "m string, i long"), "m", "i").collect()
    assert [(r.m, r.first_place, r.occurrences) for r in seen] == [("b", 0, 2), ("a", 1, 1)]


def test_row_ids_in_file_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("v\n" + "\n".join(str((i * 7919) % 1000) for i in range(1000)) + "\n")
    rows = tables.load(spark, str(tmp_path / "t.csv")).collect()
    assert sorted(r[ROW_ID] for r in rows) == list(range(1000)) and all(r.v == (r[ROW_ID] * 7919) % 1000 for r in rows)


def test_unsure_synonyms_and_missing_targets(spark):
    columns = spark.createDataFrame([("temp c", "double", 5)], "column_name string, dtype string, unique_count int")
    role = lambda synonyms: routing.map_roles(columns, synonyms).first().role
    assert role({"temp_c": ("temperature", "PROCESS")}) == "PROCESS"
    assert role({"temp_c": ("temperature", "PROCESS"), "TEMP C": ("yield", "TARGET_QUALITY")}) == "UNKNOWN"
    none = spark.createDataFrame([(None, 0, 10)], "dtype string, unique_count int, row_count int")
    assert routing.route_task(none).first().task == "UNSUPERVISED_ANOMALY"


def test_recommendation_without_improvement(spark):
    ranked = spark.createDataFrame([(0, "SCN-000000", 0, 0.0, 0.0, 0.0, False, 1)], "scenario_index int, scenario_id string, change_count int, quality_gain double, anomaly_gain double, composite double, eligible boolean, rank int")
    gate = lambda s: spark.createDataFrame([(s,)], "status string")
    assert recommend.recommendation(ranked, gate("APPROVED")).first().status == "READY_FOR_OPTIMIZATION"
    assert recommend.recommendation(ranked, gate("REFUSED")).first().status == "REFUSED"


def test_refused_runs_stop(spark):
    factors = spark.createDataFrame([("x", 1, 0.9, True)], "feature string, rank int, confidence double, controllable boolean")
    bounds = lambda lo, hi: spark.createDataFrame([("x", lo, hi)], "variable string, minimum double, maximum double")
    merged = recommend.merge_constraints(bounds(0.0, 4.0), bounds(0.0, 4.0), bounds(0.0, 4.0), spark.createDataFrame([("x", 1.0)], "variable string, value double"))
    done, out = recommend.run_stages(factors, merged, None, {"LEAKAGE_BLOCKER": True})
    assert done == [{"stage": "SAFETY", "status": "REFUSED"}] and out is None
    assert evaluate.MIN_SCALE > 0
