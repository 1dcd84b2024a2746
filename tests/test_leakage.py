"""Leakage reports, names that leak, quality flags and fitted detectors in screening, on tables worked out by hand."""

import pytest

from kilnflow.operators import detectors, diagnose, evaluate, leakage, recommend, screening
from kilnflow.operators.prepare import PARTITION


def features(spark, *names):
    return spark.createDataFrame([(n, None) for n in names], "feature string, role string")


def split(spark, *rows):
    return spark.createDataFrame(list(rows), f"id long, lot string, ts long, {PARTITION} string")


CLEAN = [(1, "a", 1, "train"), (2, "a", 2, "train"), (3, "b", 2, "validation"), (4, "c", 3, "test")]


def kinds(report):
    return [(r.issue, r.columns, r.partitions) for r in report.orderBy("place").collect()]


def test_safe_split_has_no_issue(spark):
    report = leakage.check(split(spark, *CLEAN), "id", features(spark, "temp", "pressure"), "yield", "lot", "ts", summary=split(spark, *CLEAN))
    assert kinds(report) == []
    leakage.assert_safe(report)


def test_row_rules(spark):
    rows = [*CLEAN, (1, "a", 9, "test"), (5, "a", 8, "validation")]
    report = leakage.check(split(spark, *rows), "id", features(spark, "temp"), "yield", "lot", "ts", summary=split(spark, *CLEAN))
    assert kinds(report) == [
        ("ORIGINAL_ROW_ID_OVERLAP", ["id"], ["train", "test"]), ("SPLIT_SUMMARY_MISMATCH", ["id"], ["validation", "test"]),
        ("GROUP_PARTITION_OVERLAP", ["lot"], ["train", "validation", "test"]), ("TIME_ORDER_VIOLATION", ["ts"], ["validation", "test"]),
    ]
    with pytest.raises(leakage.LeakageError, match="4 leakage blockers: ORIGINAL_ROW_ID_OVERLAP, SPLIT_SUMMARY_MISMATCH, GROUP_PARTITION_OVERLAP, TIME_ORDER_VIOLATION"):
        leakage.assert_safe(report)


def test_time_order_without_validation(spark):
    rows = [(1, "a", 5, "train"), (2, "b", 5, "test"), (3, "c", 4, "test")]
    assert kinds(leakage.check(split(spark, *rows), "id", features(spark), time="ts")) == [("TIME_ORDER_VIOLATION", ["ts"], ["train", "test"])]
    assert kinds(leakage.check(split(spark, *rows[:2]), "id", features(spark), time="ts")) == []


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("temperature", ["TARGET_INCLUDED_AS_FEATURE"]), ("chamber_temperature", []), ("Temperature Residual", ["TARGET_DERIVED_FEATURE"]), ("next_temperature", ["TARGET_DERIVED_FEATURE", "FUTURE_DERIVED_FEATURE"]),
        ("lead_time", ["FUTURE_DERIVED_FEATURE"]), ("leading", []), ("completion_time", ["OUTCOME_TIMESTAMP_FEATURE"]), ("completion", []), ("start_time", []), ("_original_row_id", ["IDENTIFIER_INCLUDED_AS_FEATURE"]), ("---", []), ("error", []),
    ],
)
def test_names(spark, name, want):
    assert [r.issue for r in leakage.name_issues(features(spark, name), "temperature").collect()] == want


def test_fit_scope_and_identifier_roles(spark):
    steps = spark.createDataFrame([(["a"], None), (["b"], False), (["c"], True)], "columns array<string>, on_train boolean")
    names = spark.createDataFrame([("lot", "IDENTIFIER"), ("temp", "STATE_SENSOR")], "feature string, role string")
    report = leakage.check(split(spark, *CLEAN), "id", names, None, steps=steps)
    assert [(r.issue, r.severity) for r in report.collect()] == [("IDENTIFIER_INCLUDED_AS_FEATURE", "BLOCKER"), ("PREPROCESSING_FIT_SCOPE_UNKNOWN", "WARNING"), ("PREPROCESSING_NOT_FIT_ON_TRAINING_DATA", "BLOCKER")]


def test_detection_without_anomalies_is_degenerate(spark):
    def flags(*rows):
        return evaluate.quality_flags(evaluate.label_free_metrics(spark.createDataFrame(list(rows), f"{PARTITION} string, s double, f boolean"), "s", "f")).first().flags

    train = [("train", float(i), i == 19) for i in range(20)]
    assert flags(*train, *[("validation", float(i), i == 9) for i in range(10)]) == []
    assert flags(*train, *[("validation", float(i), False) for i in range(10)]) == ["FRACTION_TOO_LOW", "DEGENERATE"]
    assert flags(*train, *[("validation", 1.0, True) for i in range(10)]) == ["FRACTION_TOO_HIGH", "FRACTION_GAP", "NEARLY_CONSTANT", "DEGENERATE"]


def test_screening_fits_on_train_and_returns_the_best(spark):
    rows = [(i, float(i % 7), float(i % 5), "train" if i < 60 else "validation" if i < 80 else "test") for i in range(100)]
    rows += [(200, 90.0, 90.0, "train"), (201, 95.0, 80.0, "validation"), (202, 99.0, 99.0, "test")]
    df = spark.createDataFrame(rows, f"id long, a double, b double, {PARTITION} string")

    def broken(train, names):
        raise detectors.FitError("no fit")

    fits = {"forest": lambda t, f: detectors.fit_forest(t, f, trees=30), "broken": broken, "envelope": detectors.fit_envelope}
    ranked, best = screening.screen_fitted(df, ["a", "b"], fits)
    got = {r.model: r for r in ranked.collect()}
    assert got["broken"].error == "no fit" and got["broken"]["rank"] == 3 and {got["forest"]["rank"], got["envelope"]["rank"]} == {1, 2}
    assert best.kind == min(("forest", "envelope"), key=lambda m: got[m]["rank"])
    scored, _ = screening.final_fitted(df, ["a", "b"], detectors.fit_envelope)
    assert {r.id for r in scored.filter(f"_is_anomaly AND {PARTITION} = 'test'").collect()} >= {202}
    cases = spark.createDataFrame([(0, {"a": 3.0, "b": 2.0}), (1, {"a": 90.0, "b": 90.0}), (2, {"a": 1.0})], "scenario_index int, values map<string,double>")
    out = {r.scenario_index: r for r in recommend.score_detected(cases, best).collect()}
    assert out[0].anomaly_score_delta == 0 and out[1].anomaly_score_delta > 0 and out[2].anomaly_score is None


def test_diagnosis_refuses_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0, False), (float("nan"), False), (2.0, True)], "x double, f boolean")
    with pytest.raises(Exception, match="x has a value that is not finite"):
        diagnose.group_comparison(df, ["x"], "f").collect()
