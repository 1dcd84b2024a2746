"""Edge cases of constraints that users widen, improvement checks, candidate filters and event verdicts."""

from kilnflow.operators import events, profile, recommend, screening

BOUNDS = "variable string, minimum double, maximum double"


def test_widening_replaces_bounds(spark):
    base = spark.createDataFrame([("a", 0.0, 4.0), ("b", 0.0, 4.0)], BOUNDS)
    user = spark.createDataFrame([("a", None, 6.0), ("b", 5.0, None), ("c", 0.0, 2.0)], BOUNDS)
    current = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 1.0)], "variable string, value double")
    got = {r.variable: (r.minimum, r.maximum, r.widened, r.status, r.n_sources) for r in recommend.merge_constraints(base, base, user, current, widen=True).collect()}
    assert got == {"a": (0.0, 6.0, True, "RESOLVED", 3), "b": (5.0, 4.0, False, "EMPTY", 3), "c": (0.0, 2.0, False, "RESOLVED", 1)}
    kept = {r.variable: (r.minimum, r.maximum, r.status) for r in recommend.merge_constraints(base, base, user, current).collect()}
    assert kept["a"] == (0.0, 4.0, "OUTSIDE")


def test_improvements_need_every_component(spark):
    rows = [(1, 2.0, 1.0, 0.5, 0.5), (2, 2.0, 1.0, 0.4, 0.5), (3, 1.0 + 1e-13, 1.0, 0.4, 0.5), (4, None, 1.0, 0.4, 0.5), (5, 0.0, 1.0, 0.4, 0.5)]
    df = spark.createDataFrame(rows, "i int, quality double, reference_quality double, anomaly double, reference_anomaly double")
    of = lambda **k: {r.i: (r.improves, r.improves_or_matches) for r in recommend.improvements(df, **k).collect()}
    assert of() == {1: (False, True), 2: (True, True), 3: (False, True), 4: (None, None), 5: (False, False)}
    assert of(objective="ANOMALY")[4] == (True, True)
    assert of(objective="QUALITY", direction="MINIMIZE")[5] == (True, True)
    assert of(objective="QUALITY", direction="TARGET", target=1.5)[2] == (False, True)


def test_candidates_need_finite_bounds_around_the_value(spark):
    names = ["a", "b", "c", "d"]
    features = spark.createDataFrame([(v, i) for i, v in enumerate(names)], "variable string, place int")
    factors = spark.createDataFrame([(v,) for v in [*names, "a"]], "feature string")
    stated = spark.createDataFrame([(v, "CONTROLLABLE_PROCESS", True, True) for v in names], "variable string, role string, confirmed boolean, verified boolean")
    bounds = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, float("inf")), ("c", None, 2.0), ("d", 2.0, 3.0)], BOUNDS)
    current = spark.createDataFrame([(v, 1.0) for v in names], "variable string, value double")
    at = lambda blocked: [r.variable for r in recommend.anomaly_candidates(features, factors, stated, bounds, current, blocked).collect()]
    assert at([]) == ["a"] and at(["a"]) == []


def test_verdicts_of_no_events(spark):
    truth = spark.createDataFrame([(1, True, "x"), (2, None, None)], "row_id long, is_anomaly boolean, kind string")
    shown = spark.createDataFrame([(1, None), (2, "1.5"), (3, "1"), (4, "1 ")], "place int, sample_id string")
    assert [r.verdict for r in events.judge_events(shown, truth).orderBy("place").collect()] == ["INVALID_ID", "INVALID_ID", "MATCHED", "DUPLICATE"]
    assert events.judge_events(shown.limit(0), truth).count() == 0
    assert events.context_features(spark.createDataFrame([("a", 1)], "feature string, rank int"), []).count() == 0


def test_identifiers_and_candidates_of_empty_tables(spark):
    t = spark.createDataFrame([(None, "a"), (3, "a"), (3, "b")], "i int, s string")
    of = lambda df: {r.column_name: r.chosen for r in profile.identifier_choice(df, ["i", "s"]).collect()}
    assert of(t) == {"i": False, "s": True} and of(t.limit(0)) == {"i": False, "s": False}
    empty = spark.createDataFrame([], "model string, priority int, place int")
    one = spark.createDataFrame([("m", 1, 0)], "model string, priority int, place int")
    assert screening.merge_candidates(empty, empty, ["model"]).count() == 0
    assert [(r.source, r["rank"]) for r in screening.merge_candidates(one, one, ["model"]).collect()] == [("industry_profile", 1)]
