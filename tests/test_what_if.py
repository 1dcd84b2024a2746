"""What-if checks of a proposed scenario: its neighbours and each class of stability."""

import pytest
from pyspark.sql import functions as F

from kilnflow.operators import recommend

NOW = {"x": 2.0, "y": 20.0}


def grid(spark):
    rows = [(v, k * (1.0 if v == "x" else 10.0), k == 2) for v in NOW for k in range(5)]
    return spark.createDataFrame(rows, "variable string, value double, is_current boolean")


def proposal(spark, **changes):
    return spark.createDataFrame([(i, v, x) for i, (v, x) in enumerate(changes.items())], "place int, variable string, value double")


def by(quality, seen=None):
    def score(rows):
        if seen is not None:
            seen.extend(r.scenario_id for r in rows.select("scenario_id").collect())
        at = lambda v: F.element_at("values", v)
        return rows.withColumn("quality_prediction", quality(at("x"), at("y"))).withColumn("anomaly_score", F.lit(None).cast("double"))

    return score


def verdict(spark, quality, direction="MAXIMIZE", target=None, **changes):
    t = recommend.what_if(grid(spark), proposal(spark, **changes), by(quality), "QUALITY", direction, target)
    r = recommend.what_if_verdict(t).first()
    return r.n_neighbours, r.n_improving, r.stability


def test_scenarios_and_scores(spark):
    seen = []
    t = recommend.what_if(grid(spark), proposal(spark, y=40.0 + 1e-13, x=3.0), by(lambda x, y: x + y, seen), "QUALITY")
    rows = t.orderBy("place").collect()
    assert [(r.scenario_id, r.kind, r.variable, r["values"]) for r in rows] == [
        ("WIF-000000", "BASELINE", None, NOW), ("WIF-000001", "PROPOSED_CENTER", None, {"x": 3.0, "y": 40.0}), ("WIF-000002", "LOWER_NEIGHBOR", "y", {"x": 3.0, "y": 30.0}),
        ("WIF-000003", "LOWER_NEIGHBOR", "x", {"x": 2.0, "y": 40.0}), ("WIF-000004", "UPPER_NEIGHBOR", "x", {"x": 4.0, "y": 40.0}),
    ]
    assert [r.quality_prediction for r in rows] == [22.0, 43.0, 33.0, 42.0, 44.0]
    assert [r.improves for r in rows] == [False, True, True, True, True] and [r.improves_or_matches for r in rows] == [False, True, False, False, True]
    assert len(seen) == 5


def test_equal_scenarios_are_scored_once(spark):
    seen = []
    t = recommend.what_if(grid(spark), proposal(spark, x=3.0), by(lambda x, y: x, seen), "QUALITY")
    rows = t.orderBy("place").collect()
    assert [(r.kind, r.first, r.quality_prediction, r.improves) for r in rows] == [("BASELINE", 0, 2.0, False), ("PROPOSED_CENTER", 1, 3.0, True), ("LOWER_NEIGHBOR", 0, 2.0, False), ("UPPER_NEIGHBOR", 3, 4.0, True)]
    assert sorted(seen) == ["WIF-000000", "WIF-000001", "WIF-000003"]


def test_classes(spark):
    assert verdict(spark, lambda x, y: y, y=40.0) == (1, 1, "STABLE")
    assert verdict(spark, lambda x, y: x, x=3.0) == (2, 1, "MIXED")
    assert verdict(spark, lambda x, y: F.when(x == 3, 1.0).otherwise(0.0), x=3.0) == (2, 0, "ISOLATED")
    assert verdict(spark, lambda x, y: -x, x=3.0) == (2, 0, "NOT_IMPROVING")
    assert verdict(spark, lambda x, y: -x, "MINIMIZE", x=3.0)[2] == "NOT_IMPROVING" and verdict(spark, lambda x, y: -x, "MINIMIZE", y=30.0)[2] == "NOT_IMPROVING"
    assert verdict(spark, lambda x, y: x, "TARGET", 4.0, x=4.0) == (1, 1, "STABLE")
    lone = spark.createDataFrame([("x", 5.0, False), ("z", 1.0, True)], "variable string, value double, is_current boolean").unionByName(grid(spark).filter("variable = 'y'"))
    t = recommend.what_if(lone, proposal(spark, x=5.0), by(lambda x, y: F.coalesce(x, F.lit(0.0))), "QUALITY")
    assert recommend.what_if_verdict(t).first().stability == "NO_NEIGHBORS"


def test_proposals(spark):
    with pytest.raises(Exception, match="not on the grid"):
        recommend.what_if_scenarios(grid(spark), proposal(spark, x=2.5)).collect()
    ranked = spark.createDataFrame([(2, True, ["x"], {"x": 3.0, "y": 20.0}), (1, False, ["y"], {"x": 2.0, "y": 30.0}), (3, True, ["y"], {"x": 2.0, "y": 0.0})], "rank int, eligible boolean, changed array<string>, values map<string,double>")
    assert [tuple(r) for r in recommend.proposal_of(ranked).collect()] == [(0, "x", 3.0)]
    assert recommend.proposal_of(ranked.filter("NOT eligible")).count() == 0


def test_classes_when_minimizing(spark):
    """Lower is better; also what test_classes asserts after its line on MINIMIZE."""
    assert verdict(spark, lambda x, y: -x, "MINIMIZE", x=3.0) == (2, 1, "MIXED")  # -2 now, -3 proposed; neighbours -2 and -4
    assert verdict(spark, lambda x, y: x, "MINIMIZE", x=3.0) == (2, 0, "NOT_IMPROVING")
    assert verdict(spark, lambda x, y: -x, "MINIMIZE", y=30.0) == (2, 0, "NOT_IMPROVING")
    assert verdict(spark, lambda x, y: x, "TARGET", 4.0, x=4.0) == (1, 1, "STABLE")
    lone = spark.createDataFrame([("x", 5.0, False), ("z", 1.0, True)], "variable string, value double, is_current boolean").unionByName(grid(spark).filter("variable = 'y'"))
    t = recommend.what_if(lone, proposal(spark, x=5.0), by(lambda x, y: F.coalesce(x, F.lit(0.0))), "QUALITY")
    assert recommend.what_if_verdict(t).first().stability == "NO_NEIGHBORS"
