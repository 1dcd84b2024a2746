"""What a run says against a recommendation, and the recommendation at the end of the workflow."""

import numpy as np
import pytest

from kilnflow.operators import recommend
from kilnflow.plans import workflow


def frames(spark, confidence=(0.5, 0.3), rows=9, severities=(), final=1, statuses=("ACCEPTABLE",), outside=0):
    one = lambda values, schema: spark.createDataFrame([(v,) for v in values], schema)
    return dict(
        factors=one(confidence, "confidence double"), reference=one([rows], "n_reference long"), leakage=one(severities, "severity string"), final=one([0.5] * final, "r2 double"), performance=one(statuses, "status string"), outside=one(["x"] * outside, "variable string"),
    )


def reasons(spark, **changes):
    return [(r.reason, r.blocks) for r in recommend.run_reasons(**frames(spark, **changes)).orderBy("place").collect()]


def test_reasons(spark):
    assert reasons(spark) == [] and reasons(spark, confidence=(0.2,), rows=5) == []
    assert reasons(spark, severities=["WARNING"]) == [("LEAKAGE_WARNING", False)]
    bad = reasons(spark, confidence=(), rows=4, severities=["WARNING", "BLOCKER", "BLOCKER"], final=0, statuses=("ACCEPTABLE", "UNAVAILABLE"), outside=2)
    assert bad == [(r, True) for r in recommend.RUN_REASONS] + [("LEAKAGE_WARNING", False)]
    assert reasons(spark, statuses=()) == reasons(spark, statuses=(None,)) == [("MODEL_PERFORMANCE_UNACCEPTABLE", True)]
    f = frames(spark)
    assert [r.reason for r in recommend.run_reasons(f["factors"], f["reference"]).orderBy("place").collect()] == ["FINAL_EVALUATION_MISSING", "MODEL_PERFORMANCE_UNACCEPTABLE"]


def test_decisions(spark):
    judged = spark.createDataFrame([("a", True)], "feature string, eligible boolean")
    decide = lambda j, **changes: tuple(recommend.gate_decision(j, recommend.run_reasons(**frames(spark, **changes))).first())
    assert decide(judged) == ("APPROVED", 1, 0, "")
    assert decide(judged, severities=["WARNING"]) == ("CAUTION", 1, 0, "")
    assert decide(judged, rows=1, final=0) == ("REFUSED", 1, 0, "FINAL_EVALUATION_MISSING,REFERENCE_SAMPLE_TOO_SMALL")
    assert decide(judged.selectExpr("feature", "false AS eligible"), rows=1) == ("REFUSED", 0, 1, "REFERENCE_SAMPLE_TOO_SMALL,NO_ELIGIBLE_VARIABLE")


@pytest.fixture(scope="module")
def process(spark, tmp_path_factory):
    """Quality falls with the distance of temperature from its bound; every twelfth row has one that the features don't explain."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(150):
        temp, pressure = rng.uniform(160, 200), rng.uniform(40, 60)
        rows.append((1_700_000_000 + 3600 * i, float(temp), float(pressure), float(20 + 0.5 * temp + 0.2 * pressure + rng.normal() * 0.3 - 15 * (i % 12 == 5))))
    path = str(tmp_path_factory.mktemp("g") / "process.parquet")
    spark.createDataFrame(rows, "timestamp long, temperature double, pressure double, quality double").write.parquet(path)
    return path


def test_workflow_recommends(spark, process):
    bounds = (("temperature", 150.0, 210.0), ("pressure", 30.0, 70.0))
    base = dict(path=process, order_by=["timestamp"], features=["temperature", "pressure"], target="quality", time="timestamp", bounds=bounds)
    report = workflow.run(spark, workflow.Request(**base, controllable=("temperature", "pressure"), accept=(("test_r2", "MIN", -1.0),)))
    assert report.status == "SUCCEEDED" and report.stages[-1]["stage"] == "RECOMMENDATION"
    steps = report.stages[-1]["steps"]
    decision, held = report.results["decision"].first(), [r.reason for r in report.results["reasons"].collect() if r.blocks]
    assert (steps[0]["status"] == "REFUSED") == bool(held or not decision.n_eligible)
    assert steps[-1]["stage"] == recommend.STAGES[-1], (steps, decision, held)
    out = report.results["recommendation"].first()
    assert out.status in ("GENERATED", "READY_FOR_OPTIMIZATION")
    if out.status == "GENERATED":
        assert out.quality_gain >= 0 and report.results["what_if"].count() >= 3
    poor = workflow.run(spark, workflow.Request(**base, controllable=("temperature",), accept=(("test_r2", "MIN", 1.1), ("none", "MIN", 0.0))))
    assert poor.stages[-1]["steps"] == [{"stage": "SAFETY", "status": "REFUSED"}] and "MODEL_PERFORMANCE_UNACCEPTABLE" in poor.results["decision"].first().reasons
