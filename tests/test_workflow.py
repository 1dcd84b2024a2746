"""The whole analysis, reports and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnflow.operators import events
from kilnflow.operators.prepare import PARTITION, Range
from kilnflow.plans import reporting, workflow
from kilnflow.sources.tables import ROW_ID
from kilnflow.streaming.scoring import score_stream, windowed_shift


@pytest.fixture(scope="module")
def process_table(spark, tmp_path_factory):
    """An hourly process with one row in fifteen shifted."""
    rng = np.random.default_rng(42)
    rows = []
    for i in range(180):
        odd = i % 15 == 7
        temp, pressure, flow = 180 + rng.normal() + 18 * odd, 60 + rng.normal() - 8 * odd, 100 + rng.normal() + 22 * odd
        rows.append((1_700_000_000 + 3600 * i, float(temp), float(pressure) if i % 20 else None, float(flow), float(50 + 0.1 * pressure + rng.normal() * 0.2 - 9 * odd), int(odd)))
    path = str(tmp_path_factory.mktemp("w") / "process.parquet")
    spark.createDataFrame(rows, "timestamp long, temperature double, pressure double, flow double, quality double, injected int").write.parquet(path)
    return path


FEATURES = ["temperature", "pressure", "flow"]


@pytest.mark.parametrize("target", ["quality", None])
def test_workflow_finds_the_injected_rows(spark, process_table, target):
    request = workflow.Request(process_table, ["timestamp"], FEATURES, target, "timestamp")
    report = workflow.run(spark, request)
    assert report.status == "SUCCEEDED", report.stages
    found = report.results["events"].join(spark.read.parquet(process_table).withColumn(ROW_ID, ((F.col("timestamp") - 1_700_000_000) / 3600).cast("long")), ROW_ID)
    precision = found.agg(F.avg("injected")).first()[0]
    assert precision / (12 / 180) >= 2.0
    assert report.results["factors"].count() and report.results["context"].count()
    assert report.manifest["run_signature"] == workflow.run(spark, request).manifest["run_signature"]
    assert {r.model for r in report.results["detector_screening"].filter("error IS NULL").collect()} == {"isolation_forest", "one_class", "elliptic_envelope"}
    assert {r[PARTITION] for r in report.results["detector_final"].collect()} == {"train", "validation", "test"}
    names = [s["stage"] for s in report.stages]
    assert [n for n in names if n in ("INDUSTRY_ROUTING", "TASK_ROUTING", "ROLE_MAPPING", "ANOMALY_SCREENING")] == ["INDUSTRY_ROUTING", *(["TASK_ROUTING"] if target else []), "ROLE_MAPPING", "ANOMALY_SCREENING"]
    assert report.results["preview"].count() == 20 and report.results["samples"].filter("column_name = 'pressure' AND place = 1").first().value is None


def test_workflow_routes_by_names_and_values(spark, process_table):
    run = lambda features=FEATURES, target="quality", **more: workflow.run(spark, workflow.Request(process_table, ["timestamp"], features, target, "timestamp", detectors=("isolation_forest",), max_events=1, **more))
    classes = run(FEATURES, "injected")
    assert (classes.status, classes.stages[-1]["refusal"]) == ("REFUSED", "TASK_CLASSIFICATION") and classes.results["task"].first().reason == "FEW_VALUES"
    assert run(FEATURES, "injected", task="REGRESSION").stages[-1].get("refusal") != "TASK_CLASSIFICATION"
    roles = run(roles=(("flow", "IDENTIFIER"),), description="battery cathode and anode")
    assert roles.stages[-1]["refusal"] == "LEAKAGE" and roles.results["industry"].first().industry == "battery"
    assert {r.column_name: r.role for r in roles.results["roles"].collect()} == {"timestamp": "TIME", "temperature": "STATE_SENSOR", "pressure": "UNKNOWN", "flow": "IDENTIFIER", "quality": "UNKNOWN", "injected": "UNKNOWN"}
    assert run(roles=(("gone", "TIME"),)).stages[-1]["refusal"] == "NO_SUCH_COLUMN"
    assert workflow.run(spark, workflow.Request(process_table, ["timestamp"], FEATURES, detectors=("none",))).stages[-1]["refusal"] == "NO_SUCH_DETECTOR"


def test_events_of_many_detectors(spark):
    rows = lambda *r: spark.createDataFrame(list(r), f"{ROW_ID} long, flagged boolean, score double")
    sources = [rows((1, True, 1.0), (2, False, 9.0), (1, True, 3.0)), rows((2, True, 2.0), (1, True, 8.0), (3, False, 5.0)), rows((3, True, 4.0), (4, False, 7.0))]
    got = {r[ROW_ID]: (r.flagged, r.score, r.source) for r in events.select_events_of(sources, most=10, least=10).collect()}
    assert got == {1: (True, 3.0, 0), 2: (True, 2.0, 1), 3: (True, 4.0, 2), 4: (False, 7.0, 2)}


def test_workflow_refuses(spark, process_table):
    empty = workflow.run(spark, workflow.Request(process_table, ["timestamp"], FEATURES, "quality", "timestamp", Range("temperature", 1e6)))
    assert empty.status == "REFUSED" and empty.stages[-1]["refusal"] == "EMPTY_COHORT"
    leak = workflow.run(spark, workflow.Request(process_table, ["timestamp"], [*FEATURES, "quality"], "quality", "timestamp"))
    assert leak.stages[-1]["refusal"] == "LEAKAGE"


def test_bundle_round_trip_and_tampering():
    bundle = reporting.write_bundle({"a.json": "{}", "b.txt": "é"})
    assert bundle == reporting.write_bundle({"b.txt": "é", "a.json": "{}"}) and reporting.verify_bundle(bundle) == []
    assert reporting.verify_bundle(b"no") == ["not a ZIP archive"]
    import io
    import zipfile

    out = io.BytesIO(bundle)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("extra.txt", "x")
    assert reporting.verify_bundle(out.getvalue()) == ["not listed: extra.txt"]
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("../up.txt", "x")
    assert reporting.verify_bundle(out.getvalue()) == ["unsafe name: ../up.txt"]


def test_manifests_and_presets():
    a = reporting.run_manifest("d", {"x": 1}, [], "SUCCEEDED")
    assert reporting.compare_manifests(a, a)["overall"] == "EXACT"
    assert reporting.compare_manifests(a, reporting.run_manifest("d", {"x": 2}, [], "SUCCEEDED"))["overall"] == "PARTIAL"
    assert reporting.preset_missing_columns({"target": "y", "features": ["a", "b"]}, ["a", "y"]) == ["b"]


def test_stream_scores_like_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 10:02d}:{i % 10 * 6:02d}:00", float(i % 7), float(i % 7) + (50.0 if i % 25 == 0 else 0.1)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ts string, x double, y double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    score = lambda d: score_stream(d, 1.0, 0.0, 0.1, 1.0, 3.5, "x", "y")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score(stream).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda d: {(r.id, r._is_residual_anomaly) for r in d.collect()}
    assert key(spark.table("scored")) == key(score(df)) and spark.table("scored").filter("_is_residual_anomaly").count() == 4
    w = windowed_shift(score(stream), "ts", 0.0, 0.0, 1.0).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n_rows")).first()[0] >= 80
