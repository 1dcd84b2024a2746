"""Industries, roles and tasks of a catalog, against rows worked out by hand."""

import pytest

from kilnflow.operators import catalog, suggestions

MAPPED = "table_name string, place int, column_name string, dtype string, row_count long, null_count long, unique_count long, cardinality_ratio double, role string, confidence double, low_confidence boolean"
ASKED = "table_name string, task string, target string, time_column string"


def column(table, place, name, dtype, role, nulls=0, unique=900, rows=1000, confidence=0.95):
    return (table, place, name, dtype, rows, nulls, unique, unique / rows if rows else 0.0, role, confidence, role != "UNKNOWN" and confidence < 0.80)


@pytest.fixture(scope="module")
def mapped(spark):
    rows = [
        column("regress", 0, "y", "double", "TARGET_QUALITY"), column("regress", 1, "t", "timestamp_ntz", "TIME"),
        column("codes", 0, "y", "int", "TARGET_QUALITY", unique=20, rows=400), column("codes_not", 0, "y", "int", "TARGET_QUALITY", unique=21, rows=1000), column("codes_few_rows", 0, "y", "decimal(9,2)", "TARGET_QUALITY", unique=20, rows=399),
        column("text", 0, "y", "varchar(9)", "TARGET_QUALITY", unique=2), column("truth", 0, "y", "boolean", "TARGET_QUALITY", unique=2), column("dated", 0, "y", "date", "TARGET_QUALITY"), column("nested", 0, "y", "array<int>", "TARGET_QUALITY"),
        column("two", 3, "b", "double", "TARGET_QUALITY"), column("two", 1, "z", "double", "TARGET_QUALITY", nulls=1000, confidence=0.75),
        column("doubtful", 0, "y", "double", "TARGET_QUALITY", confidence=0.75), column("lacking", 0, "y", "double", "TARGET_QUALITY", nulls=999), column("lacking", 1, "t", "date", "TIME"), column("lacking", 2, "u", "date", "TIME"),
        column("empty", 0, "y", "double", "TARGET_QUALITY", rows=0, unique=0), column("times", 5, "a", "date", "TIME"), column("times", 2, "b", "date", "TIME", confidence=0.7), column("nothing", 0, "x", "double", "UNKNOWN", confidence=0.0),
    ]
    return spark.createDataFrame(rows, MAPPED)


def test_tasks_by_targets(mapped):
    got = {r.table_name: r for r in catalog.tasks(mapped).collect()}
    short = {t: (r.decision, r.task, r.target, r.time_column, r.reason, tuple(r.warnings)) for t, r in got.items()}
    auto, ask = "AUTO_SELECTED", "CONFIRMATION_REQUIRED"
    assert short == {
        "regress": (auto, "REGRESSION", "y", None, "CONTINUOUS_TARGET", ()),
        "codes": (ask, "CLASSIFICATION", "y", None, "FEW_VALUES", ("FEW_VALUES",)),
        "codes_not": (auto, "REGRESSION", "y", None, "CONTINUOUS_TARGET", ()),
        "codes_few_rows": (auto, "REGRESSION", "y", None, "CONTINUOUS_TARGET", ()),
        "text": (auto, "CLASSIFICATION", "y", None, "TEXT_TARGET", ()),
        "truth": (auto, "CLASSIFICATION", "y", None, "BOOLEAN_TARGET", ()),
        "dated": (ask, "REGRESSION", "y", None, "TEMPORAL_TARGET", ("TEMPORAL_TARGET",)),
        "nested": (ask, "REGRESSION", "y", None, "OTHER_TARGET", ("OTHER_TARGET",)),
        "two": (ask, "REGRESSION", "z", None, "SEVERAL_TARGETS", ("SEVERAL_TARGETS", "LOW_CONFIDENCE_TARGET")),
        "doubtful": (ask, "REGRESSION", "y", None, "CONTINUOUS_TARGET", ("LOW_CONFIDENCE_TARGET",)),
        "lacking": (ask, "TIME_SERIES_ANOMALY", None, "t", "SEVERAL_TIMES", ("TOO_FEW_TARGET_VALUES", "SEVERAL_TIMES")),
        "empty": (ask, "UNSUPERVISED_ANOMALY", None, None, "TOO_FEW_TARGET_VALUES", ("TOO_FEW_TARGET_VALUES",)),
        "times": (ask, "TIME_SERIES_ANOMALY", None, "b", "SEVERAL_TIMES", ("SEVERAL_TIMES", "LOW_CONFIDENCE_TIME")),
        "nothing": (auto, "UNSUPERVISED_ANOMALY", None, None, "NO_TARGET", ()),
    }
    assert got["two"].targets == ["z", "b"] and got["times"].times == ["b", "a"] and got["nothing"].targets == []
    assert got["codes"].candidates == ["CLASSIFICATION", "REGRESSION", "RESIDUAL_ANOMALY"] and got["dated"].candidates == ["REGRESSION", "CLASSIFICATION"]
    assert got["codes"].needs_confirmation and not got["text"].needs_confirmation


def test_chosen_columns_and_policy(spark, mapped):
    asked = spark.createDataFrame([("two", None, "b", None), ("times", None, None, "a"), ("nothing", None, "x", None), ("lacking", "REGRESSION", "y", "t"), ("regress", "RESIDUAL_ANOMALY", "y", None), ("regress", "UNSUPERVISED_ANOMALY", None, None), ("codes", None, "gone", None)], ASKED)
    got = {r.table_name: r for r in catalog.tasks(mapped, asked, prefer_time=False).collect()}
    assert (got["two"].decision, got["two"].target, got["two"].warnings) == ("AUTO_SELECTED", "b", [])
    assert (got["times"].decision, got["times"].task, got["times"].time_column, got["times"].times) == ("AUTO_SELECTED", "UNSUPERVISED_ANOMALY", "a", ["b", "a"])
    assert (got["nothing"].task, got["nothing"].targets) == ("REGRESSION", ["x"])
    assert (got["lacking"].decision, got["lacking"].reason, got["lacking"].task) == ("REFUSED", "TOO_FEW_TARGET_VALUES", None)
    assert got["regress"].task == "RESIDUAL_ANOMALY"  # the smallest of a table's rows
    assert got["codes"].reason == "NO_SUCH_COLUMN"
    assert catalog.tasks(mapped.limit(0), asked).count() == 0
    assert {r.task for r in catalog.tasks(mapped.filter("table_name = 'codes'"), most_classes=19).collect()} == {"REGRESSION"}


def test_roles_go_by_the_tables_industry(spark):
    tables = {"a": spark.createDataFrame([(1, 2.0, "p", 3)], "lot_id int, Thickness double, temp string, both int"), "b": spark.createDataFrame([(1, "q")], "lot_id int, temp string"), "c": spark.createDataFrame([], "lot int, flag boolean")}
    facts = suggestions.column_facts(tables, order=False)
    routed = spark.createDataFrame([("a", "semiconductor"), ("b", "battery"), ("c", "generic")], "table_name string, industry string")
    own = catalog.industry_hints(spark).unionByName(spark.createDataFrame([("semiconductor", "both", "gas_flow", "CONTROLLABLE_PROCESS", None), ("semiconductor", "BOTH", "yield", "TARGET_QUALITY", None)], "industry string, name string, canonical string, role string, unit string"))
    overrides = spark.createDataFrame([("b", "temp", "CONTEXT"), ("a", "Lot_ID", "TIME"), ("b", "lot_id", "KING")], "table_name string, column_name string, role string")
    mapped = catalog.roles(facts, routed, overrides.filter("role <> 'KING'"), own)
    got = {(r.table_name, r.column_name): (r.role, r.confidence, r.canonical, r.unit) for r in mapped.collect()}
    assert got == {
        ("a", "lot_id"): ("IDENTIFIER", 0.98, "lot_id", None), ("a", "Thickness"): ("TARGET_QUALITY", 0.95, "film_thickness", "nm"), ("a", "temp"): ("IDENTIFIER", 0.70, None, None), ("a", "both"): ("UNKNOWN", 0.0, None, None),
        ("b", "lot_id"): ("IDENTIFIER", 0.95, "batch_id", None), ("b", "temp"): ("CONTEXT", 1.0, None, None), ("c", "lot"): ("UNKNOWN", 0.0, None, None), ("c", "flag"): ("CONTEXT", 0.80, None, None),
    }
    assert mapped.filter("column_name = 'both'").first().alternatives == ["CONTROLLABLE_PROCESS", "TARGET_QUALITY"]
    summary = {r.table_name: r for r in catalog.role_summary(mapped).collect()}
    assert (summary["a"].unresolved, summary["a"].low, summary["a"].needs_confirmation) == (["both"], ["temp"], True)
    assert (summary["b"].unresolved, summary["b"].needs_confirmation) == ([], False)
    counts = {(r.table_name, r.role): r.n for r in catalog.role_counts(mapped).collect()}
    assert len(counts) == 24 and counts["a", "IDENTIFIER"] == 2 and counts["b", "TIME"] == 0
    assert {(r.column_name, r.reason) for r in catalog.unknown_overrides(facts, overrides).collect()} == {("Lot_ID", "NO_SUCH_COLUMN"), ("lot_id", "NO_SUCH_ROLE")}
