"""Forests of many rows in few cells: what the learner is given, and that they are the forests of the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from kilnflow.operators import forests, models
from kilnflow.operators.prepare import PARTITION


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(forests, "LEAST_ROWS", 1000, raising=False)


@pytest.fixture(scope="module")
def grid(spark):
    """6,400 rows in 64 cells; ``y`` follows from the cell, ``noisy`` has a deviation of 1 within it, and a third of ``label`` is turned."""
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), 3.0 * a + b * b, 3.0 * a + b * b + float(rng.normal()), float((a > 3) != (i % 3 == 0))) for i, (a, b) in enumerate((i % 8, i // 8 % 8) for i in range(6400))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, noisy double, label double").cache()


@pytest.mark.parametrize("kind, fit, target", [(RandomForestRegressor, models.forest_regressor, "noisy"), (RandomForestClassifier, models.forest_classifier, "label")])
def test_no_tree_passes_over_the_rows(spark, grid, small, monkeypatch, kind, fit, target):
    given, plain = [], kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, df: (given.append(df.count()), plain(self, df))[1])
    model = fit(grid, ["a", "b"], target, trees=3, depth=4)
    assert len(given) == 3 and max(given) <= 64 * 2
    assert len(model.forest.trees) == 3 and model.featureImportances.size == 2


def test_a_target_that_follows_from_the_cell_is_met(grid, small):
    out = models.predict(models.forest_regressor(grid, ["a", "b"], "y", trees=3), grid, ["a", "b"])
    assert out.columns == [*grid.columns, "p"] and out.count() == 6400
    assert out.filter(F.abs(F.col("p") - F.col("y")) > 1e-9).count() == 0


def test_noisy_means_and_classes_equal_those_of_a_forest_of_the_rows(grid, small, monkeypatch):
    cells = grid.groupBy("a", "b").agg(F.avg("noisy").alias("mean"), F.avg("label").alias("share"))
    by = lambda m, c: {(r.a, r.b): r.p for r in models.predict(m, cells, ["a", "b"]).select("a", "b", "p").collect()}
    new = by(models.forest_regressor(grid, ["a", "b"], "noisy", trees=10), "mean"), by(models.forest_classifier(grid, ["a", "b"], "label", trees=10), "share")
    monkeypatch.setattr(forests, "LEAST_ROWS", 1 << 40)
    old = by(models.forest_regressor(grid, ["a", "b"], "noisy", trees=10), "mean"), by(models.forest_classifier(grid, ["a", "b"], "label", trees=10), "share")
    gaps = [abs(new[0][k] - old[0][k]) for k in old[0]]
    assert len(gaps) == 64 and max(gaps) < 0.25 and new[1] == old[1]  # a mean of 10 bootstraps of 100 rows varies by some 0.03


def bags(spark, rows):
    path = forests._bags(rows, 50, 42)
    return sorted(map(tuple, spark.read.parquet(path).select("tree", "_cell", "w", "y").collect()))


def test_weights_are_a_bootstrap_whatever_the_partitions(spark, monkeypatch):
    rows = spark.createDataFrame([(c, float(y), 1 + (c + y) % 3) for c in range(5) for y in range(200)], "_cell long, y double, n long")
    first, again = bags(spark, rows.repartition(3)), bags(spark, rows.repartition(7, "y"))
    assert [x[:3] for x in first] == [x[:3] for x in again] and [x[3] for x in first] == pytest.approx([x[3] for x in again])
    n = sum(r.n for r in rows.collect())
    per_tree = np.array([sum(x[2] for x in first if x[0] == t) for t in range(50)])
    assert abs(per_tree.mean() - n) < 5 * (n / 50) ** 0.5 and 0.4 * n < per_tree.var() < 2 * n
    assert np.mean([x[3] for x in first]) == pytest.approx(99.5, abs=1.5)
    monkeypatch.setattr(forests, "SLICE", 50)  # a cell's targets in four slices are the same rows
    sliced = np.array(bags(spark, rows))
    assert abs(sliced[:, 2].sum() / 50 - n) < 5 * (n / 50) ** 0.5 and len(sliced) == 250


def test_other_tables_have_a_forest_of_their_rows(spark, grid, small, monkeypatch):
    cells = lambda df, f=("a", "b"), target="y": isinstance(models.forest_regressor(df, list(f), target, trees=2, depth=2), forests.CellForest)
    assert cells(grid) and not cells(grid, ["id", "noisy", "a", "b"])  # nearly as many cells as rows
    assert cells(grid.withColumn("a", F.lit(1.0)))  # a constant
    monkeypatch.setattr(forests, "MOST_CELLS", 63)
    assert not cells(grid)
    monkeypatch.setattr(forests, "LEAST_ROWS", 6401)
    monkeypatch.setattr(forests, "MOST_CELLS", 64)
    assert not cells(grid)


def test_missing_values_are_errors_as_before(grid, small):
    gap = grid.withColumn("a", F.when(F.col("id") > 0, F.col("a")))
    with pytest.raises(Exception, match="(?i)null"):
        models.forest_regressor(gap, ["a", "b"], "y", trees=2)
    with pytest.raises(Exception, match="(?i)null"):
        models.forest_regressor(grid.withColumn("y", F.when(F.col("id") > 0, F.col("y"))), ["a", "b"], "y", trees=2)
    model = models.forest_regressor(grid, ["a", "b"], "y", trees=2)
    for bad in (gap, grid.withColumn("a", F.when(F.col("id") > 0, F.col("a")).otherwise(float("nan")))):
        with pytest.raises(Exception, match="(?i)null|nan"):
            models.predict(model, bad, ["a", "b"]).collect()
    assert models.predict(model, grid.limit(0), ["a", "b"]).count() == 0
    assert models.predict(model, grid.limit(1).withColumn("a", F.lit(1e9)), ["a", "b"]).count() == 1


def test_rare_values_and_ties_keep_their_bins(spark):
    rows = spark.createDataFrame([(0.0 if i % 10 else float(i), float(i % 5)) for i in range(5000)] + [(0.0, 99.0)], "x0 double, x1 double")
    ties, few = forests._limits(rows, [500, 6])
    assert few == (0.5, 1.5, 2.5, 3.5, 51.5) and 10 <= len(ties) < forests.BINS and list(ties) == sorted(set(ties))


def test_screening_fits_its_forest_on_cells(grid, small, monkeypatch):
    given, plain = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, df: (given.append(df.count()), plain(self, df))[1])
    parts = grid.withColumn(PARTITION, F.when(F.col("id") < 3840, "train").when(F.col("id") < 5120, "validation").otherwise("test"))
    out = {r.model: r for r in models.screen(parts, {"linear": models.linear, "forest": lambda t, f, y: models.forest_regressor(t, f, y, trees=3)}, ["a", "b"], "noisy").collect()}
    assert given and max(given) <= 64
    assert {r.error for r in out.values()} == {None} and out["forest"]["rank"] == 1 and out["forest"].rmse < 1.2 < out["linear"].rmse
