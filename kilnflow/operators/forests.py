"""Random forests of tables with many rows in few cells.

Spark's forest passes over all rows for every level of its trees, and keeps a
weight per row and tree. A tree sees no more of a row than its bin of each
feature, so rows in the same bins, a cell, can be added up first: per tree the
bootstrap weight of a cell's rows and their weighted mean target, drawn in one
pass over distinct rows. Spark's learner then grows each tree from its cells,
and finds the splits that it would find from the rows, whose deviations within
a cell no split changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import prod
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kilnflow.sources.shared import cut, new_path

#: Bins of a feature at most, as Spark's learner has by default.
BINS = 32
#: Cells are used for tables of at least this many rows, twice as many as cells, and for at most so many cells, which a tree's task reads.
LEAST_ROWS, MOST_CELLS = 500_000, 1 << 17
#: Distinct targets of a cell that one task draws weights for.
SLICE = 1 << 16
#: Trees that are grown at a time.
AT_ONCE = 8


@dataclass(frozen=True)
class Bins:
    """The limits between the bins of each feature, ascending; a value equal to a limit is above it."""

    features: tuple[str, ...]
    limits: tuple[tuple[float, ...], ...]

    def sizes(self) -> list[int]:
        return [len(t) + 1 for t in self.limits]

    def steps(self) -> list[int]:
        return [prod(self.sizes()[:i]) for i in range(len(self.limits))]

    def place(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_cell``, the number of a row's cell; a null or NaN feature is an error."""
        numbers, codes = ([f"_{kind}{i}" for i in range(len(self.features))] for kind in ("number", "code"))
        doubles = {n: F.coalesce(F.col(f"`{f}`").cast("double"), F.raise_error(F.lit(f"null in {f}")).cast("double")) for n, f in zip(numbers, self.features)}
        splits = [[float("-inf"), *limits, float("inf")] for limits in self.limits]
        coded = Bucketizer(splitsArray=splits, inputCols=numbers, outputCols=codes).transform(df.withColumns(doubles))
        return coded.withColumn("_cell", sum(F.col(c).cast("long") * step for c, step in zip(codes, self.steps()))).drop(*numbers, *codes)

    def vector(self) -> Column:
        """The bins of a ``_cell``, which may have more in its higher digits."""
        return array_to_vector(F.array(*[F.expr(f"CAST(_cell div {step} % {size} AS DOUBLE)") for step, size in zip(self.steps(), self.sizes())]))


@dataclass(frozen=True)
class CellForest:
    """A forest of Spark's over the bins of features; each cell is scored once."""

    forest: object
    bins: Bins

    @property
    def featureImportances(self):  # noqa: N802, as Spark's models have it
        return self.forest.featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        placed = self.bins.place(df)
        scored = self.forest.transform(placed.select("_cell").distinct().select("_cell", self.bins.vector().alias("_bins")))
        return placed.join(scored.drop("_bins"), "_cell").drop("_cell")


def fit(df: DataFrame, estimator, features: list[str], target: str, classes: bool):
    """A fitted CellForest of ``estimator``, a forest of Spark's with ``bootstrap``; None where rows lie in too many cells, there are few, or some can't be counted (null, NaN, infinite; a class that is no whole number from 0, or the only one)."""
    y = F.col(f"`{target}`").cast("double")
    numbers = [F.col(f"`{f}`").cast("double") for f in features]
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    usable = finite(y) & ((y >= 0) & (y == F.floor(y)) if classes else F.lit(True))
    for x in numbers:
        usable = usable & finite(x)
    seen = df.agg(F.count("*").alias("n"), F.count_if(~usable).alias("unusable"), F.max(y).alias("top"), *[F.approx_count_distinct(x).alias(f"d{i}") for i, x in enumerate(numbers)]).first()
    if seen.n < LEAST_ROWS or seen.unusable:
        return None
    named = df.select(*[x.alias(f"x{i}") for i, x in enumerate(numbers)], y.alias("y"))
    bins = Bins(tuple(f"x{i}" for i in range(len(features))), _limits(named, [seen[f"d{i}"] for i in range(len(features))]))
    labels = int(seen.top) + 1 if classes else 1
    places = prod(bins.sizes())
    if classes and labels < 2 or places * labels >= 1 << 62:
        return None
    cells = bins.place(named).select((F.col("_cell") + F.col("y").cast("long") * places if classes else F.col("_cell")).alias("_cell"), "y")
    counted = cut(cells.groupBy("_cell", "y").agg(F.count("*").alias("n")), "cells")
    if counted.select("_cell").distinct().count() > min(MOST_CELLS, seen.n // 2):
        return None
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    path = _bags(counted, trees, seed)
    label = F.col("y").alias("y", metadata={"ml_attr": {"type": "nominal", "num_vals": labels}} if classes else {})
    single = estimator.copy({estimator.numTrees: 1, estimator.bootstrap: False, estimator.featuresCol: "_bins", estimator.labelCol: "y", estimator.weightCol: "w"})
    spark = df.sparkSession

    def grow(tree: int):
        bag = spark.read.schema("_cell long, w double, y double").parquet(f"{path}/tree={tree}")
        return single.copy({single.seed: seed + tree}).fit(bag.select(bins.vector().alias("_bins"), "w", label)).trees[0]

    each = [inheritable_thread_target(spark)(partial(grow, tree)) for tree in range(trees)]  # each with local properties of its own
    with ThreadPool(AT_ONCE) as pool:
        grown = pool.map(lambda f: f(), each, chunksize=1)
    return CellForest(_joined(spark, estimator.copy({estimator.featuresCol: "_bins"}), grown, len(features), labels if classes else None), Bins(tuple(features), bins.limits))


def _limits(df: DataFrame, distinct: list[int]) -> tuple[tuple[float, ...], ...]:
    """At most BINS - 1 limits a feature: midway between its values where there are so few, else among quantiles in steps of 1 / (4 BINS), within a thousandth of the rows."""
    few = [f"x{i}" for i, d in enumerate(distinct) if d <= 2 * BINS]
    values = df.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict() if few else {}
    limits = {c: sorted({a / 2 + b / 2 for a, b in zip(sorted(v), sorted(v)[1:])}) or [v[0]] for c, v in values.items() if len(v) <= BINS}
    many = [f"x{i}" for i in range(len(distinct)) if f"x{i}" not in limits]
    probes = [i / (4 * BINS) for i in range(1, 4 * BINS)]
    for c, found in zip(many, df.approxQuantile(many, probes, 0.001) if many else []):
        found = sorted(set(found))
        limits[c] = found if len(found) < BINS else [found[round(i * (len(found) - 1) / (BINS - 2))] for i in range(BINS - 1)]
    return tuple(tuple(limits[f"x{i}"]) for i in range(len(distinct)))


def _bags(counted: DataFrame, trees: int, seed: int) -> str:
    """Write (_cell, w, y) by tree from the counts n of distinct (_cell, y): the sum of the Poisson(1) weights of a cell's rows in that tree's bootstrap, and their weighted mean target.

    Of n equal rows the weights are drawn at once, from Poisson(n), as n draws from Poisson(1) add up.
    Draws depend on the seed, the cell and its targets alone. Targets of a cell with many are dealt by hash.
    """
    slices = counted.groupBy("_cell").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    dealt = counted.join(slices, "_cell").select("_cell", F.pmod(F.xxhash64("y"), "slices").alias("slice"), "y", "n")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, rng = None, None
        for b in batches:
            cell, slice_, y, n = (b.column(i).to_numpy() for i in range(4))
            if not len(cell):
                continue
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (slice_[1:] != slice_[:-1])])
            w, s = np.empty((len(starts), trees)), np.empty((len(starts), trees))
            for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(cell)])):
                if (cell[i], slice_[i]) != run:
                    run = (cell[i], slice_[i])
                    rng = np.random.default_rng([seed & (1 << 64) - 1, *map(int, run)])
                weights = rng.poisson(n[i:j, None], (j - i, trees)).astype(np.float64)
                w[k], s[k] = weights.sum(0), y[i:j] @ weights
            at, tree = np.nonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(cell[starts][at]), pa.array(w[at, tree]), pa.array(s[at, tree])], ["tree", "_cell", "w", "s"])

    sorted_ = dealt.repartition("_cell", "slice").sortWithinPartitions("_cell", "slice", "y")
    drawn = sorted_.mapInArrow(draw, "tree long, _cell long, w double, s double").repartition("tree")
    bags = drawn.groupBy("tree", "_cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).select("tree", "_cell", "w", (F.col("s") / F.col("w")).alias("y"))
    path = new_path(counted.sparkSession, "bags")
    bags.write.partitionBy("tree").parquet(path)
    return path


def _joined(spark: SparkSession, estimator, grown: list, features: int, labels: int | None):
    """One model of Spark's from single trees."""
    package = spark._jvm.org.apache.spark.ml.regression if labels is None else spark._jvm.org.apache.spark.ml.classification
    tree, forest = (package.DecisionTreeRegressionModel, package.RandomForestRegressionModel) if labels is None else (package.DecisionTreeClassificationModel, package.RandomForestClassificationModel)
    array = spark.sparkContext._gateway.new_array(tree, len(grown))
    for i, t in enumerate(grown):
        array[i] = t._java_obj
    sizes = [features] if labels is None else [features, labels]
    return estimator._copyValues(estimator._create_model(forest(estimator.uid, array, *sizes)))
