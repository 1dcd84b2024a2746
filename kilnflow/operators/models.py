"""Models: what Spark ML has, and detectors fitted and applied at once."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from kilnflow.operators import forests
from kilnflow.operators.prepare import PARTITION
from kilnflow.sources.shared import cut


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def linear(df: DataFrame, features: list[str], target: str):
    """Least squares of train rows, solved by normal equations."""
    return LinearRegression(featuresCol="features", labelCol=target, solver="normal", regParam=0.0).fit(assemble(df, features))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0):
    """Ridge with the penalty alpha on plain coefficients. Spark divides by n and scales by the target's deviation, so both are put back."""
    row = df.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("s")).first()
    return LinearRegression(featuresCol="features", labelCol=target, solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * row.s / row.n).fit(assemble(df, features))


def forest_regressor(df: DataFrame, features: list[str], target: str, trees: int = 100, depth: int = 12, seed: int = 42):
    """Rows are added up by cell where they lie in few, see forests.py; else Spark's forest passes over the rows."""
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
    return forests.fit(df, forest, features, target, classes=False) or forest.fit(assemble(df, features))


def logistic(df: DataFrame, features: list[str], target: str, c: float = 1.0):
    n = df.count()
    return LogisticRegression(featuresCol="features", labelCol=target, regParam=1.0 / (c * n), standardization=False, maxIter=1000).fit(assemble(df, features))


def forest_classifier(df: DataFrame, features: list[str], target: str, trees: int = 100, depth: int = 12, seed: int = 42):
    """As forest_regressor(); each split is among a random square root of the features, as Spark's 'auto' has it."""
    forest = RandomForestClassifier(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt" if trees > 1 else "all", seed=seed)
    return forests.fit(df, forest, features, target, classes=True) or forest.fit(assemble(df, features))


def predict(model, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    return model.transform(assemble(df, features)).withColumn(name, F.col("prediction")).drop("features", "prediction", "rawPrediction", "probability")


def probabilities(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(assemble(df, features)).withColumn("p1", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def screen(df: DataFrame, candidates: dict, features: list[str], target: str) -> DataFrame:
    """Fit each candidate (name: fit function) on train and rank by RMSE, MAE, R2 on validation; one that fails has an error and no rank. The mean is the baseline."""
    from kilnflow.operators.evaluate import regression_metrics

    df = cut(df, "screened")
    train, valid = df.filter(F.col(PARTITION) == "train"), df.filter(F.col(PARTITION) == "validation")
    rows = []
    mean = train.agg(F.avg(target)).first()[0]
    base = regression_metrics(valid.select(F.col(target).alias("y"), F.lit(mean).alias("p"))).first()
    rows.append(("mean", base.rmse, base.mae, base.r2, None))
    for name, fit in candidates.items():
        try:
            m = regression_metrics(predict(fit(train, features, target), valid, features).select(F.col(target).alias("y"), "p")).first()
            rows.append((name, m.rmse, m.mae, m.r2, None))
        except Exception as e:  # a candidate's failure is its result
            rows.append((name, None, None, None, str(e)[:200]))
    out = df.sparkSession.createDataFrame(rows, "model string, rmse double, mae double, r2 double, error string")
    ranked = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2], -(r[3] or 0)))
    places = {r[0]: i + 1 for i, r in enumerate(ranked)}
    place = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])
    return out.withColumn("rank", place[F.col("model")]).withColumn("beats_mean", F.col("rmse") < base.rmse)


def _detected(df: DataFrame, fit, features: list[str], fit_on: str | None, keep: list[str]) -> DataFrame:
    from kilnflow.operators import detectors

    train = df.filter(F.col(PARTITION) == fit_on) if fit_on and PARTITION in df.columns else df
    return detectors.score(fit(train, features), df).filter("_anomaly_score IS NOT NULL").select(*keep, "_anomaly_score", "_is_anomaly", "_anomaly_raw_prediction")


def isolation_forest(df: DataFrame, features: list[str], key: str, trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42, fit_on: str | None = "train") -> DataFrame:
    """The key (and partition) of the rows of ``df`` with all features, scored by a forest of the ``fit_on`` rows; see detectors.fit_forest()."""
    from kilnflow.operators.detectors import fit_forest

    return _detected(df, lambda t, f: fit_forest(t, f, trees, sample, contamination, seed), features, fit_on, [key, *([PARTITION] if PARTITION in df.columns else [])])


def elliptic_envelope(df: DataFrame, features: list[str], contamination: float = 0.05) -> DataFrame:
    """The rows of ``df`` with all features, scored by the robust envelope of train rows (all rows without a partition); see detectors.fit_envelope()."""
    from kilnflow.operators.detectors import fit_envelope

    return _detected(df, lambda t, f: fit_envelope(t, f, contamination), features, "train", df.columns)


def one_class(df: DataFrame, features: list[str], nu: float = 0.05, width: int = 256, seed: int = 42, gamma: float | None = None) -> DataFrame:
    """The rows of ``df`` with all features, scored by a one-class machine of train rows (all rows without a partition); see detectors.fit_one_class()."""
    from kilnflow.operators.detectors import fit_one_class

    return _detected(df, lambda t, f: fit_one_class(t, f, nu, gamma, width, seed), features, "train", df.columns)
