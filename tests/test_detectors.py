"""Detectors whose state is a table: planted outliers, plain versions, and scoring apart from fitting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnflow.operators import detectors

NAMES = ["a", "b", "c"]


def table(spark, x, **more):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in NAMES[: x.shape[1]]))


@pytest.fixture(scope="module")
def planted(spark):
    x = np.random.default_rng(4).normal(size=(400, 3))
    far = np.random.default_rng(5).normal(size=(20, 3))
    x[:20] = 9 * far / np.linalg.norm(far, axis=1)[:, None]
    return table(spark, x).cache()


@pytest.mark.parametrize("fit", detectors.FITS.values(), ids=detectors.FITS)
def test_planted_outliers_and_scoring_in_halves(spark, planted, fit, tmp_path):
    fitted = fit(planted, NAMES)
    whole = {r.id: r._anomaly_score for r in detectors.score(fitted, planted).collect()}
    assert sum(s > 0 for s in whole.values()) == 20 and sum(s > 0 for i, s in whole.items() if i < 20) >= 15
    halves = [detectors.score(fitted, planted.filter(F.col("id") % 2 == k)) for k in (0, 1)]
    assert {r.id: r._anomaly_score for h in halves for r in h.collect()} == pytest.approx(whole, abs=1e-9)
    fitted.write(str(tmp_path / "state"))
    again = detectors.load(spark, str(tmp_path / "state"))
    assert again.features == tuple(NAMES) and {r.id: r._anomaly_score for r in detectors.score(again, planted.repartition(3)).collect()} == pytest.approx(whole, abs=1e-9)
    assert {r.id: r._anomaly_score for r in detectors.score(fit(planted.repartition(5), NAMES), planted).collect()} == pytest.approx(whole, abs=1e-9)


def test_rows_that_cannot_be_scored(spark, planted):
    fitted = detectors.fit_envelope(planted, NAMES)
    odd = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, float("inf"), 0.0, 0.0), (5, 90.0, 0.0, 0.0)], "id long, a double, b double, c double")
    got = {r.id: (r._is_anomaly, r._anomaly_raw_prediction) for r in detectors.score(fitted, odd).collect()}
    assert got == {1: (False, 1), 2: (None, None), 3: (None, None), 4: (None, None), 5: (True, -1)}
    for fit in detectors.FITS.values():
        with pytest.raises(detectors.FitError):
            fit(planted.limit(0), NAMES)


def test_streams_are_scored_like_tables(spark, planted, tmp_path):
    planted.write.parquet(str(tmp_path / "in"))
    fitted = detectors.fit_forest(planted, NAMES, trees=20)
    stream = detectors.score(fitted, spark.readStream.schema(planted.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("scored_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.id: r._anomaly_score for r in detectors.score(fitted, planted).collect()}
    assert {r.id: r._anomaly_score for r in spark.table("scored_stream").collect()} == want


def plain_mcd(x, h, tries=300):
    best = None
    rng = np.random.default_rng(0)
    for _ in range(tries):
        sub, last = x[rng.choice(len(x), x.shape[1] + 1, replace=False)], np.inf
        for _ in range(60):
            m, c = sub.mean(0), np.cov(sub.T, bias=True)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(c), x - m)
            sub = x[np.argsort(d)[:h]]
            det = np.linalg.det(np.cov(sub.T, bias=True))
            if det >= last - 1e-15:
                break
            last = det
        if best is None or det < best[0]:
            best = (det, sub)
    return best[1]


def test_envelope_equals_a_plain_version(spark):
    rng = np.random.default_rng(7)
    x = rng.multivariate_normal([1, 2, 3], [[2, 1, 0], [1, 3, 0.5], [0, 0.5, 1]], size=500)
    x[:150] = rng.normal([11, -8, 5], 0.8, size=(150, 3))  # 30 % in one cluster
    sub = plain_mcd(x, int(np.ceil((500 + 4) / 2)))
    m, c = sub.mean(0), np.cov(sub.T, bias=True)
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    c = c * np.median(d) / 2.3659738843753377  # the median of chi-square with 3 degrees of freedom
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    inside = x[d <= 9.348403604496145]  # and its 97.5 % quantile
    want = np.einsum("ij,jk,ik->i", x - inside.mean(0), np.linalg.inv(np.cov(inside.T, bias=True)), x - inside.mean(0))
    for sample in (2000, 300):  # all rows in the sample, or steps over the table
        fitted = detectors.fit_envelope(table(spark, x), NAMES, contamination=0.3, sample=sample)
        got = {r.id: r._s for r in detectors._raw(fitted, table(spark, x)).collect()}
        assert np.median(np.abs(np.array([got[i] for i in range(500)]) / want - 1)) < 0.03
        assert {r.id for r in detectors.score(fitted, table(spark, x)).filter("_is_anomaly").collect()} == set(range(150))


def test_chi_square_quantiles():
    for q, k, want in ((0.5, 1, 0.454936423119572), (0.975, 3, 9.348403604496145), (0.5, 10, 9.34181776559197), (0.975, 100, 129.56119718583659)):
        assert detectors.chi2_quantile(q, k) == pytest.approx(want, rel=1e-9)


def test_one_class_tells_a_ring_from_what_it_encloses(spark):
    rng = np.random.default_rng(3)
    angle = rng.uniform(0, 2 * np.pi, 3000)
    ring = np.column_stack([np.cos(angle), np.sin(angle)]) * rng.normal(3, 0.1, 3000)[:, None]
    train = table(spark, ring)
    fitted = detectors.fit_one_class(train, ["a", "b"], nu=0.05, gamma=1.0)
    assert detectors.score(fitted, train).filter("_is_anomaly").count() / 3000 == pytest.approx(0.05, abs=0.01)
    points = table(spark, np.array([[0.0, 0.0], [0.5, -0.5], [3.0, 0.0], [0.0, -3.0], [7.0, 0.0]]))
    assert [r._is_anomaly for r in detectors.score(fitted, points).orderBy("id").collect()] == [True, True, False, False, True]


def test_passes_over_the_table_lower_the_objective(spark):
    x = np.random.default_rng(6).standard_t(3, size=(4000, 2))
    goals = []
    for passes in (0, 6):
        fitted = detectors.fit_one_class(table(spark, x), ["a", "b"], nu=0.1, sample=100, passes=passes)
        parts = detectors._collected(fitted)
        w, offset = parts["weights"][0], -parts["threshold"][0][0]
        short = detectors.score(fitted, table(spark, x)).agg(F.avg(F.greatest(F.lit(0.0), "_anomaly_score"))).first()[0]
        goals.append(w @ w / 2 - offset + short / 0.1)
    assert goals[1] < goals[0]
