"""Quantiles by radix selection against sorted values, in one pass and in many."""

import numpy as np
import pytest

from kilnflow.functions import ordering

PLACES = {"m": 0.5, "q": 0.99, "z": 0.0, "o": 1.0, "t": 0.3}


def groups():
    rng = np.random.default_rng(1)
    return {
        "even": rng.normal(size=1001), "equal": np.repeat(3.0, 7), "steep": np.exp(rng.normal(size=300) * 100), "one": np.array([1.0]), "negative": -np.exp(rng.normal(size=64) * 20),
        "endless": np.array([float("-inf"), 1.0, 2.0, float("inf")]), None: rng.integers(0, 5, 300).astype(float), "tiny": rng.normal(size=50) * 1e-30, "next": np.array([1.0, 2.0, np.nextafter(2.0, 3.0), 4.0]), "nan": np.array([1.0, 2.0, float("nan"), 3.0]),
    }


def plain(x, q, method):
    x = np.sort(x)
    at = (len(x) - 1) * q
    if method == "nearest":
        return x[int(np.floor(at + 0.5))]
    lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
    with np.errstate(invalid="ignore"):
        return lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))


@pytest.mark.parametrize("method", ["linear", "nearest"])
@pytest.mark.parametrize(("few", "bins"), [(1 << 14, 1 << 14), (20, 1 << 10)])
def test_quantiles_of_odd_groups(spark, monkeypatch, method, few, bins):
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "BINS", bins)
    values = groups()
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("even", None), ("none", None)], "g string, v double")
    rows = ordering.exact_quantiles(df, "g", "v", PLACES, method).collect()
    assert {r.g for r in rows} == set(values)
    for r in rows:
        for name, q in PLACES.items():
            want = plain(values[r.g], q, method)
            assert r[name] == want or want != want and r[name] != r[name] or r[name] == pytest.approx(want, rel=1e-12), (r.g, name)


def test_no_row_is_moved(spark):
    df = spark.range(100_000).selectExpr("id % 3 AS g", "cast(hash(id) as double) AS v")
    out = ordering.exact_quantiles(df, "g", "v", {"m": 0.5})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and out.count() == 3
