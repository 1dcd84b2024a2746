"""Residual association of single events against ranking the whole table anew for each of them."""

import numpy as np
import pandas as pd

from kilnflow.operators import diagnose

FEATURES = ["a", "b", "flat"]


def table(n=60):
    r = np.random.default_rng(3)
    t = pd.DataFrame({"i": np.arange(n), "a": r.integers(0, 8, n).astype(float), "b": r.normal(size=n), "flat": 2.0})
    t["res"] = np.round(0.5 * t.a + r.normal(size=n), 3)
    t["s"] = (t.res - t.res.median()).abs().round(1)  # ties among the scores
    t["f"] = t.s > 1.4
    return t


def by_hand(t, events, top=10):
    out = {}
    for i in t[t.f].sort_values(["s", "i"], ascending=[False, True]).head(events).i:
        rows = []
        for place, c in enumerate(FEATURES):
            own = t[t[c].notna()]
            v = own.loc[own.i == i, c]
            if v.empty:
                continue
            rank = own[[c, "res", "s"]].rank()
            rho = [0.0 if own[c].nunique() == 1 else float(np.corrcoef(rank[c], rank[k])[0, 1]) for k in ("res", "s")]
            ref = own.loc[~own.f, c]
            m = ref.median()
            z = abs(v.iloc[0] - m) / max(1.4826 * (ref - m).abs().median(), 1e-12)
            raw = min(1.0, 0.45 * abs(rho[1]) + 0.35 * z / (z + 1) + 0.2 * (z >= 3.5))
            way = "positive" if rho[0] > 1e-12 else "negative" if rho[0] < -1e-12 else "unknown"
            if raw:
                rows.append((c, place, v.iloc[0] - m, abs(rho[1]), z >= 3.5, raw, way))
        rows.sort(key=lambda x: (-x[5], -x[3], -int(x[4]), x[1]))
        for k, x in enumerate(rows[:top]):
            out[i, x[0]] = (k + 1, x[5] / rows[0][5], x[2], x[5], x[6])
    return out


def check(spark, t, events=7, top=10):
    cells = [(int(i), *[None if np.isnan(x) else float(x) for x in (a, b, flat, res, s)], bool(f)) for i, a, b, flat, res, s, f in t.itertuples(index=False)]
    df = spark.createDataFrame(cells, "i long, a double, b double, flat double, res double, s double, f boolean")
    got = diagnose.associate_events(df, FEATURES, "f", "res", "s", "i", events=events, top=top)
    rows = {(r.event_id, r.feature): r for r in got.collect()}
    want = by_hand(t, events, top)
    assert set(rows) == set(want)
    for k, (rank, norm, diff, raw, way) in want.items():
        r = rows[k]
        assert (r["rank"], r.direction) == (rank, way)
        assert np.allclose((r.normalized_score, r.difference, r.raw_score, r.confidence), (norm, diff, raw, raw), atol=1e-9)
    return got, rows


def test_equals_ranking_anew(spark):
    t = table()
    got, rows = check(spark, t)
    assert len({k[0] for k in rows}) == 7 and not any(k[1] == "flat" for k in rows)
    one = {r.feature: r for r in diagnose.aggregate_events(got, "residual").collect()}
    a = [r for k, r in rows.items() if k[1] == "a"]
    assert one["a"].occurrences == 7 and np.isclose(one["a"].mean_score, np.mean([r.normalized_score for r in a])) and one["a"].direction == "positive"


def test_nulls_and_no_events(spark):
    t = table()
    t.loc[t[t.f].sort_values(["s", "i"], ascending=[False, True]).index[0], "b"] = np.nan
    t.loc[3, "a"] = np.nan
    check(spark, t, events=3, top=1)
    t.f = False
    got, rows = check(spark, t)
    assert not rows and diagnose.aggregate_events(got, "residual").count() == 0
