"""Detectors whose fitted state is a table: isolation forest, robust envelope and one-class machine.

``fit_...(train, features)`` gives a Fitted, whose state is a written table of a
size that the table it was fitted on has no part in; ``score(fitted, rows)``
scores any rows, scenarios and streams too. A higher score is odder; rows above
0 are flagged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kilnflow.functions.ordering import exact_quantiles
from kilnflow.sources.shared import cut

STATE = "kind string, features array<string>, name string, part int, place int, numbers array<double>"


class FitError(ValueError):
    """A detector can't be fitted on these rows."""


@dataclass(frozen=True)
class Fitted:
    """A fitted detector: its kind, the features in order and its state."""

    kind: str
    features: tuple[str, ...]
    state: DataFrame

    def write(self, path: str) -> None:
        self.state.write.parquet(path)


def load(spark: SparkSession, path: str) -> Fitted:
    """What Fitted.write() wrote."""
    state = spark.read.parquet(path)
    head = state.select("kind", "features").first()
    return Fitted(head.kind, tuple(head.features), state)


def _numbers(df: DataFrame, features: list[str], *more: str) -> DataFrame:
    """``more`` columns and the features as doubles; rows with a null, NaN or infinite feature are left out."""
    rows = df.select(*more, *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    finite = F.lit(True)
    for i in range(len(features)):
        finite = finite & F.coalesce(F.abs(f"x{i}") < float("inf"), F.lit(False))
    return rows.filter(finite)


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - width, b.num_columns)]).astype(float)


def _width(features: list[str]) -> str:
    return ", ".join(f"x{i} double" for i in range(len(features)))


def _hashed(rows: DataFrame, width: int, seed: int) -> DataFrame:
    return rows.select(F.xxhash64(F.lit(seed), *[f"x{i}" for i in range(width)]).alias("h"), *[f"x{i}" for i in range(width)])


def _state(spark: SparkSession, kind: str, features: list[str], parts: dict[str, np.ndarray], scored: Callable[[Fitted], DataFrame], outliers: float) -> Fitted:
    """The state with ``parts`` (a matrix's rows each) and the threshold, the quantile of the fitted rows' raw scores that leaves ``outliers`` above."""
    rows = [(kind, features, name, 0, i, [float(x) for x in row]) for name, matrix in parts.items() for i, row in enumerate(np.atleast_2d(matrix))]
    return _threshold(Fitted(kind, tuple(features), spark.createDataFrame(rows, STATE)), scored, outliers)


def _threshold(raw: Fitted, scored: Callable[[Fitted], DataFrame], outliers: float) -> Fitted:
    # Computed before it is written, as the state is collected for scoring.
    state = cut(raw.state, "detector")
    t = exact_quantiles(scored(Fitted(raw.kind, raw.features, state)).select(F.lit(0).alias("g"), "_s"), "g", "_s", {"t": 1 - outliers}).first()
    if t is None:
        raise FitError("no row has all features")
    row = state.sparkSession.createDataFrame([(raw.kind, list(raw.features), "threshold", 0, 0, [float(t.t)])], STATE)
    return Fitted(raw.kind, raw.features, cut(state.unionByName(row), "detector"))


def score(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """``rows`` with _anomaly_score, _is_anomaly and _anomaly_raw_prediction (-1 flagged, 1 not).

    All three are null where a feature is null, NaN or infinite. Other columns
    stay; only features go to Python. Streams work as well.
    """
    parts = _collected(fitted)
    raw = _raw(fitted, rows, parts)
    threshold = float(parts["threshold"][0][0])
    scored = raw.withColumn("_anomaly_score", F.col("_s") - F.lit(threshold)).withColumn("_is_anomaly", F.col("_anomaly_score") > 0)
    return scored.withColumn("_anomaly_raw_prediction", F.when(F.col("_is_anomaly"), F.lit(-1)).when(~F.col("_is_anomaly"), F.lit(1)).cast("long")).drop("_s")


def _collected(fitted: Fitted) -> dict[str, list]:
    """The state's parts, in order; its size is fixed by the detector's parameters and the number of features."""
    parts: dict[str, list] = {}
    for r in fitted.state.orderBy("name", "part", "place").collect():
        parts.setdefault(r.name, []).append(np.array(r.numbers))
    return parts


def _raw(fitted: Fitted, rows: DataFrame, parts: dict[str, list] | None = None) -> DataFrame:
    parts = _collected(fitted) if parts is None else parts
    shared, build, ready = rows.sparkSession.sparkContext.broadcast(parts), _SCORERS[fitted.kind], []

    @F.pandas_udf("double")
    def raw(x: pd.DataFrame) -> pd.Series:
        if not ready:  # once a task
            ready.append(build(shared.value))
        m = x.to_numpy(float)
        ok = np.isfinite(m).all(1)
        out = np.full(len(m), np.nan)
        if ok.any():
            out[ok] = ready[0](m[ok])
        return pd.Series(out)

    s = raw(F.struct(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(fitted.features)]))
    return rows.withColumn("_s", s).withColumn("_s", F.nanvl("_s", F.lit(None).cast("double")))


# --- isolation forest ----------------------------------------------------------


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """A random tree as a list of nodes: (feature, cut, left, right, size); a leaf has feature -1."""
    nodes: list[tuple] = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(rows)))
        lo, hi = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(hi > lo)
        if depth < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            edge = float(rng.uniform(lo[f], hi[f]))
            below = x[rows, f] < edge
            left, right = node(rows[below], depth + 1), node(rows[~below], depth + 1)
            nodes[at] = (f, edge, left, right, len(rows))
        return at

    node(np.arange(len(x)), 0)
    return nodes


def fit_forest(train: DataFrame, features: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42) -> Fitted:
    """An isolation forest. Each tree grows in a task of its own from ``sample`` rows, those with the least hash for that tree.

    All rows compete for all trees at once, through top-k lists that are cut
    down within each partition, then within 64 groups, then for each tree.
    Rows with equal features have equal hashes, so of very frequent ones a tree
    takes as many as there are. State: a row per tree and node field.
    """
    spark, p = train.sparkSession, len(features)
    rows = _numbers(train, features)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty((0, p)))] * trees
        for b in batches:
            x, h = _matrix(b, p), b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for t in range(trees):
                mixed = (h ^ np.uint64(t * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                u = (mixed * np.uint64(0xBF58476D1CE4E5B9)).astype(np.float64)
                xs = x
                if len(u) > sample:
                    low = np.argpartition(u, sample)[:sample]
                    u, xs = u[low], x[low]
                u, xs = np.concatenate([best[t][0], u]), np.concatenate([best[t][1], xs])
                order = np.argsort(u, kind="stable")[:sample]
                best[t] = (u[order], xs[order])
        for t, (u, x) in enumerate(best):
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t)), pa.array(u), *[pa.array(x[:, i]) for i in range(p)]], ["tree", "u", *[f"x{i}" for i in range(p)]])

    least = lambda table: table.sort_by([("u", "ascending"), *[(f"x{i}", "ascending") for i in range(p)]]).slice(0, sample)

    def fewer(k: tuple, table: pa.Table) -> pa.Table:
        return least(table).drop(["part"])

    def grow(t: tuple, table: pa.Table) -> pa.Table:
        table = least(table)
        x = np.column_stack([table.column(f"x{i}").to_numpy() for i in range(p)])
        fields = list(zip(*_grow(x, np.random.default_rng([seed, t[0].as_py()]), int(np.ceil(np.log2(max(2, sample)))))))
        tree = pa.array([t[0].as_py()] * 5, pa.int32())
        return pa.table({"kind": ["forest"] * 5, "features": pa.array([features] * 5, pa.list_(pa.string())), "name": ["nodes"] * 5, "part": tree, "place": pa.array(range(5), pa.int32()), "numbers": pa.array([list(map(float, c)) for c in fields], pa.list_(pa.float64()))})

    # The place of a row in a partition isn't part of its hash, so that the forest doesn't depend on partitioning.
    pools = _hashed(rows, p, seed).mapInArrow(keep, "tree long, u double, " + _width(features))
    pools = pools.withColumn("part", F.spark_partition_id() % 64).groupBy("tree", "part").applyInArrow(fewer, "tree long, u double, " + _width(features))
    forest = pools.groupBy("tree").applyInArrow(grow, STATE)
    size = spark.createDataFrame([("forest", features, "sample", 0, 0, [float(sample)])], STATE)
    return _threshold(Fitted("forest", tuple(features), forest.unionByName(size)), lambda f: _raw(f, rows.withColumnsRenamed({f"x{i}": c for i, c in enumerate(features)})), contamination)


def _forest(parts: dict[str, list]) -> Callable[[np.ndarray], np.ndarray]:
    nodes = parts.get("nodes", [])
    trees = [(f.astype(int), edges, left.astype(int), right.astype(int), n) for f, edges, left, right, n in zip(*[iter(nodes)] * 5)]
    size = min(float(parts["sample"][0][0]), max((t[4][0] for t in trees), default=2.0))

    def scores(x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for f, edges, left, right, n in trees:
            at, d = np.zeros(len(x), int), np.zeros(len(x))
            while (live := f[at] >= 0).any():
                rows = np.flatnonzero(live)
                node = at[rows]
                at[rows] = np.where(x[rows, f[node]] < edges[node], left[node], right[node])
                d[rows] += 1
            depth += d + _average_path(n[at])
        return 2.0 ** (-depth / max(1, len(trees)) / float(max(_average_path(size), 1e-9)))

    return scores


# --- robust envelope -------------------------------------------------------------


def chi2_quantile(q: float, k: int) -> float:
    """The q-quantile of the chi-square distribution with k degrees of freedom, by bisection of the series of its distribution."""

    def below(x: float) -> float:
        term = total = 1.0 / (k / 2)
        for i in range(1, 10_000):
            term *= (x / 2) / (k / 2 + i)
            total += term
            if term < total * 1e-17:
                break
        return total * exp(k / 2 * log(x / 2) - x / 2 - lgamma(k / 2))

    lo, hi = 1e-12, k + 40 * k**0.5 + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < q else (lo, mid)
    return (lo + hi) / 2


def _inverse(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Pseudo-inverse and log-determinant of a covariance; a flat one has the lowest."""
    sign, size = np.linalg.slogdet(cov)
    return np.linalg.pinv(cov, hermitian=True), float(size) if sign > 0 else -np.inf


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(0)
    return mean, (x - mean).T @ (x - mean) / len(x)


def _distances(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, inverse, d)


def _starts(x: np.ndarray, share: float, starts: int, rng: np.random.Generator, best: int = 10) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, covariance) from many starts on a sample, least determinant first: two steps each from p + 1 rows, then to the end for the ``best``."""
    n, p = x.shape
    h = min(n, max(p + 1, int(np.ceil(share * n))))

    def step(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(x, mean, _inverse(cov)[0])
        return _moments(x[np.argpartition(d, h - 1)[:h]])

    tried = []
    for _ in range(starts):
        now = _moments(x[rng.choice(n, min(n, p + 1), replace=False)])
        for _ in range(2):
            now = step(*now)
        tried.append((_inverse(now[1])[1], len(tried), now))
    ended = []
    for _, i, now in sorted(tried, key=lambda t: t[:2])[:best]:
        size = np.inf
        for _ in range(100):
            now = step(*now)
            before, size = size, _inverse(now[1])[1]
            if not size < before - 1e-12:
                break
        ended.append((size, i, now))
    return [now for _, _, now in sorted(ended, key=lambda t: t[:2])]


def _sums(rows: DataFrame, p: int, many: list[tuple[np.ndarray, np.ndarray, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of the rows within a distance of each (mean, inverse, distance): one aggregation for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(many), 1 + p + p * p))
        for b in batches:
            x = _matrix(b, p)
            for s, (mean, inverse, limit) in enumerate(many):
                y = x[_distances(x, mean, inverse) <= limit] - many[0][0]
                held[s] += np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        for s, sums in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), s)), pa.array(np.arange(len(sums))), pa.array(sums)], ["s", "i", "v"])

    # As many numbers as starts times squared features come to the driver.
    got = np.zeros((len(many), 1 + p + p * p))
    for r in rows.mapInArrow(run, "s long, i long, v double").groupBy("s", "i").agg(F.sum("v").alias("v")).collect():
        got[r.s, r.i] = r.v
    out = []
    for sums in got:
        mean = sums[1 : 1 + p] / max(sums[0], 1)
        out.append((mean + many[0][0], sums[1 + p :].reshape(p, p) / max(sums[0], 1) - np.outer(mean, mean)))
    return out


def _reach(rows: DataFrame, p: int, many: list[tuple[np.ndarray, np.ndarray]], q: float) -> list[float]:
    """For each (mean, inverse) the quantile of the rows' squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, p)
            for s, (mean, inverse) in enumerate(many):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s)), pa.array(_distances(x, mean, inverse))], ["s", "d"])

    found = {r.s: r.q for r in exact_quantiles(rows.mapInArrow(run, "s long, d double"), "s", "d", {"q": q}).collect()}
    return [found[s] for s in range(len(many))]


def fit_envelope(train: DataFrame, features: list[str], contamination: float = 0.05, seed: int = 42, sample: int = 2000, starts: int = 500, best: int = 3, steps: int = 20) -> Fitted:
    """Mean and covariance of the half of the rows with the least determinant (FastMCD), consistency-corrected and reweighted.

    ``starts`` random starts run on a sample of at most ``sample`` rows, the
    least hashes; the ``best`` of them go on over all rows, all at once: a step
    takes the quantile of their distances and one aggregation of moments within
    it, until no determinant falls. State: mean and inverse covariance.
    """
    spark, p = train.sparkSession, len(features)
    rows = cut(_numbers(train, features), "envelope")
    n = rows.count()
    if n < p + 2:
        raise FitError(f"{n} rows are too few for {p} features")
    x = np.array([tuple(r)[1:] for r in _hashed(rows, p, seed).orderBy("h", *[f"x{i}" for i in range(p)]).limit(sample).collect()])
    centre, spread = np.median(x, 0), np.maximum(x.std(0), 1e-300)
    share = (n + p + 1) / (2 * n)
    unit = rows.select(*[((F.col(f"x{i}") - float(centre[i])) / float(spread[i])).alias(f"x{i}") for i in range(p)])
    now = _starts((x - centre) / spread, share, starts, np.random.default_rng(seed))[:best]
    if n > len(x):
        sizes = [np.inf] * len(now)
        for _ in range(steps):
            many = [(mean, _inverse(cov)[0]) for mean, cov in now]
            now = _sums(unit, p, [(*m, r) for m, r in zip(many, _reach(unit, p, many, (np.ceil(share * n) - 1) / (n - 1)))])
            before, sizes = sizes, [_inverse(cov)[1] for _, cov in now]
            if not any(b < a - 1e-9 for a, b in zip(before, sizes)):
                break
        now = [now[int(np.argmin(sizes))]]
    mean, cov = now[0]
    # A normal sample's median distance corrects the covariance, and the rows within 97.5 % of it give the final one.
    cov = cov * _reach(unit, p, [(mean, _inverse(cov)[0])], 0.5)[0] / chi2_quantile(0.5, p)
    mean, cov = _sums(unit, p, [(mean, _inverse(cov)[0], chi2_quantile(0.975, p))])[0]
    inverse = _inverse(cov)[0] / np.outer(spread, spread)
    parts = {"mean": mean * spread + centre, "inverse": inverse}
    return _state(spark, "envelope", features, parts, lambda f: _raw(f, rows.withColumnsRenamed({f"x{i}": c for i, c in enumerate(features)})), contamination)


def _envelope(parts: dict[str, list]) -> Callable[[np.ndarray], np.ndarray]:
    mean, inverse = parts["mean"][0], np.array(parts["inverse"])
    return lambda x: _distances(x, mean, inverse)


# --- one-class machine -------------------------------------------------------------


def fit_one_class(train: DataFrame, features: list[str], nu: float = 0.05, gamma: float | None = None, width: int = 256, seed: int = 42, sample: int = 2000, passes: int = 6) -> Fitted:
    """A one-class machine with an RBF kernel, in ``width`` pairs of random Fourier features.

    Its dual seeks the shortest mean of kernel features in which no row weighs
    over 1 / (nu n). Each step of conditional gradient moves toward the mean of
    the nu n rows that lie lowest, by exact line search. Steps run to the end
    on a sample of at most ``sample`` rows (the least hashes), then ``passes``
    times over all rows, an aggregation each, in which rows are binned by their
    place. The offset is the exact nu-quantile of all fitted rows. gamma: 1 /
    (features * variance of all their values), unless given. State: the random
    directions, the weights and the offset.
    """
    spark, p = train.sparkSession, len(features)
    rows = cut(_numbers(train, features), "one-class")
    sums = rows.agg(F.count("*").alias("n"), *[f(F.col(f"x{i}")).alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    n = sums.n
    if n < 2:
        raise FitError(f"{n} rows are too few")
    means = np.array([sums[f"m{i}"] for i in range(p)])
    variance = float(np.mean([sums[f"v{i}"] + means[i] ** 2 for i in range(p)]) - means.mean() ** 2)
    gamma = gamma or 1.0 / (p * variance if variance > 0 else 1.0)
    directions = np.random.default_rng(seed).standard_normal((width, p)) * (2 * gamma) ** 0.5
    waves = lambda x: _waves(x, means, directions)
    z = waves(np.array([tuple(r)[1:] for r in _hashed(rows, p, seed).orderBy("h", *[f"x{i}" for i in range(p)]).limit(sample).collect()]))
    w, take = z.mean(0), max(1.0, nu * len(z))
    for _ in range(400):
        order = np.argsort(z @ w, kind="stable")
        weight = np.clip(take - np.arange(len(z)), 0, 1)[: int(np.ceil(take))]
        w, gain = _toward(w, weight @ z[order[: len(weight)]] / weight.sum())
        if gain < 1e-9:
            break
    for _ in range(passes if n > len(z) else 0):
        w, gain = _toward(w, _lowest(rows, p, waves, w, nu * n))
        if gain < 1e-9:
            break
    parts = {"means": means, "directions": directions, "weights": w}
    return _state(spark, "one_class", features, parts, lambda f: _raw(f, rows.withColumnsRenamed({f"x{i}": c for i, c in enumerate(features)})), nu)


def _waves(x: np.ndarray, means: np.ndarray, directions: np.ndarray) -> np.ndarray:
    a = (x - means) @ directions.T
    return np.hstack([np.cos(a), np.sin(a)]) / len(directions) ** 0.5


def _toward(w: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, float]:
    """The shortest point between ``w`` and ``low``, and how much shorter its square is."""
    d = w - low
    size = float(d @ d)
    t = min(1.0, max(0.0, float(w @ d) / size)) if size > 0 else 0.0
    new = w - t * d
    return new, float(w @ w - new @ new)


def _lowest(rows: DataFrame, p: int, waves: Callable, w: np.ndarray, take: float, bins: int = 64) -> np.ndarray:
    """The mean of the kernel features of about the ``take`` rows that lie lowest along ``w``; the last bin counts in part."""
    reach = float(np.linalg.norm(w)) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((bins, 1 + len(w)))
        for b in batches:
            z = waves(_matrix(b, p))
            at = np.clip(((z @ w / reach + 1) / 2 * bins).astype(int), 0, bins - 1)
            for k in np.unique(at):
                inside = z[at == k]
                held[k] += np.concatenate([[len(inside)], inside.sum(0)])
        for k in np.flatnonzero(held[:, 0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w) + 1, k)), pa.array(np.arange(len(w) + 1)), pa.array(held[k])], ["k", "i", "v"])

    held = np.zeros((bins, 1 + len(w)))
    for r in rows.mapInArrow(run, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():  # bins times kernel features
        held[r.k, r.i] = r.v
    counts = held[:, 0]
    part = np.clip((take - (np.cumsum(counts) - counts)) / np.maximum(counts, 1), 0, 1)
    return part @ held[:, 1:] / max(part @ counts, 1e-300)


def _one_class(parts: dict[str, list]) -> Callable[[np.ndarray], np.ndarray]:
    means, directions, w = parts["means"][0], np.array(parts["directions"]), parts["weights"][0]
    return lambda x: -(_waves(x, means, directions) @ w)


_SCORERS = {"forest": _forest, "envelope": _envelope, "one_class": _one_class}
#: What screening tries, in order.
FITS: dict[str, Callable[[DataFrame, list[str]], Fitted]] = {"isolation_forest": fit_forest, "one_class": fit_one_class, "elliptic_envelope": fit_envelope}
