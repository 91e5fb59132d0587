"""Simulated units: random graphs, VAR and tanh series, injected episodes. One task per unit, seeded by the unit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of injected anomalies, in the order in which episodes take turns.
KINDS = ("step", "ramp", "spike", "drift", "var")


def random_dag(nodes: int, share: float, rng: np.random.Generator) -> np.ndarray:
    """a[i, j] = 1 for an edge i -> j along a random order."""
    order = rng.permutation(nodes)
    upper = np.triu(rng.random((nodes, nodes)) < share, 1)
    a = np.zeros((nodes, nodes))
    a[np.ix_(order, order)] = upper
    return a


def reachable(a: np.ndarray, start: int) -> list[int]:
    seen, todo = set(), [start]
    while todo:
        for j in np.flatnonzero(a[todo.pop()]).tolist():
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return sorted(seen)


def var_series(a: np.ndarray, steps: int, noise: float, rng: np.random.Generator, max_lag: int = 3) -> np.ndarray:
    """Each edge acts at one random lag with strength 0.4 / lag; every variable keeps a little of its own past."""
    n = len(a)
    lags = rng.integers(1, max_lag + 1, (n, n))
    by_lag = [np.where(lags == k, a * 0.4 / k, 0.0).T for k in range(1, max_lag + 1)]
    x = np.zeros((steps + max_lag, n))
    e = rng.normal(0, noise, x.shape)
    for t in range(max_lag, len(x)):
        x[t] = e[t] + sum(m @ x[t - k - 1] for k, m in enumerate(by_lag))
    return x[max_lag:]


def tanh_series(a: np.ndarray, steps: int, noise: float, rng: np.random.Generator, clamp: dict[int, float] | None = None) -> np.ndarray:
    """x(t) = tanh(W' x(t - 1)) + noise along the edges of a; clamp sets variables to constants at every step (a do-intervention)."""
    w = 0.6 * a / np.maximum(a.sum(0), 1)
    x = np.zeros((steps, len(a)))
    for t in range(1, steps):
        x[t] = np.tanh(x[t - 1] @ w) + 0.5 * x[t - 1] * (a.sum(0) == 0) + rng.normal(0, noise, len(a))
        for k, v in (clamp or {}).items():
            x[t, k] = v
    return x


def scm_units(spark: SparkSession, units: int) -> DataFrame:
    return spark.range(units).select(F.col("id").cast("int").alias("unit"))


def scm_episodes(units: DataFrame, nodes: int = 15, share: float = 0.2, singles: int = 5, joints: int = 2, length: int = 200) -> DataFrame:
    """(unit, ep, t_start, length, kind, roots, propagation) of each unit's graph."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for unit in pdf["unit"]:
                rng = np.random.default_rng([11, int(unit)])
                a = random_dag(nodes, share, rng)
                for ep in range(singles + joints):
                    roots = sorted(rng.choice(nodes, 2 if ep >= singles else 1, replace=False).tolist())
                    down = sorted({d for r in roots for d in reachable(a, r)} - set(roots))
                    rows.append((int(unit), ep, 600 + 550 * ep, length, KINDS[ep % len(KINDS)], roots, down))
            yield pd.DataFrame(rows, columns=["unit", "ep", "t_start", "length", "kind", "roots", "propagation"])

    return units.mapInPandas(run, "unit int, ep int, t_start long, length long, kind string, roots array<int>, propagation array<int>")


def scm_series(spark: SparkSession, units: int, nodes: int = 15, share: float = 0.2, steps: int = 5000, noise: float = 0.5, kind: str = "var") -> DataFrame:
    """observations (unit, t, var, x)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for unit in pdf["unit"]:
                rng = np.random.default_rng([11, int(unit)])
                a = random_dag(nodes, share, rng)
                x = (var_series if kind == "var" else tanh_series)(a, steps, noise, rng)
                t, v = np.indices(x.shape)
                yield pd.DataFrame({"unit": int(unit), "t": t.ravel(), "var": v.ravel().astype("int32"), "x": x.ravel()})

    return scm_units(spark, units).repartition(units).mapInPandas(run, "unit int, t long, var int, x double")


def injected(kind: Column, x: Column, since: Column, length: Column, magnitude: float, scale: Column, noise: Column) -> Column:
    """x with an anomaly added: step, ramp over the episode, spike (five steps at three times the size), slow drift, or variance.

    since: steps since the start of the episode. What is added does not reach other variables."""
    inside = (since >= 0) & (since < length)
    share = since / length
    size = F.lit(magnitude) * scale
    add = (
        F.when(kind == "step", size)
        .when(kind == "ramp", size * share)
        .when(kind == "spike", F.when(since < 5, 3 * size).otherwise(0.0))
        .when(kind == "drift", size * share * share)
        .when(kind == "var", size * noise)
    )
    return F.when(inside, x + add).otherwise(x)


def true_edges(spark: SparkSession, units: int, nodes: int = 15, share: float = 0.2) -> DataFrame:
    """(unit, src, dst) of the graphs that scm_series simulates along."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for unit in pdf["unit"]:
                s, d = np.nonzero(random_dag(nodes, share, np.random.default_rng([11, int(unit)])))
                yield pd.DataFrame({"unit": int(unit), "src": s.astype("int32"), "dst": d.astype("int32")})

    return scm_units(spark, units).mapInPandas(run, "unit int, src int, dst int")


def relational_series(spark: SparkSession, units: int, nodes: int = 8, share: float = 0.4, steps: int = 3000, factor: float = 2.5, length: int = 200) -> DataFrame:
    """(unit, root, t, x, inside): the root's own series of each unit. Inside episodes (from every 500th step on) the strengths of
    the edges into the root are `factor` times theirs. The root is the variable with most parents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for unit in pdf["unit"]:
                rng = np.random.default_rng([12, int(unit)])
                a = random_dag(nodes, share, rng)
                root, plain = int(a.sum(0).argmax()), 0.4 * a.T
                strong = plain.copy()
                strong[root] *= factor
                x = np.zeros((steps, nodes))
                inside = np.arange(steps) % 500 < length
                inside[:500] = False
                for t in range(1, steps):
                    x[t] = (strong if inside[t] else plain) @ x[t - 1] + rng.normal(0, 0.5, nodes)
                yield pd.DataFrame({"unit": int(unit), "root": root, "t": np.arange(steps), "x": x[:, root], "inside": inside})

    return scm_units(spark, units).repartition(units).mapInPandas(run, "unit int, root int, t long, x double, inside boolean")
