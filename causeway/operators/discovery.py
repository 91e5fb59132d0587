"""Causal discovery on lagged series: condition selection, then momentary conditional independence by partial correlation.

All tests of a unit are sub-matrix inversions of one lagged correlation matrix, which is added up in one distributed pass. Tests
are dealt out by unit and target, so a task has the matrix of one unit and some of its targets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.moments import lagged_correlations
from causeway.operators.selection import settled

#: Groups that the targets of a unit are dealt to at most; each gets the unit's correlations once.
SHARES = 32

Place = tuple[int, int]  # (lag, variable): x_variable(t - lag)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * out)


def p_value(r: float, n: int, given: int) -> float:
    """Two-sided, of a partial correlation with `given` conditions over n steps, by Student's t with n - 2 - given degrees of freedom."""
    df = n - 2 - given
    if df < 1:
        return 1.0
    return incomplete_beta(df / 2, 0.5, 1 - min(r * r, 1.0))


class Lagged:
    """The correlations of one unit: entries depend on the difference of lags alone, as for a stationary series."""

    def __init__(self, rows: pd.DataFrame, deepest: int):
        self.variables = sorted(set(rows["j"]))
        at = {v: k for k, v in enumerate(self.variables)}
        d = len(at)
        self.r, self.n = np.zeros((deepest + 1, d, d)), np.zeros((deepest + 1, d, d), np.int64)
        lag, i, j = rows["lag"].to_numpy(), rows["i"].map(at).to_numpy(), rows["j"].map(at).to_numpy()
        self.r[lag, i, j], self.n[lag, i, j] = rows["r"].fillna(0.0).to_numpy(), rows["n"].to_numpy()

    def matrix(self, places: list[Place]) -> np.ndarray:
        lag, v = np.array(places).T
        apart = lag[:, None] - lag[None, :]
        forward = self.r[np.maximum(apart, 0), v[:, None], v[None, :]]
        back = self.r[np.maximum(-apart, 0), v[None, :], v[:, None]]
        out = np.where(apart >= 0, forward, back)
        np.fill_diagonal(out, 1.0)
        return out

    def test(self, source: Place, target: int, given: list[Place]) -> tuple[float, float]:
        """Partial correlation of the source and the target now, and its p value; the steps are those of the pair at its lag."""
        p = np.linalg.pinv(self.matrix([source, (0, target), *given]), hermitian=True)
        r = float(-p[0, 1] / math.sqrt(max(p[0, 0] * p[1, 1], 1e-300)))
        r = max(-1.0, min(1.0, r))
        return r, p_value(r, int(self.n[source[0], source[1], target]), len(given))

    def parents(self, target: int, max_lag: int, alpha: float) -> list[tuple[Place, float]]:
        """Condition selection: a candidate goes when it is independent given the strongest others, one more of them each round."""
        least = {(lag, i): math.inf for lag in range(1, max_lag + 1) for i in range(len(self.variables))}
        order, size = sorted(least), 0
        while size < len(order):
            gone = set()
            for p in order:
                r, level = self.test(p, target, [q for q in order if q != p][:size])
                least[p] = min(least[p], abs(r))
                if level > alpha:
                    gone.add(p)
            order = sorted((p for p in order if p not in gone), key=lambda p: (-least[p], p))
            size += 1
        return [(p, least[p]) for p in order]


def pcmci(series: DataFrame, max_lag: int = 3, alpha: float = 0.05, final: float = 0.01, shares: int = SHARES) -> DataFrame:
    """(unit, src, dst, w, lag): an edge where some lag from 1 on stays dependent, w the largest |partial correlation| and its lag."""
    kept = links(series, max_lag, alpha, final, shares).where(F.col("kept") & (F.col("src") != F.col("dst")))
    return kept.groupBy("unit", "src", "dst").agg(F.max("w").alias("w"), F.max_by("lag", F.struct("w", -F.col("lag"))).alias("lag"))


def links(series: DataFrame, max_lag: int = 3, alpha: float = 0.05, final: float = 0.01, shares: int = SHARES) -> DataFrame:
    """(unit, src, dst, lag, w, p, kept): every link of the lags 1 .. max_lag, its |partial correlation| and level, and whether it stays.

    series: unit, t, var, x. alpha: level of the condition selection; final: level after Benjamini-Hochberg over all links of a
    unit. A partial correlation is tested by Student's t with the steps that its pair has at its lag. Constant series have no
    links. A task holds the variables squared correlations of one unit.
    """
    deepest = 2 * max_lag
    moments, _ = settled(lagged_correlations(series, deepest))
    unit = dict(series.dtypes)["unit"]
    copies = moments.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        of = Lagged(rows, deepest)
        out = []
        for j in range(len(of.variables)):
            if of.variables[j] % shares == rows["share"].iloc[0]:
                out += [(rows["unit"].iloc[0], of.variables[j], k, lag, of.variables[i]) for k, ((lag, i), _) in enumerate(of.parents(j, max_lag, alpha))]
        return pd.DataFrame(out, columns=["unit", "j", "k", "lag", "i"])

    parents, _ = settled(copies.groupBy("unit", "share").applyInPandas(select, f"unit {unit}, j int, k int, lag int, i int"))
    told = parents.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def tested(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            of = Lagged(rows, deepest)
            at = {v: k for k, v in enumerate(of.variables)}
            parents: dict[int, list[Place]] = {j: [] for j in range(len(of.variables))}
            for p in chosen.sort_values("k").itertuples():
                parents[at[p.j]].append((int(p.lag), at[p.i]))
            for j in range(len(of.variables)):
                if of.variables[j] % shares != rows["share"].iloc[0]:
                    continue
                for lag in range(1, max_lag + 1):
                    for i in range(len(of.variables)):
                        given = [p for p in parents[j] if p != (lag, i)] + [(q + lag, v) for q, v in parents[i]]
                        given = [p for p in dict.fromkeys(given) if p not in ((lag, i), (0, j))]
                        r, level = of.test((lag, i), j, given)
                        out.append((rows["unit"].iloc[0], of.variables[i], of.variables[j], lag, abs(r), level))
        return pd.DataFrame(out, columns=["unit", "src", "dst", "lag", "w", "p"])

    tests = copies.groupBy("unit", "share").cogroup(told.groupBy("unit", "share")).applyInPandas(tested, f"unit {unit}, src int, dst int, lag int, w double, p double")
    # A unit has variables squared times lags tests: that many rows are ordered in one task.
    of_unit = Window.partitionBy("unit")
    ranked = tests.withColumns({"m": F.count("*").over(of_unit), "k": F.row_number().over(of_unit.orderBy("p", "src", "dst", "lag"))})
    cut = ranked.withColumn("most", F.max(F.when(F.col("p") <= F.lit(final) * F.col("k") / F.col("m"), F.col("k"))).over(of_unit))
    return cut.select("unit", "src", "dst", "lag", "w", "p", F.coalesce(F.col("k") <= F.col("most"), F.lit(False)).alias("kept"))
