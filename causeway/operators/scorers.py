"""Anomaly scorers: fitted on a whole pool, higher is more anomalous; scoring is Arrow.

A fit is a Gram matrix, samples drawn from all windows, or gradients that are summed over all windows in passes. A pool of up to
IN_HAND windows is fetched once and passed over on the driver: the same sums, added up in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from causeway.operators.attribution import batched
from causeway.operators.moments import gram


def stacked(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix; null elements are NaN."""
    sizes = column.value_lengths()
    if column.null_count or pc.min(sizes) != pc.max(sizes):
        raise ValueError("windows have to be arrays of one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


#: Windows that a fit's passes may have on the driver.
IN_HAND = 20_000


#: Bytes of a stack of windows that a pass takes at once: small, so that stacks can be dealt out evenly.
STACK = 1 << 18


class Passes:
    """Sums over all windows of a pool of what a function of a stack of them gives (arrays of one shape). Windows become stacks once,
    dealt out over all cores however few files they lie in; a pass hands on one array a task, and those are added up over the tasks
    before the driver has them."""

    def __init__(self, pool: DataFrame, in_hand: int | None = None):
        in_hand = IN_HAND if in_hand is None else in_hand
        pool = pool.select("values")
        got = pool.limit(in_hand + 1).toArrow()["values"].combine_chunks()
        self.rows = stacked(got) if 0 < len(got) <= in_hand else None
        self.n, self.size = len(got), len(got[0]) if len(got) else 0
        if self.rows is None and self.n:
            cores = pool.sparkSession.sparkContext.defaultParallelism
            self.stacks = pool.mapInArrow(packed, "size int, cells binary").repartition(cores).rdd.map(unpacked)
            self.stacks.persist(StorageLevel.MEMORY_AND_DISK)  # they are passed over many times; what is lost is made again
            self.n = self.stacks.map(len).sum()

    def total(self, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        if self.rows is not None:
            return fn(self.rows)
        return self.stacks.treeAggregate(0.0, lambda out, x: out + fn(x), lambda a, b: a + b)

    def done(self) -> None:
        if self.rows is None and self.n:
            self.stacks.unpersist()


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows as stacks of STACK bytes: the size of a window and the cells of all, one after another."""
    for batch in batches:
        if batch.num_rows:
            x = stacked(batch.column(0)).astype(np.float64, copy=False)
            step = max(1, STACK // max(1, 8 * x.shape[1]))
            for low in range(0, len(x), step):
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([x[low : low + step].tobytes()], pa.binary())], ["size", "cells"])


def unpacked(row: Row) -> np.ndarray:
    return np.frombuffer(row.cells, np.float64).reshape(-1, row.size)


def mixed_bits(ids: np.ndarray, seed: int) -> np.ndarray:
    """64 hashed bits of each id, by multiplying and folding."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def samples(pool: DataFrame, draws: int, size: int, seed: int = 0) -> list[np.ndarray]:
    """`draws` samples of `size` windows each (all, if there are fewer), every one from the whole pool: those with the least hashes
    of (window_id, draw), the same at every run. One pass; what it keeps is a little more than the samples."""
    n = pool.count()
    size = min(size, n)
    if not size:
        return [np.zeros((0, 0))] * draws
    share = (size + 6 * np.sqrt(size) + 20) / n
    while True:
        cut = np.uint64(min(1.0, share) * (2**64 - 1025))

        def low(batches, cut=cut):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                hashes = [mixed_bits(ids, seed * 1_000_003 + d) for d in range(draws)]
                at = [np.flatnonzero(h <= cut) for h in hashes]
                rows = np.concatenate(at)
                h = np.concatenate([h[k] for h, k in zip(hashes, at, strict=True)]).view(np.int64) ^ np.int64(-(2**63))
                draw = np.repeat(np.arange(draws, dtype=np.int32), [len(k) for k in at])
                yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(h), pa.array(ids[rows]), batch.column(1).take(pa.array(rows))], ["draw", "h", "window_id", "values"])

        rows = pool.select(F.col("window_id").cast("long").alias("window_id"), "values").mapInArrow(low, "draw int, h long, window_id long, values array<double>")
        order = Window.partitionBy("draw").orderBy("h", "window_id")
        # In order on the driver: a sort over all tasks would draw the samples a second time for its bounds.
        kept = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("draw", "r", "values").toArrow().sort_by([("draw", "ascending"), ("r", "ascending")])
        if share >= 1 or (len(kept) == draws * size):
            break
        share *= 2  # a draw was short: the cut was too low
    values = stacked(kept["values"].combine_chunks())
    return [values[d * size : (d + 1) * size] for d in range(draws)]


def scalar(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[str], Column]:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(fn(np.stack(s.to_numpy()))) if len(s) else pd.Series([], dtype=float)

    return run


class PcaScorer:
    """Squared reconstruction error with the components of `keep` of the variance, from one Gram matrix of the whole pool."""

    def __init__(self, pool: DataFrame, keep: float = 0.95):
        g = gram(pool)
        n = g[0, 0]
        self.mean = g[0, 1:] / n
        values, vectors = np.linalg.eigh(g[1:, 1:] / n - np.outer(self.mean, self.mean))
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        self.basis = vectors[:, : int(np.searchsorted(np.cumsum(values) / values.sum(), keep)) + 1].T
        self.rest = np.eye(len(self.mean)) - self.basis.T @ self.basis

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.mean) @ self.rest) ** 2).sum(1)

    def score(self, values: str) -> Column:
        return scalar(self.scores)(values)

    def gradient(self, values: str) -> Column:
        """|d score / d x| * |x|, in closed form."""
        mean, rest = self.mean, self.rest
        return batched(lambda x: np.abs(2 * (x - mean) @ rest) * np.abs(x))(values)

    def counterfactual(self, values: str, to: np.ndarray | None = None) -> Column:
        """GlobalCF: the drop of the score when one variable at a time is set to the pool mean."""
        mean, rest = self.mean, self.rest
        to = mean if to is None else to
        diag = np.diag(rest)

        def run(x: np.ndarray) -> np.ndarray:
            r = (x - mean) @ rest
            step = to - x
            return -(2 * r * step + step**2 * diag)

        return batched(run)(values)


class IsolationForest:
    """Random trees, each on its own sample of the whole pool; the score is 2 to the minus mean path length over its expectation."""

    def __init__(self, pool: DataFrame, trees: int = 200, size: int = 256, seed: int = 0):
        drawn = samples(pool, trees, size, seed)
        rng = np.random.default_rng(seed)
        held = len(drawn[0]) if drawn else 0
        self.norm = self.expected(held)
        depth = int(np.ceil(np.log2(max(2, held))))
        trees = [self.grow(x, depth, rng) for x in drawn]
        # Trees as arrays, one after another: a leaf leads to itself and holds the path's length.
        self.roots, nodes = [], []
        for tree in trees:
            self.roots.append(len(nodes))
            self.place(tree, 0, nodes)
        self.depth, self.of = depth, [np.array(c) for c in zip(*nodes, strict=True)] if nodes else []

    def place(self, tree: tuple, depth: int, nodes: list[list]) -> int:
        at = len(nodes)
        if len(tree) == 1:
            nodes.append([0, 0.0, at, at, depth + tree[0]])
            return at
        nodes.append([tree[0], tree[1], 0, 0, 0.0])
        nodes[at][2] = self.place(tree[2], depth + 1, nodes)
        nodes[at][3] = self.place(tree[3], depth + 1, nodes)
        return at

    @staticmethod
    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
        low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
        free = np.flatnonzero(high > low)
        if depth == 0 or len(x) < 2 or not len(free):
            return (self.expected(len(x)),)
        k = int(rng.choice(free))
        cut = float(rng.uniform(low[k], high[k]))
        left = x[:, k] < cut
        return (k, cut, self.grow(x[left], depth - 1, rng), self.grow(x[~left], depth - 1, rng))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.of:
            return np.ones(len(x))
        variable, cut, left, right, length = self.of
        out = np.empty(len(x))
        for low in range(0, len(x), 1024):
            part = x[low : low + 1024]
            rows = np.arange(len(part))[:, None]
            at = np.broadcast_to(np.array(self.roots), (len(part), len(self.roots)))
            for _ in range(self.depth):
                at = np.where(part[rows, variable[at]] < cut[at], left[at], right[at])
            out[low : low + 1024] = length[at].mean(1)
        return self.told(out)

    def told(self, length: np.ndarray) -> np.ndarray:
        return 2.0 ** (-length / max(self.norm, 1e-9))

    def one_changed(self, x: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
        """attribution.one_changed: a tree is walked anew only from where a changed variable turns a window's path."""
        n, trees = len(x), len(self.roots)
        if not self.of:
            return np.ones((size + 1, n))
        variable, cut, left, right, length = self.of
        rows, at = np.arange(n)[:, None], np.broadcast_to(np.array(self.roots), (n, trees))
        first, turned = np.zeros((n, trees, size), bool), []  # of the variables that have turned the path: only the first turn counts
        for _ in range(self.depth):
            v, c = variable[at], cut[at]
            goes, would = x[rows, v] < c, to[rows, v] < c
            i, t = np.nonzero((goes != would) & (left[at] != at))
            j = v[i, t] % size
            new = ~first[i, t, j]
            i, t, j = i[new], t[new], j[new]
            first[i, t, j] = True
            turned.append((i, t, j, np.where(would[i, t], left[at[i, t]], right[at[i, t]])))
            at = np.where(goes, left[at], right[at])
        lengths = np.broadcast_to(length[at], (size + 1, n, trees)).copy()
        i, t, j, at = (np.concatenate(p) for p in zip(*turned, strict=True))
        for _ in range(self.depth):
            v = variable[at]
            at = np.where(np.where(v % size == j, to[i, v], x[i, v]) < cut[at], left[at], right[at])
        lengths[j, i, t] = length[at]
        return self.told(lengths.mean(2))

    def score(self, values: str) -> Column:
        return scalar(self.scores)(values)


class AutoEncoder:
    """Two hidden layers, full-batch Adam: an epoch is one pass over the whole pool. Reconstruction error per variable."""

    def __init__(self, pool: DataFrame, hidden: tuple[int, int] = (128, 32), epochs: int = 30, rate: float = 1e-3, seed: int = 0, in_hand: int | None = None):
        passes = Passes(pool, in_hand)
        size = passes.size
        rng = np.random.default_rng(seed)
        sizes = [size, *hidden, *hidden[-2::-1], size]
        self.w = [rng.normal(0, np.sqrt(2 / max(a, 1)), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        params = self.w + self.b
        ends = np.cumsum([p.size for p in params])[:-1]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, (epochs if passes.n else 0) + 1):
            whole = passes.total(self.gradients) / (passes.n * size)
            for k, part in enumerate(np.split(whole, ends)):
                g = part.reshape(params[k].shape)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        passes.done()

    def gradients(self, x: np.ndarray) -> np.ndarray:
        """Of the summed squared errors of these windows, by all weights and then all offsets, in one row."""
        hs = self.forward(x)
        grad = 2 * (hs[-1] - x)
        gw: list = [None] * len(self.w)
        gb: list = [None] * len(self.w)
        for k in reversed(range(len(self.w))):
            gw[k], gb[k] = hs[k].T @ grad, grad.sum(0)
            if k:
                grad = grad @ self.w[k].T * (hs[k] > 0)
        return np.concatenate([g.ravel() for g in gw + gb])

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        hs = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            h = hs[-1] @ w + b
            hs.append(h if k == len(self.w) - 1 else np.maximum(h, 0))
        return hs

    def rebuilt(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.rebuilt(x)) ** 2).sum(1)

    def attribution(self, values: str) -> Column:
        return batched(lambda x: np.abs(x - self.rebuilt(x)))(values)

    def score(self, values: str) -> Column:
        return scalar(self.scores)(values)

    def gradient(self, values: str) -> Column:
        """|d score / d x| * |x|, by one pass back through the layers."""

        def run(x: np.ndarray) -> np.ndarray:
            hs = self.forward(x)
            direct = 2 * (x - hs[-1])
            back = -direct
            for k in reversed(range(len(self.w))):
                back = back @ self.w[k].T * (hs[k] > 0 if k else 1.0)
            return np.abs(direct + back) * np.abs(x)

        return batched(run)(values)


class OneClassSvm:
    """One-class support vectors in a space of random Fourier features of the RBF kernel.

    The objective |w|^2 / 2 - rho + mean of max(0, rho - w z) / nu is solved on a sample of the whole pool and then brought
    down by steps along its gradient over all windows, one pass each; the mean of the last half of the steps is taken.
    """

    def __init__(self, pool: DataFrame, nu: float = 0.05, features: int = 256, steps: int = 300, passes: int = 20, size: int = 8192, seed: int = 0, in_hand: int | None = None):
        every = Passes(pool, in_hand)
        n, d = every.n, every.size
        rng = np.random.default_rng(seed)
        first = every.total(lambda x: np.array([x.sum(), (x * x).sum()])) / max(n * d, 1) if n else np.array([0.0, 1.0])
        gamma = 1 / max(d * (first[1] - first[0] ** 2), 1e-12)
        self.a, self.c = rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features)
        z = self.features(samples(pool, 1, size, seed)[0]) if n else np.zeros((1, features))
        w, rho = z.mean(0), 0.0
        for t in range(1, steps + 1):
            rho = np.quantile(z @ w, nu)
            inside = z @ w < rho
            w = w - (w - z[inside].mean(0)) / t if inside.any() else w
        kept = []
        for t in range(1, (passes if n else 0) + 1):

            def below(x: np.ndarray, w=w, rho=rho) -> np.ndarray:
                f = self.features(x)
                under = f @ w < rho
                return np.append(f[under].sum(0), under.sum())

            *s, under = every.total(below)
            w = w - (w - np.array(s) / (nu * n)) / (steps + t)
            rho = rho + (1 - under / (nu * n)) / (steps + t)
            kept.append((w, rho))
        every.done()
        last = kept[len(kept) // 2 :] or [(w, rho)]
        self.w, self.rho = np.mean([w for w, _ in last], axis=0), float(np.mean([rho for _, rho in last]))

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.c)) * np.cos(x @ self.a + self.c)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.rho - self.features(x) @ self.w

    def score(self, values: str) -> Column:
        return scalar(self.scores)(values)


SCORERS = {"pca": PcaScorer, "iforest": IsolationForest, "ae": AutoEncoder, "ocsvm": OneClassSvm}


def make_scorer(kind: str, pool: DataFrame, **options):
    if kind not in SCORERS:
        raise ValueError(f"unknown scorer {kind}")
    return SCORERS[kind](pool, **options)


def scored(windows: DataFrame, fitted: dict) -> DataFrame:
    """(scorer, y, s): for each window (y, values) a row with the score of each fitted scorer. All are told in one pass, and kept: an
    order over the scores goes over them more than once. Windows are dealt out first, as a file of few row groups is few tasks."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = stacked(batch.column(1))
                for kind, scorer in fitted.items():
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(x)), batch.column(0), pa.array(scorer.scores(x))], ["scorer", "y", "s"])

    dealt = windows.select(F.col("y").cast("int"), "values").repartition(windows.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "scorer string, y int, s double").persist()
