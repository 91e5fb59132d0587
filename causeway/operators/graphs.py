"""Edge tables: (src, dst) with optional confidence w. Variables are few; windows are many."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import hashing
from causeway.operators.moments import correlations, gram, grouped_correlations, lagged_correlations


def correlation_graph(windows: DataFrame, threshold: float) -> DataFrame:
    """Edges a < b with |r| > threshold and w = |r|, from one Gram matrix of the windows' values: a partition adds up one D * D
    matrix, and only those are shuffled."""
    r = np.abs(correlations(gram(windows)))
    found = [(int(a), int(b), float(r[a, b])) for a, b in zip(*np.nonzero(np.triu(r > threshold, 1)), strict=True)]
    return windows.sparkSession.createDataFrame(found, "src int, dst int, w double")


def correlation_graphs(windows: DataFrame, groups: tuple[str, ...], threshold: float) -> DataFrame:
    """The correlation graphs of groups of windows in one pass: (groups, src, dst, w). A task adds up a matrix for each group that it
    meets."""
    found = grouped_correlations(windows, groups).where(F.col("r") > threshold)
    return found.select(*groups, F.col("i").alias("src"), F.col("j").alias("dst"), F.col("r").alias("w"))


def lagged_correlation_graph(series: DataFrame, threshold: float, max_lag: int) -> DataFrame:
    """Edges src -> dst where the largest |corr(x_src(t - lag), x_dst(t))| over the lags 0..max_lag exceeds the threshold.

    A lagged edge points from the earlier to the later series; at lag 0 from the lower to the higher variable. The reference
    set lagged edges against its own comment; the defined direction is kept here.
    """
    r = lagged_correlations(series, max_lag).where("i <> j and (lag > 0 or i < j)").select("unit", F.col("i").alias("src"), F.col("j").alias("dst"), "lag", F.abs("r").alias("r"))
    best = r.groupBy("unit", "src", "dst").agg(F.max("r").alias("w"), F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"))
    return best.where(F.col("w") > threshold)


def features(edges: DataFrame, nodes: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The eleven graph features. sink_frac is the share of nodes without incoming edges, source_frac without outgoing ones:
    the names are those of the reference."""
    ins = edges.groupBy(*group, F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    outs = edges.groupBy(*group, F.col("src").alias("node")).agg(F.count("*").alias("o"))
    degrees = nodes.join(ins, [*group, "node"], "left").join(outs, [*group, "node"], "left").fillna(0, ["i", "o"])
    sums = degrees.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum("i").alias("e"), F.max("i").alias("imax"), F.max("o").alias("omax"), F.avg("i").alias("imean"), F.stddev_pop("i").alias("istd"),
        F.avg((F.col("i") == 0).cast("int")).alias("sink"), F.avg((F.col("o") == 0).cast("int")).alias("source"),
        F.sum(F.when(F.col("i") > 0, F.col("i") * F.log("i")).otherwise(0.0)).alias("ilog"), F.sum(F.when(F.col("o") > 0, F.col("o") * F.log("o")).otherwise(0.0)).alias("olog"),
    )
    e, n = F.col("e"), F.col("n")

    def entropy(s: str) -> Column:
        return F.when(e > 0, F.log(e) - F.col(s) / e).otherwise(0.0)

    return sums.select(
        *group, n.alias("g_n_nodes"), e.cast("double").alias("g_n_edges"), F.when(n > 1, e / (n * (n - 1))).otherwise(0.0).alias("g_density"),
        entropy("ilog").alias("g_indeg_entropy"), entropy("olog").alias("g_outdeg_entropy"), F.col("imax").cast("double").alias("g_indeg_max"),
        F.col("omax").cast("double").alias("g_outdeg_max"), F.col("imean").alias("g_indeg_mean"), F.col("istd").alias("g_indeg_std"),
        F.col("sink").alias("g_sink_frac"), F.col("source").alias("g_source_frac"),
    )


def precision_recall(est: DataFrame, true: DataFrame) -> DataFrame:
    """Directed exact match: recall, precision, f1. Nothing true gives (1, 1); nothing estimated gives precision 1."""
    both = est.select("src", "dst").distinct().withColumn("e", F.lit(1)).join(true.select("src", "dst").distinct().withColumn("t", F.lit(1)), ["src", "dst"], "full")
    c = both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("ne"), F.coalesce(F.sum("t"), F.lit(0)).alias("nt"), F.coalesce(F.sum(F.col("e") * F.col("t")), F.lit(0)).alias("hit"))
    recall = F.when(F.col("nt") == 0, 1.0).otherwise(F.col("hit") / F.nullif(F.col("nt"), F.lit(0)))
    precision = F.when((F.col("nt") == 0) | (F.col("ne") == 0), 1.0).otherwise(F.col("hit") / F.nullif(F.col("ne"), F.lit(0)))
    out = c.select(recall.alias("recall"), precision.alias("precision"))
    total = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / F.nullif(total, F.lit(0.0))))


def prune(edges: DataFrame, share: float) -> DataFrame:
    """Without the floor(E * share) edges of least confidence; ties in row-major order."""
    w = Window.orderBy("w", "src", "dst")
    n = edges.agg(F.floor(F.count("*") * share).alias("cut"))
    return edges.join(F.broadcast(n)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") > F.col("cut")).drop("_r", "cut")  # one row


def adaptive_share(edges: DataFrame) -> DataFrame:
    """Share to prune: 1 - mean confidence, within 0.1 and 0.6."""
    return edges.agg(F.least(F.greatest(1 - F.avg("w"), F.lit(0.1)), F.lit(0.6)).alias("share"))


def closure(edges: DataFrame) -> DataFrame:
    """(node, descendant) reachable in one step or more, however many it takes: paths double in length each round, until none is
    new. The pairs of few nodes are kept between rounds."""
    seen = edges.select(F.col("src").alias("node"), F.col("dst").alias("descendant")).distinct()
    n = -1
    while (now := seen.count()) != n:
        n = now
        onward = seen.select(F.col("node").alias("descendant"), F.col("descendant").alias("end"))
        seen = seen.union(seen.join(onward, "descendant").select("node", "end")).distinct().persist()
    return seen


def delete_edges(edges: DataFrame, eps: float, *parts: Column | str | int) -> DataFrame:
    """Each edge goes with probability eps."""
    return edges.where(hashing.uniform(*parts, F.col("src"), F.col("dst")) >= eps)


def add_edges(edges: DataFrame, nodes: DataFrame, order: DataFrame, eps: float, *parts: Column | str | int) -> DataFrame:
    """edges and round(eps * absent) of the absent pairs that go forward in the order (node, pos). Nodes are few."""
    a = order.select(F.col("node").alias("src"), F.col("pos").alias("_ps"))
    b = order.select(F.col("node").alias("dst"), F.col("pos").alias("_pd"))
    absent = a.join(F.broadcast(b), F.col("_ps") < F.col("_pd")).select("src", "dst").join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    n = absent.agg(F.bround(F.count("*") * eps).cast("int").alias("n"))
    ranked = absent.withColumn("_u", hashing.uniform(*parts, F.col("src"), F.col("dst"))).withColumn("_r", F.row_number().over(Window.orderBy("_u", "src", "dst")))
    new = ranked.join(F.broadcast(n)).where(F.col("_r") <= F.col("n")).select("src", "dst")  # one row
    return edges.select("src", "dst").unionByName(new)


def rewire_edges(edges: DataFrame, order: DataFrame, q: float, *parts: Column | str | int) -> DataFrame:
    """max(1, round(q * E)) edges are put back so that they go forward in the order: kept or reversed, merged if present."""
    n = edges.agg(F.greatest(F.lit(1), F.bround(F.count("*") * q).cast("int")).alias("n"))
    ranked = edges.select("src", "dst").withColumn("_u", hashing.uniform(*parts, F.col("src"), F.col("dst"))).withColumn("_r", F.row_number().over(Window.orderBy("_u", "src", "dst")))
    picked = ranked.join(F.broadcast(n)).withColumn("_p", F.col("_r") <= F.col("n"))  # one row
    a, b = order.select(F.col("node").alias("src"), F.col("pos").alias("_ps")), order.select(F.col("node").alias("dst"), F.col("pos").alias("_pd"))
    placed = picked.join(F.broadcast(a), "src").join(F.broadcast(b), "dst")
    flip = F.col("_p") & (F.col("_ps") > F.col("_pd"))
    return placed.select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()


def topological_order(edges: Iterable[tuple[int, int]], nodes: Iterable[int]) -> list[int]:
    """Kahn's order with the smallest free node first; the plain order of nodes if there is a cycle."""
    nodes = sorted(nodes)
    follow: dict[int, set[int]] = {n: set() for n in nodes}
    waiting = dict.fromkeys(nodes, 0)
    for a, b in set(edges):
        if b not in follow[a]:
            follow[a].add(b)
            waiting[b] += 1
    free, out = [n for n in nodes if not waiting[n]], []
    while free:
        free.sort()
        n = free.pop(0)
        out.append(n)
        for m in follow[n]:
            waiting[m] -= 1
            if not waiting[m]:
                free.append(m)
    return out if len(out) == len(nodes) else nodes


def kernel(edges: list[tuple[int, int, float]], size: int, damping: float = 0.5, steps: int = 20) -> np.ndarray:
    """The linear map z -> phi of `steps` rounds of phi = (1 - d) z + d phi M, with M[j, i] = A[i, j] / outdegree(i)."""
    return matrix_kernel(weights(edges, size), damping, steps)


def weights(edges: list[tuple[int, int, float]], size: int) -> np.ndarray:
    a = np.zeros((size, size))
    for s, d, w in edges:
        a[s, d] = w
    return a


def matrix_kernel(a: np.ndarray, damping: float = 0.5, steps: int = 20) -> np.ndarray:
    """kernel of a matrix of weights."""
    size, out = len(a), a.sum(1, keepdims=True)
    m = np.divide(a, out, out=np.zeros_like(a), where=out > 0).T
    k = np.eye(size)
    for _ in range(steps):
        k = (1 - damping) * np.eye(size) + damping * k @ m
    return k


class KernelUpdates:
    """Kernels of a graph with one edge changed, as corrections of the graph's own.

    A change (src, dst, weight; 0 takes the edge out) alters one column of the step's matrix M, by u. Twenty rounds of
    phi = (1 - d) z + d phi M are then those without the change plus, for every round, one number a window (what the round
    takes in through u) times a row of a power of dM. So a kernel is the graph's kernel plus left.T @ right, with `steps` rows in
    each: variables squared numbers a round where a kernel anew takes a product of matrices.
    """

    def __init__(self, a: np.ndarray, damping: float = 0.5, steps: int = 20):
        self.a, self.damping, self.steps = a, damping, steps
        out = a.sum(1, keepdims=True)
        m = np.divide(a, out, out=np.zeros_like(a), where=out > 0).T
        eye = np.eye(len(a))
        self.kernels, powers = [eye], [eye]
        for _ in range(steps):
            self.kernels.append((1 - damping) * eye + damping * self.kernels[-1] @ m)
            powers.append(damping * powers[-1] @ m)
        self.columns = m
        self.kernel = self.kernels[-1]
        #: rights[s]: rows s of the powers, the highest first.
        self.rights = np.stack(powers[:steps][::-1], axis=1)

    def lefts(self, changes: list[tuple[int, int, float] | None]) -> np.ndarray:
        """(changes, steps, variables): the left factor of each change; zeros for None."""
        n, size = len(changes), len(self.a)
        u, source = np.zeros((n, size)), np.zeros(n, dtype=np.int64)
        for c, change in enumerate(changes):
            if change is not None:
                s, d, w = change
                row = self.a[s].copy()
                row[d] = w
                total = row.sum()
                u[c] = (row / total if total > 0 else np.zeros(size)) - self.columns[:, s]
                source[c] = s
        taken = np.einsum("tij,cj->tci", np.stack(self.kernels[: self.steps]), u, optimize=True)
        # through[c, m]: what the row after m rounds takes in through u again
        through = np.einsum("cmj,cj->cm", self.rights[source], u)[:, ::-1]
        out = np.zeros((n, self.steps, size))
        for t in range(self.steps):
            again = np.einsum("ci,cid->cd", through[:, :t][:, ::-1], out[:, :t]) if t else 0.0
            out[:, t] = self.damping * (taken[t] + again)
        return out

    def sources(self, changes: list[tuple[int, int, float] | None]) -> np.ndarray:
        return np.array([0 if c is None else c[0] for c in changes], dtype=np.int64)
