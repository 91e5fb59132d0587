"""Attribution of windows to variables: arrays phi, one per window. Dense kernels run on Arrow batches; all else is columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import arrays, hashing
from causeway.operators import graphs
from causeway.operators.moments import gram

def batched(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[str | Column], Column]:
    """A function of (windows, variables) matrices as a column function on arrays."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(fn(np.stack(s.to_numpy())))) if len(s) else pd.Series([], dtype=object)

    return run


def stat_arrays(stats: DataFrame) -> dict[str, list[float]]:
    """Pool statistics as arrays by variable. One number per variable reaches the driver."""
    rows = stats.orderBy("var").collect()
    return {k: [r[k] for r in rows] for k in ("med", "mad", "mean", "std")}


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def zdev(values: Column, stats: dict[str, list[float]]) -> Column:
    """Robust deviation |x - med| / mad of single-step windows."""
    d = F.zip_with(values, literal(stats["med"]), lambda x, m: F.abs(x - m))
    return F.zip_with(d, literal(stats["mad"]), lambda x, m: x / m)


def zdev_long(cells: DataFrame, stats: DataFrame, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """The same in long form for windows of any width: mean over the steps."""
    z = cells.join(F.broadcast(stats.select("var", "med", "mad")), "var").withColumn("z", F.abs(F.col("x") - F.col("med")) / F.col("mad"))
    return z.groupBy(*keys, "var").agg(F.avg("z").alias("z"))


def row_max_normalized(z: Column) -> Column:
    return arrays.let(F.array_max(z) + 1e-9, lambda m: F.transform(z, lambda v: v / m))


def proprank(z: Column, edges: list[tuple[int, int, float]], size: int, damping: float = 0.5, steps: int = 20) -> Column:
    """A node keeps (1 - d) of its own deviation and takes d times the weighted mean of its children's: `steps` rounds, folded
    into one matrix per graph."""
    k = graphs.kernel(edges, size, damping, steps)
    return batched(lambda x: (x / (x.max(1, keepdims=True) + 1e-9)) @ k)(z)


#: Bytes of kernel corrections that go to the tasks at once; more changes take more passes over the windows.
CORRECTIONS = 64 << 20


def graph_overlaps(z: DataFrame, edges: list[tuple[int, int, float]], changes: list[tuple[int, int, float] | None], others: list[list[tuple[int, int, float]]], size: int, k: int = 3) -> list[float]:
    """For each change of the graph the mean overlap of PropRank's top k with those of the other graphs, over all windows (phi). A
    change sets the weight of one edge, 0 takes it out; None leaves the graph as it is.

    Changed kernels are corrections of the graph's own: they are made once, and what the tasks get of them is bounded. Whole
    numbers are added up, so equal overlaps are equal. One row per change and task is shuffled.
    """
    if not changes or not others:
        return [0.0] * len(changes)
    spark = z.sparkSession
    updates, refs = graphs.KernelUpdates(graphs.weights(edges, size)), [graphs.kernel(o, size) for o in others]
    dealt = z.select("phi").repartition(spark.sparkContext.defaultParallelism)
    at_once = max(1, CORRECTIONS // (8 * updates.steps * size))
    found: dict[int, float] = {}
    for first in range(0, len(changes), at_once):
        some = changes[first : first + at_once]
        held = spark.sparkContext.broadcast((updates.kernel, updates.lefts(some), updates.rights, updates.sources(some), refs))

        def run(batches, held=held):
            kernel, lefts, rights, sources, refs = held.value
            kept, n = np.zeros(len(lefts), dtype=np.int64), 0
            for pdf in batches:
                for low in range(0, len(pdf), 512):
                    x = np.stack(pdf["phi"].iloc[low : low + 512].to_numpy())
                    x, n = x / (x.max(1, keepdims=True) + 1e-9), n + len(x)
                    seen = np.zeros(x.shape, dtype=np.int64)
                    for ref in refs:
                        for at in tops(x @ ref, k):
                            seen[at] += 1
                    base = x @ kernel
                    for c in range(0, len(lefts), 16):
                        moved = base + (x @ lefts[c : c + 16].transpose(0, 2, 1)) @ rights[sources[c : c + 16]]
                        kept[c : c + 16] += sum(seen[at[1], at[2]].sum(1) for at in tops(moved, k))
            if n:
                yield pd.DataFrame({"change": np.arange(len(kept)), "kept": kept, "n": n})

        rows = dealt.mapInPandas(run, "change int, kept long, n long").groupBy("change").agg(F.sum("kept").alias("kept"), F.sum("n").alias("n")).collect()
        found.update({first + r.change: r.kept / (k * len(others) * r.n) for r in rows})
        held.destroy()
    return [found.get(c, 0.0) for c in range(len(changes))]


def tops(f: np.ndarray, k: int):
    """Places of the largest, then the next, of the last axis, k times; ties go to the lower index. f is used up."""
    rows = np.indices(f.shape[:-1])
    for _ in range(k):
        at = (*rows, f.argmax(-1))
        yield at
        f[at] = -np.inf


def gcn_rank(z: Column, edges: list[tuple[int, int, float]], size: int, layers: int = 2) -> Column:
    a = np.eye(size)
    for s, d, _ in edges:
        a[d, s] += 1
    a /= a.sum(1, keepdims=True)

    def run(x: np.ndarray) -> np.ndarray:
        h = x / (x.max(1, keepdims=True) + 1e-9)
        for _ in range(layers):
            h = np.tanh(h @ a)
        return h

    return batched(run)(z)


def random_phi(window: Column, size: int, seed: int = 0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda v: hashing.uniform(seed, window, v))


def graa_gate(pruned: DataFrame, gamma: float = 1.0, how: str = "mean", none: float | None = 0.0) -> DataFrame:
    """One row: gate, from the confidences that pruning left. No edge left (trimmed: none within the cuts) gives gate `none`."""
    w = F.col("w")
    agg = {
        "mean": F.avg(w), "median": F.percentile(w, F.lit(0.5)), "max": F.max(w),
        "trimmed": arrays.trimmed_mean(F.collect_list(w)) if how == "trimmed" else F.avg(w),
    }[how]
    return pruned.agg(F.coalesce(F.pow(agg, F.lit(gamma)), F.lit(none).cast("double")).alias("gate"))


def mixed(gate: Column, a: Column, b: Column) -> Column:
    """gate * shares of a + (1 - gate) * shares of b."""
    return F.zip_with(arrays.normalized(a), arrays.normalized(b), lambda x, y: gate * x + (1 - gate) * y)


def ridge_models(g: np.ndarray, edges: list[tuple[int, int, float]], ridge: float = 1e-2) -> list[tuple[list[int], np.ndarray, float]]:
    """Per variable its parents, coefficients (intercept first, penalised too) and residual deviation, all from one Gram matrix."""
    d, n = len(g) - 1, g[0, 0]
    out = []
    for j in range(d):
        pa = sorted({s for s, t, w in edges if t == j and w > 0 and s != j})
        if not pa:
            out.append(([], np.zeros(0), 0.0))
            continue
        k = [0, *[p + 1 for p in pa]]
        a, b = g[np.ix_(k, k)], g[k, j + 1]
        c = np.linalg.solve(a + ridge * np.eye(len(k)), b)
        sse = g[j + 1, j + 1] - 2 * c @ b + c @ a @ c
        mean = (g[0, j + 1] - c @ a[0]) / n
        out.append((pa, c, float(np.sqrt(max(sse / n - mean**2, 0.0)) + 1e-9)))
    return out


def residual_z(values: Column, models: list, stats: dict[str, list[float]]) -> Column:
    """|x_j - prediction from parents| / residual deviation; the robust deviation where a variable has no parents."""
    med, mad = np.array(stats["med"]), np.array(stats["mad"])

    def run(x: np.ndarray) -> np.ndarray:
        z = np.abs(x - med) / mad
        for j, (pa, c, sd) in enumerate(models):
            if pa:
                z[:, j] = np.abs(x[:, j] - c[0] - x[:, pa] @ c[1:]) / sd
        return z

    return batched(run)(values)


def dpta(z: Column, r: Column, alpha: float = 0.5) -> Column:
    return F.zip_with(arrays.normalized(z), arrays.normalized(r), lambda x, y: alpha * x + (1 - alpha) * y)


def granger(pool: DataFrame, queries: DataFrame, edges: list[tuple[int, int, float]], ridge: float = 1e-2) -> DataFrame:
    """(window_id, phi) for queries with values (array of steps of arrays): of each target's lag-1 ridge regression on its
    parents and itself, the error that each predictor's absence adds on the window goes to that predictor."""
    pairs = pool.select(F.explode(F.arrays_zip(F.slice("values", F.lit(1), F.size("values") - 1).alias("a"), F.slice("values", F.lit(2), F.size("values") - 1).alias("b"))).alias("p"))
    g = gram(pairs.select(F.concat("p.a", "p.b").alias("values")))
    d = (len(g) - 1) // 2
    fits = []
    for i in range(d):
        pa = sorted({s for s, t, w in edges if t == i and w > 0} | {i})
        for left in [None, *pa]:
            k = [0, *[p + 1 for p in pa if p != left]]
            fits.append((i, left, k, np.linalg.solve(g[np.ix_(k, k)] + ridge * np.eye(len(k)), g[k, d + i + 1])))

    def run(batches):
        for pdf in batches:
            for _, same in pdf.groupby(pdf["values"].map(len)):  # windows of one length at once
                x = np.stack(same["values"].to_numpy()).reshape(len(same), -1, d)
                a, b = np.concatenate([np.ones((len(x), x.shape[1] - 1, 1)), x[:, :-1]], axis=2), x[:, 1:]
                phi, full = np.zeros((len(x), d)), np.zeros(len(x))
                for i, left, k, c in fits:
                    sse = ((b[:, :, i] - a[:, :, k] @ c) ** 2).sum(1)
                    if left is None:
                        full = sse
                    else:
                        phi[:, left] += sse - full
                yield pd.DataFrame({"window_id": same["window_id"], "phi": list(phi)})

    return queries.select("window_id", F.flatten("values").alias("values")).mapInPandas(run, "window_id long, phi array<double>")


#: Rows that starting points and pivots are drawn from.
DRAWN = 8192


def log_densities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(rows, components): log of weight times density of a Gaussian mixture with diagonal covariances."""
    square = (x * x) @ (1 / var).T - 2 * x @ (mean / var).T + (mean * mean / var).sum(1)
    return np.log(weight + 1e-300) - 0.5 * (square + np.log(2 * np.pi * var).sum(1))


def component_sums(x: np.ndarray, fits: list[tuple], hard: bool) -> np.ndarray:
    """(fits, components, 2 + 2 * variables): of each component its weight in the rows, their log-likelihood, and the weighted sums
    of values and of their squares. hard: a row belongs to its likeliest component alone."""
    rows = []
    for fit in fits:
        p = log_densities(x, *fit)
        top = p.max(1, keepdims=True)
        r = np.exp(p - top)
        log = float((top[:, 0] + np.log(r.sum(1))).sum())
        r = np.eye(p.shape[1])[p.argmax(1)] if hard else r / r.sum(1, keepdims=True)
        rows.append(np.hstack([r.sum(0)[:, None], np.full((p.shape[1], 1), log), r.T @ x, r.T @ (x * x)]))
    return np.stack(rows)


def moved_fits(fits: list[tuple], s: np.ndarray, ridge: float) -> list[tuple]:
    """The fits that sums of soft memberships give."""
    d = fits[0][1].shape[1]
    count = s[..., :1] + 1e-12
    mean = np.where(s[..., :1] > 0, s[..., 2 : 2 + d] / count, np.stack([f[1] for f in fits]))
    var = np.maximum(s[..., 2 + d :] / count - mean**2, 0) + ridge
    return [(c[:, 0] / c.sum(), m, v) for c, m, v in zip(count, mean, var, strict=True)]


def mixture(codes: DataFrame, components: int = 8, starts: int = 2, rounds: int = 200, tolerance: float = 1e-3, ridge: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances of a diagonal Gaussian mixture of all rows (window_id, code), the likeliest of `starts`.

    Starts are drawn as in k-means++ from the rows with the least id hashes and brought near by k-means and expectation on those
    on the driver. Then a round of expectation is one pass over all rows for all starts, until the mean log-likelihood of all rows
    gains less than `tolerance`: sums per component are added up over the partitions.
    """

    def sums(fits: list[tuple]) -> np.ndarray:
        def partial(batches):
            total = 0.0
            for pdf in batches:
                if len(pdf):
                    total = total + component_sums(np.stack(pdf["code"].to_numpy()), fits, False)
            if not np.isscalar(total):
                yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

        rows = codes.select("code").mapInPandas(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()
        return rows["s"].to_numpy().reshape(len(fits), len(fits[0][0]), -1)

    drawn = codes.orderBy(F.xxhash64("window_id"), "window_id").limit(DRAWN).select("code").toPandas()
    x = np.stack(drawn["code"].to_numpy())
    components, fits = min(components, len(x)), []
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        at = [int(rng.integers(len(x)))]
        while len(at) < components:
            far = ((x[:, None] - x[at]) ** 2).sum(2).min(1)
            at.append(int(rng.choice(len(x), p=far / far.sum() if far.sum() > 0 else None)))
        fits.append((np.full(components, 1 / components), x[at], np.ones((components, x.shape[1]))))
    for _ in range(10):
        s = component_sums(x, fits, True)
        fits = [(f[0], np.where(c[:, :1] > 0, c[:, 2 : 2 + x.shape[1]] / (c[:, :1] + 1e-12), f[1]), f[2]) for f, c in zip(fits, s, strict=True)]
    fits = moved_fits(fits, component_sums(x, fits, True), ridge)

    def until_settled(fits: list[tuple], step: Callable[[list[tuple]], np.ndarray]) -> tuple[list[tuple], np.ndarray]:
        before = np.full(len(fits), -np.inf)
        for _ in range(rounds):
            s = step(fits)
            likely = s[:, 0, 1] / s[..., 0].sum(1)
            if (np.abs(likely - before) < tolerance).all():
                return fits, likely
            before, fits = likely, moved_fits(fits, s, ridge)
        return fits, before

    fits, _ = until_settled(fits, lambda f: component_sums(x, f, False))
    fits, likely = until_settled(fits, sums)
    return fits[int(likely.argmax())]


#: Pivots of a group that its pool is dealt to.
PIVOTS = 32


class Pivots:
    """Reference points of each group, and what lies at which distance of them: the triangle inequality tells which pools of a
    pivot a query can have neighbours in. A group without a point has its pool at number -1, which is never ruled out."""

    def __init__(self, points: dict[int, np.ndarray]):
        self.points = points
        #: (group, pivot): rows, least and greatest distance.
        self.pools: dict[tuple[int, int], tuple[int, float, float]] = {}

    def distances(self, grp: int, codes: np.ndarray) -> np.ndarray:
        p = self.points[grp]
        return np.sqrt(((codes[:, None] - p[None]) ** 2).sum(2))

    def nearest(self, grp: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and distance of the nearest pivot that has a pool, or of any before there are pools."""
        if grp not in self.points:
            return np.full(len(codes), -1), np.zeros(len(codes))
        d = self.distances(grp, codes)
        if self.pools:
            d[:, [k for k in range(d.shape[1]) if (grp, k) not in self.pools]] = np.inf
        at = d.argmin(1)
        return at, d[np.arange(len(d)), at]

    def within(self, grp: int, codes: np.ndarray, reach: np.ndarray, but: np.ndarray) -> list[list[int]]:
        """For each code the pivots, but one, whose pools may hold something at most `reach` away."""
        pools = [(k, low, high) for (g, k), (_, low, high) in self.pools.items() if g == grp]
        d = self.distances(grp, codes) if grp in self.points else None
        out: list[list[int]] = [[] for _ in codes]
        for k, low, high in pools:
            least = np.zeros(len(codes)) if k < 0 else np.maximum(d[:, k] - high, low - d[:, k])
            for i in np.flatnonzero((least <= reach * (1 + 1e-9) + 1e-12) & (but != k)):
                out[i].append(k)
        return out


def closest(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the k rows of p that are nearest, ties to the least id, and their squared distances. One product of
    matrices finds those that can be among them; their distances are then taken exactly."""
    square = (p * p).sum(1)
    out = []
    for low in range(0, len(q), 256):
        part = q[low : low + 256]
        about = (part * part).sum(1)[:, None] - 2 * part @ p.T + square
        slack = 1e-9 * (1 + (part * part).sum(1) + square.max())
        edge = np.partition(about, min(k, len(p)) - 1, axis=1)[:, min(k, len(p)) - 1]
        for row, near in zip(part, about <= (edge + slack)[:, None], strict=True):
            at = np.flatnonzero(near)
            d = ((p[at] - row) ** 2).sum(1)
            best = np.lexsort((ids[at], d))[:k]
            out.append((at[best], d[best]))
    return out


def grouped_rows(fn):
    """A function of (group, rows of it) to rows, over batches with a column grp."""

    def run(batches):
        for pdf in batches:
            for g, part in pdf.groupby("grp"):
                yield fn(int(g), part)

    return run


def nearest_means(pool: DataFrame, queries: DataFrame, k: int, block: int = 16_384, pivots: int = PIVOTS) -> DataFrame:
    """(window_id, template): the mean values of `nearest_ids`; the pool has values too."""
    listed = nearest_ids(pool, queries, k, block, pivots)
    return template_of(listed.join(pool.select(F.col("window_id").alias("id"), "values"), "id"), "window_id")


def template_of(listed: DataFrame, *keys: str) -> DataFrame:
    """keys and template, the mean of the values of the rows (keys, r, values), added up in the order of r."""
    best = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "values"))).alias("best"))
    one = F.transform(F.get("best", F.lit(0))["values"], lambda _, i: arrays.mean(F.transform("best", lambda b: F.get(b["values"], i))))
    return best.select(*keys, one.alias("template"))


def nearest_ids(pool: DataFrame, queries: DataFrame, k: int, block: int = 16_384, pivots: int = PIVOTS) -> DataFrame:
    """(window_id, r, id): the k nearest pool windows of the query's group, by code, numbered from 1; ties by id. Both sides have
    window_id, code and grp; window ids are unique on either side.

    The pool is dealt to pivots. A query first meets the pool of its nearest pivot; its k-th distance there then rules out the pools
    that the triangle inequality puts farther away, and it meets the others. Small pools of a group make up a tile, so a query goes once
    to all of a tile's and not once to each. Tiles and their queries are cut into blocks, so no task holds a group. The result is that of all distances, whatever is ruled out. Only codes and ids go to those meetings.
    """
    drawn = pool.orderBy(F.xxhash64("window_id"), "window_id").limit(DRAWN).select("grp", "code").toPandas()
    index = Pivots({int(g): np.unique(np.stack(part["code"].to_numpy())[:pivots], axis=0) for g, part in drawn.groupby("grp")})
    kept = "window_id long, code array<double>, grp int"

    def assigned(g: int, part: pd.DataFrame) -> pd.DataFrame:
        at, d = index.nearest(g, np.stack(part["code"].to_numpy()))
        return part.assign(pivot=at.astype("int32"), away=d)

    columns = ["window_id", "code", "grp"]
    dealt = pool.select(*columns).mapInPandas(grouped_rows(assigned), f"{kept}, pivot int, away double").cache()
    for r in dealt.groupBy("grp", "pivot").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():
        index.pools[r.grp, r.pivot] = (r.n, r.low, r.high)
    asked = queries.select("window_id", "code", "grp").where(F.col("grp").isin(sorted({g for g, _ in index.pools})))
    home = asked.mapInPandas(grouped_rows(assigned), "window_id long, code array<double>, grp int, pivot int, away double").drop("away").cache()
    first = met(dealt, home, {key: n for key, (n, _, _) in index.pools.items()}, k, block).cache()
    far = first.groupBy("window_id").agg(F.count("*").alias("n"), F.max("d").alias("far"))
    far = home.join(far, "window_id").withColumn("reach", F.when(F.col("n") >= k, F.sqrt("far")).otherwise(float("inf")))

    tile, sizes = tiled(index.pools, block)

    def reached(g: int, part: pd.DataFrame) -> pd.DataFrame:
        found = index.within(g, np.stack(part["code"].to_numpy()), part["reach"].to_numpy(), part["pivot"].to_numpy())
        by_tile: list[tuple[int, int, list[int]]] = []
        for i, pivots in enumerate(found):
            mine: dict[int, list[int]] = {}
            for v in pivots:
                mine.setdefault(tile[g, v], []).append(v)
            by_tile += [(i, t, of) for t, of in mine.items()]
        rows = part[["window_id", "code", "grp"]].iloc[[i for i, _, _ in by_tile]]
        return rows.assign(pivot=np.array([t for _, t, _ in by_tile], np.int32), pivots=pd.Series([of for _, _, of in by_tile], rows.index, object))

    more = far.select("window_id", "code", "grp", "pivot", "reach").mapInPandas(grouped_rows(reached), "window_id long, code array<double>, grp int, pivot int, pivots array<int>").cache()
    places = pool.sparkSession.createDataFrame([(g, v, t) for (g, v), t in tile.items()], "grp int, own int, pivot int")  # a row a pivot
    found = first.unionByName(met(dealt.withColumnRenamed("pivot", "own").join(F.broadcast(places), ["grp", "own"]), more, sizes, k, block))
    order = Window.partitionBy("window_id").orderBy("d", "id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("window_id", "r", "id")


def tiled(pools: dict[tuple[int, int], tuple], block: int) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Each pool's tile, named by its first pivot, and the tiles' rows: pools of one group together, of at most `block` rows where there is
    more than one."""
    tile, sizes, last = {}, {}, {}
    for (g, v), (n, *_) in sorted(pools.items()):
        if g not in last or sizes[g, last[g]] + n > block:
            last[g], sizes[g, v] = v, 0
        tile[g, v] = last[g]
        sizes[g, last[g]] += n
    return tile, sizes


def met(pool: DataFrame, queries: DataFrame, rows: dict[tuple[int, int], int], k: int, block: int) -> DataFrame:
    """(window_id, d, id): of every query and pool that meet (grp, pivot) the k nearest of each block of the pool, which has so many rows.
    With a column pivots a query meets those of the pool's rows alone whose `own` is one of them."""
    asked = {(r.grp, r.pivot): r.n for r in queries.groupBy("grp", "pivot").agg(F.count("*").alias("n")).collect()}
    sizes = [(g, v, -(-n // block), -(-asked[g, v] // block)) for (g, v), n in rows.items() if (g, v) in asked]
    parts = queries.sparkSession.createDataFrame(sizes, "grp int, pivot int, parts_p int, parts_q int")  # a row a pivot

    def cut(t: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("window_id"), F.col(f"parts_{mine}")).cast("int").alias(mine)
        rows = t.join(F.broadcast(parts), ["grp", "pivot"])
        return rows.select(*t.columns, own, F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)).alias(other))

    def near(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        at, far, ids = [], [], []
        if len(q) and len(p):
            codes = np.stack(q["code"].to_numpy())
            if "pivots" in q:
                inside = np.zeros((len(q), int(p["own"].max()) + 2), bool)  # -1 is a pivot's number too
                of = np.concatenate(q["pivots"].to_numpy()) + 1
                row = np.repeat(np.arange(len(q)), q["pivots"].map(len))
                inside[row[of < inside.shape[1]], of[of < inside.shape[1]]] = True
                parts = [(np.flatnonzero(inside[:, int(v) + 1]), part) for v, part in p.groupby("own")]
            else:
                parts = [(np.arange(len(q)), p)]
            for some, part in parts:
                known = part["window_id"].to_numpy()
                for i, (best, d) in zip(some, closest(codes[some], np.stack(part["code"].to_numpy()), known, k) if len(some) else (), strict=True):
                    at.append(np.full(len(best), i))
                    far.append(d)
                    ids.append(known[best])
        if not at:
            return pd.DataFrame([], columns=["window_id", "d", "id"])
        at, far, ids = (np.concatenate(c) for c in (at, far, ids))
        order = np.lexsort((ids, far, at))
        at, far, ids = at[order], far[order], ids[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        return pd.DataFrame({"window_id": q["window_id"].to_numpy()[at[kept]], "d": far[kept], "id": ids[kept]})

    keys = ("grp", "pivot", "p", "q")
    a, b = cut(queries, "q", "p"), cut(pool.drop("away"), "p", "q")
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(near, "window_id long, d double, id long")


def shape_features(x: np.ndarray) -> np.ndarray:
    """Of windows (n, steps, variables) the mean, slope and variance of each variable; of one step the values alone."""
    steps = x.shape[1]
    if steps == 1:
        return x[:, 0]
    t = np.arange(steps) - (steps - 1) / 2
    return np.concatenate([x.mean(1), np.einsum("s,nsv->nv", t, x) / (t * t).sum(), x.var(1)], axis=1)


def conditional(pool: DataFrame, windows: DataFrame, k: int = 5, components: int = 8, score: Callable[[np.ndarray], np.ndarray] | None = None, steps: int | None = None) -> DataFrame:
    """CondAttr, (window_id, phi): the windows' shapes (mean, slope and variance of each variable) are standardised, projected to 95%
    of the variance and grouped by a diagonal Gaussian mixture; a window's template is the mean of its k nearest pool windows in
    its group (the pool's mean where the group has none), and phi the drop of the score with each variable at the template.

    Windows are arrays of values, or of steps of values; steps: how many there are in arrays of values that follow each other. score: of flattened windows (n, steps * variables); the squared
    reconstruction error of the pool's principal components by default. Moments, mixture and neighbours come from the whole pool.
    """
    nested = dict(windows.dtypes)["values"].startswith("array<array")
    first = windows.select(F.size("values").alias("steps"), *([F.size(F.get("values", F.lit(0))).alias("size")] if nested else [])).first()
    if first is None:
        return windows.select(F.col("window_id").cast("long").alias("window_id"), F.lit(None).cast("array<double>").alias("phi")).limit(0)
    steps, size = (first.steps, first["size"]) if nested else (steps or 1, first.steps // (steps or 1))

    def flat(t: DataFrame) -> DataFrame:
        return t.select(F.col("window_id").cast("long").alias("window_id"), (F.flatten("values") if nested else F.col("values")).alias("values"))

    pool, windows = flat(pool), flat(windows)
    shapes = Shapes(pool, steps, size, components, score is None)
    score, coder, whole_mean = shapes.score if score is None else score, shapes.coder, shapes.mean

    def coded(batches):
        for pdf in batches:
            if len(pdf):
                code, grp = coder.codes(np.stack(pdf["values"].to_numpy()))
                yield pdf.assign(code=list(code), grp=grp)

    windows = windows.mapInPandas(coded, "window_id long, values array<double>, code array<double>, grp int").cache()
    templates = windows.select("window_id", "values").join(nearest_means(shapes.pool, windows, k), "window_id", "left")

    def run(batches):
        for pdf in batches:
            if len(pdf):
                to = np.stack([whole_mean if t is None else np.asarray(t, float) for t in pdf["template"]])
                yield pd.DataFrame({"window_id": pdf["window_id"], "phi": list(drops(score, np.stack(pdf["values"].to_numpy()), to, size))})

    return templates.mapInPandas(run, "window_id long, phi array<double>")


@dataclass(frozen=True)
class Coder:
    """Flattened windows to the codes of their shapes and the numbers of their groups."""

    steps: int
    size: int
    mean: np.ndarray
    std: np.ndarray
    basis: np.ndarray
    fit: tuple | None = None

    def code(self, x: np.ndarray) -> np.ndarray:
        return (shape_features(x.reshape(len(x), self.steps, self.size)) - self.mean) / self.std @ self.basis.T

    def group(self, code: np.ndarray) -> np.ndarray:
        return log_densities(code, *self.fit).argmax(1).astype("int32")

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = self.code(x)
        return code, self.group(code)


class Shapes:
    """What CondAttr learns of a pool of flattened windows (window_id, values): their coder, the pool with code and grp, its mean, and a
    score if one is asked for."""

    def __init__(self, pool: DataFrame, steps: int, size: int, components: int = 8, scored: bool = False):
        shape = batched(lambda x: shape_features(x.reshape(len(x), steps, size)))
        g = gram(pool.select(shape("values").alias("values")))
        n = max(g[0, 0], 1.0)
        mean = g[0, 1:] / n
        cov = g[1:, 1:] / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
        spread, vectors = np.linalg.eigh(cov / np.outer(std, std))
        spread, vectors = np.maximum(spread[::-1], 0), vectors[:, ::-1]
        keep = int(np.searchsorted(np.cumsum(spread) / max(spread.sum(), 1e-300), 0.95)) + 1
        plain = gram(pool)
        self.mean, self.score = plain[0, 1:] / n, reconstruction(plain) if scored else None
        coder = Coder(steps, size, mean, std, vectors[:, :keep].T)
        coded = pool.select("window_id", "values", batched(coder.code)("values").alias("code")).cache()
        self.coder = coder = replace(coder, fit=mixture(coded, components))
        self.pool = coded.withColumn("grp", F.get(batched(lambda c: coder.group(c)[:, None].astype(float))("code"), F.lit(0)).cast("int"))


def one_changed(score: Callable[[np.ndarray], np.ndarray], x: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """(size + 1, n): scores of flattened windows with each variable in turn as in `to` throughout, and last as they are. A scorer may
    have a shorter way to them."""
    shorter = getattr(getattr(score, "__self__", None), "one_changed", None)
    if shorter:
        return shorter(x, to, size)
    changed = np.repeat(x[None], size + 1, axis=0)
    for j in range(size):
        changed[j, :, j::size] = to[:, j::size]
    return score(changed.reshape((size + 1) * len(x), -1)).reshape(size + 1, len(x))


def drops(score: Callable[[np.ndarray], np.ndarray], x: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """(n, size): how much the score falls with each variable as in `to`. All variables of some windows are scored at once."""
    phi = np.zeros((len(x), size))
    for low in range(0, len(x), 64):
        s = one_changed(score, x[low : low + 64], to[low : low + 64], size)
        phi[low : low + 64] = (s[-1] - s[:-1]).T
    return phi


def reconstruction(g: np.ndarray, keep: float = 0.95) -> Callable[[np.ndarray], np.ndarray]:
    """The squared error that the principal components of `keep` of the variance leave, from a Gram matrix of (1, values)."""
    n = max(g[0, 0], 1.0)
    mean = g[0, 1:] / n
    values, vectors = np.linalg.eigh(g[1:, 1:] / n - np.outer(mean, mean))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    basis = vectors[:, : int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), keep)) + 1]
    rest = np.eye(len(mean)) - basis @ basis.T
    return lambda x: (((x - mean) @ rest) ** 2).sum(1)
