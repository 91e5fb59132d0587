"""Histogram gradient boosting of many models at once, each on all of its labelled rows: tasks of one job where the rows are few,
else passes over the rows where they are, all models in each, after which a task hands on sums by node, feature and bin."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many labelled rows each model is fitted by one task, which has them all; of more rows a task has its own part alone.
AT_ONCE = 200_000
#: Bins of a feature; one more is for missing values.
BINS = 255
#: Rows of a block, models of a run of passes, and rounds after which the blocks' lineage is cut.
BLOCK, SIDE_BY_SIDE, CUT = 32_768, 32, 10


def between(known: np.ndarray) -> np.ndarray:
    return (known[1:] + known[:-1]) / 2


def thresholds(x: np.ndarray) -> list[np.ndarray]:
    """For each feature the values between its bins: midpoints of neighbours, or quantiles where there are more than BINS of them."""
    out = []
    for column in x.T:
        known = np.unique(column[~np.isnan(column)])
        if len(known) > BINS:
            known = np.unique(np.quantile(column[~np.isnan(column)], np.linspace(0, 1, BINS)))
        out.append(between(known))
    return out


def bins_of(x: np.ndarray, cuts: list[np.ndarray], kind: type = np.int16) -> np.ndarray:
    """(rows, features): numbers of bins; BINS for a missing value."""
    out = np.empty(x.shape, kind)
    for k, c in enumerate(cuts):
        out[:, k] = np.where(np.isnan(x[:, k]), BINS, np.searchsorted(c, x[:, k], "right"))
    return out


def bits(n: int) -> int:
    """Gradients count in units of 2 to the minus this: whole numbers, whose sums over n rows are exact in any order."""
    return min(40, 52 - int(n).bit_length())


def slopes(f: np.ndarray, y: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss, in units."""
    p = 1 / (1 + np.exp(-f))
    return np.rint(np.ldexp(p - y, unit)), np.rint(np.ldexp(p * (1 - p), unit))


def sums_by_bin(binned: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(3, nodes, features, bins): rows, gradients and curvatures, where node numbers the rows' nodes from 0."""
    features, width = binned.shape[1], BINS + 1
    out, start = np.empty((3, nodes, features, width)), node * width
    for k in range(features):
        key = start + binned[:, k]
        for s, w in zip(out, (None, g, h), strict=True):
            s[:, k] = np.bincount(key, w, nodes * width).reshape(nodes, width)
    return out


def choose(sums: np.ndarray, unit: int, least: int) -> tuple[np.ndarray, ...]:
    """Of each node of sums_by_bin: whether it is split, by which feature, after which bin, whether missing values go left; and the rows,
    gradients and curvatures (3, nodes) that go left and of the whole."""
    nodes, features, width = sums.shape[1:]
    told = (sums[0], *np.ldexp(sums[1:], -unit))
    whole = [s[:, :1].sum(2, keepdims=True)[..., None] for s in told]  # every feature adds up to the same
    lefts = [np.stack([(c := np.cumsum(s[..., :-1], 2)), c + s[..., -1:]], axis=3) for s in told]
    rights = [w - lo for w, lo in zip(whole, lefts, strict=True)]
    gain = lefts[1] ** 2 / (lefts[2] + 1e-12) + rights[1] ** 2 / (rights[2] + 1e-12) - whole[1] ** 2 / (whole[2] + 1e-12)
    fine = (lefts[0] >= least) & (rights[0] >= least) & (lefts[2] > 1e-3) & (rights[2] > 1e-3)
    gain = np.where(fine, gain, -np.inf).reshape(nodes, -1)
    best = gain.argmax(1)
    where = np.unravel_index(best, (features, width - 1, 2))
    at = np.arange(nodes)
    return gain[at, best] > 1e-9, where[0], where[1], where[2] == 1, np.stack([s.reshape(nodes, -1)[at, best] for s in lefts]), np.stack([s.reshape(nodes) for s in whole])


class Boosted:
    """Trees of `depth` levels on the gradient and curvature of the log loss. Missing values go to the side that gains more."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.08, depth: int = 4, least: int = 20):
        self.cuts, self.depth = thresholds(x), depth
        self.base, self.unit = self.log_odds(float(y.sum()), len(y)), bits(len(y))
        binned = self.bins(x)
        own = self.distinct(binned)  # of features with equal bins the first is always the one that splits
        binned = np.asfortranarray(binned[:, own])
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(rounds):
            tree, node = self.grow(binned, *slopes(f, y, self.unit), rate, least)
            self.trees.append(self.renamed(tree, own))
            f += tree[3][node]

    @classmethod
    def of(cls, cuts: list[np.ndarray], depth: int, base: float, trees: list[tuple]) -> Boosted:
        """A model that was fitted elsewhere."""
        made = cls.__new__(cls)
        made.cuts, made.depth, made.base, made.trees = cuts, depth, base, trees
        return made

    @staticmethod
    def log_odds(positive: float, n: int) -> float:
        share = min(max(positive / max(n, 1), 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share)))

    @staticmethod
    def renamed(tree: tuple, own: np.ndarray) -> tuple:
        return (np.where(tree[0] >= 0, own[tree[0]], -1), *tree[1:])

    def bins(self, x: np.ndarray) -> np.ndarray:
        return bins_of(x, self.cuts)

    @staticmethod
    def distinct(binned: np.ndarray) -> np.ndarray:
        """The features whose bins are not those of an earlier one: a graph's features are one number in all of a method's rows."""
        return firsts(digests(binned))

    def grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float, least: int) -> tuple:
        """(feature, bin, missing goes left, value) by node, the children of node i being 2 i + 1 and 2 i + 2; and each row's leaf."""
        n, size = len(binned), 2 ** (self.depth + 1) - 1
        feature, cut, left = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool)
        node = np.zeros(n, np.int64)
        open_ = np.ones(n, bool)  # rows whose node may still be split
        for level in range(self.depth):
            first, nodes = 2**level - 1, 2**level
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            split, *found = choose(sums_by_bin(binned[rows], node[rows] - first, nodes, g[rows], h[rows]), self.unit, least)
            at = first + np.flatnonzero(split)
            feature[at], cut[at], left[at] = (v[split] for v in found[:3])
            open_ &= feature[node] >= 0
            node[open_] = self.step(binned[open_], node[open_], feature, cut, left)
        value = [np.ldexp(np.bincount(node, s, size), -self.unit) for s in (g, h)]
        return (feature, cut, left, -rate * value[0] / (value[1] + 1e-12)), node

    @staticmethod
    def step(binned: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
        b = binned[np.arange(len(node)), feature[node]]
        return 2 * node + np.where(np.where(b == BINS, left[node], b <= cut[node]), 1, 2)

    @staticmethod
    def walk(binned: np.ndarray, tree: tuple, depth: int) -> np.ndarray:
        """Each row's node after at most `depth` steps."""
        feature, cut, left, _ = tree
        bins, nodes = np.arange(BINS + 1), np.arange(len(feature))[:, None]
        to = 2 * nodes + np.where(np.where(bins == BINS, left[:, None], bins <= cut[:, None]), 1, 2)
        to = np.where(feature[:, None] >= 0, to, nodes).ravel()  # by node and bin; a leaf is its own next node
        of, flat, row = np.maximum(feature, 0), np.ascontiguousarray(binned).ravel(), np.arange(len(binned)) * binned.shape[1]
        node = np.zeros(len(binned), np.int64)
        for _ in range(depth):
            node = to.take(node * (BINS + 1) + flat.take(row + of.take(node)))
        return node

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned, f = self.bins(x), np.full(len(x), self.base)
        for tree in self.trees:
            f += tree[3][self.walk(binned, tree, self.depth)]
        return 1 / (1 + np.exp(-f))


def digests(binned: np.ndarray) -> list[bytes]:
    return [hashlib.sha256(np.ascontiguousarray(binned[:, k])).digest() for k in range(binned.shape[1])]


def firsts(names: list) -> np.ndarray:
    """Places of the names that are not those of an earlier place."""
    first: dict = {}
    for k, name in enumerate(names):
        first.setdefault(name, k)
    return np.array(sorted(first.values()), np.int64)


# ---- passes over rows that no task has all of


class Growing:
    """A tree that is grown level by level from sums over all rows. Of two children the smaller one is summed, the other is what is left."""

    def __init__(self, unit: int, rate: float, depth: int, least: int):
        size = 2 ** (depth + 1) - 1
        self.unit, self.rate, self.least = unit, rate, least
        self.feature, self.cut, self.left = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool)
        self.value, self.held, self.asked = np.zeros(size), {}, np.zeros(1, np.int64)

    @property
    def tree(self) -> tuple:
        return self.feature, self.cut, self.left, self.value

    def add(self, sums: np.ndarray) -> None:
        """sums: of the nodes asked for. The children of the nodes that are split are asked for next."""
        known = {}
        for k, node in enumerate(self.asked):
            known[node] = sums[:, k]
            if node:
                other = node + 1 if node % 2 else node - 1
                known[other] = self.held[(node - 1) // 2] - sums[:, k]
        nodes, asked = np.array(sorted(known), np.int64), []
        self.held = {}
        if len(nodes):
            split, feature, cut, left, goes, whole = choose(np.stack([known[n] for n in nodes], axis=1), self.unit, self.least)
            self.tell(nodes, whole)
            for k in np.flatnonzero(split):
                node = nodes[k]
                self.feature[node], self.cut[node], self.left[node], self.value[node] = feature[k], cut[k], left[k], 0
                self.tell(np.array([2 * node + 1, 2 * node + 2]), np.stack([goes[:, k], whole[:, k] - goes[:, k]], axis=1))
                self.held[node] = known[node]
                asked.append(2 * node + (1 if 2 * goes[0, k] <= whole[0, k] else 2))
        self.asked = np.array(asked, np.int64)

    def tell(self, nodes: np.ndarray, whole: np.ndarray) -> None:
        self.value[nodes] = -self.rate * whole[1] / (whole[2] + 1e-12)


def added(parts: list[list]) -> list:
    """Sums of several tasks' lists of arrays, in place; None is nothing."""
    out = list(parts[0])
    for part in parts[1:]:
        for k, s in enumerate(part):
            if s is not None:
                out[k] = s if out[k] is None else np.add(out[k], s, out=out[k])
    return out


def level_sums(blocks: Iterator[list], trees: list[tuple], asked: list[np.ndarray], units: list[int], level: int) -> Iterator[list]:
    total = None
    for block in blocks:
        sums = []
        for (binned, y, f), tree, nodes, unit in zip(block, trees, asked, units, strict=True):
            if not len(nodes) or not len(y):
                sums.append(None)
                continue
            if level:
                place = np.full(len(tree[0]), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[Boosted.walk(binned, tree, level)]
                rows = np.flatnonzero(at >= 0)
                binned, at, y, f = binned[rows], at[rows], y[rows], f[rows]
            else:
                at = np.zeros(len(y), np.int64)
            sums.append(sums_by_bin(binned, at, len(nodes), *slopes(f, y, unit)))
        total = sums if total is None else added([total, sums])
    if total is not None:
        yield total


def moved(block: list, trees: list[tuple], depth: int) -> list:
    return [(binned, y, f + tree[3][Boosted.walk(binned, tree, depth)]) for (binned, y, f), tree in zip(block, trees, strict=True)]


def marked(rows: DataFrame, columns: list[str], training: dict[str, Column]) -> DataFrame:
    """The labelled rows of any model: label, features as doubles, and the models' numbers as bits of one long."""
    every = None
    for k, of in enumerate(training.values()):
        bit = F.when(of, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        every = bit if every is None else every.bitwiseOR(bit)
    return rows.where("label is not null").select(F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns], every.alias("_models")).where("_models <> 0")


def members(models: np.ndarray, n: int) -> np.ndarray:
    return (models[:, None] >> np.arange(n)) & 1 == 1


def cut_points(table: DataFrame, columns: list[str], n: int, parts: int) -> list[list[np.ndarray]]:
    """`thresholds` of each of n models over all of its rows, by model and feature. Values with their counts are put in order over all
    tasks; one pass counts them part by part, another finds those of the ranks that the quantiles lie between."""
    long = table.select("_models", F.posexplode(F.array(*columns)).alias("k", "v")).where("v is not null and not isnan(v)")
    counts = long.groupBy("k", "v", "_models").agg(F.count("*").alias("n"))
    order = counts.repartitionByRange(parts, "k", "v").sortWithinPartitions("k", "v").select(F.spark_partition_id().alias("part"), "k", "v", "_models", "n").persist(StorageLevel.MEMORY_AND_DISK)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        few: dict[tuple, np.ndarray | None] = {}
        for pdf in batches:
            for (part, k), of in pdf.groupby(["part", "k"]):
                inside, v = members(of["_models"].to_numpy(), n), of["v"].to_numpy()
                total[part, k] = total.get((part, k), 0) + (inside * of["n"].to_numpy()[:, None]).sum(0)
                for m in range(n):
                    if (seen := few.get((part, k, m), np.empty(0))) is not None:
                        seen = np.union1d(seen, v[inside[:, m]])
                        few[part, k, m] = seen if len(seen) <= BINS else None
        if total:
            yield pd.DataFrame([(part, k, m, int(t[m]), few[part, k, m]) for (part, k), t in total.items() for m in range(n)], columns=["part", "k", "m", "n", "few"])

    found = order.mapInPandas(count, "part int, k int, m int, n long, few array<double>").toPandas().sort_values("part")
    known: dict[tuple[int, int], np.ndarray] = {}
    ranks: dict[tuple[int, int], tuple] = {}
    before: dict[tuple[int, int, int], int] = {}
    for (k, m), of in found.groupby(["k", "m"]):
        before.update({(part, k, m): at for part, at in zip(of["part"], of["n"].cumsum() - of["n"], strict=True)})
        distinct = None if of["few"].isna().any() else np.unique(np.concatenate(of["few"].to_numpy()))
        if distinct is not None and len(distinct) <= BINS:
            known[k, m] = distinct
            continue
        at = (int(of["n"].sum()) - 1) * np.linspace(0, 1, BINS)
        low = np.floor(at).astype(np.int64)
        ranks[k, m] = (at - low, low, np.minimum(low + 1, int(of["n"].sum()) - 1))
    wanted = {key: np.unique(np.concatenate(r[1:])) for key, r in ranks.items()}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            out = []
            for (part, k), of in pdf.groupby(["part", "k"]):
                v = of["v"].to_numpy()
                start = so_far[part, k] if (part, k) in so_far else np.array([before[part, k, m] for m in range(n)])
                upto = start + np.cumsum(members(of["_models"].to_numpy(), n) * of["n"].to_numpy()[:, None], axis=0)
                for m in range(n):
                    if (k, m) in wanted:
                        r = wanted[k, m]
                        r = r[np.searchsorted(r, start[m]) : np.searchsorted(r, upto[-1, m])]
                        out += zip([k] * len(r), [m] * len(r), r.tolist(), v[np.searchsorted(upto[:, m], r, "right")].tolist(), strict=True)
                so_far[part, k] = upto[-1]
            yield pd.DataFrame(out, columns=["k", "m", "r", "v"])

    if wanted:
        values = order.mapInPandas(find, "k int, m int, r long, v double").toPandas().sort_values("r")
        for (k, m), of in values.groupby(["k", "m"]):
            t, low, high = ranks[k, m]
            a, b = (of["v"].to_numpy()[np.searchsorted(of["r"].to_numpy(), r)] for r in (low, high))
            known[k, m] = np.unique(np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t)))  # as np.quantile has it
    order.unpersist()
    return [[between(known.get((k, m), np.empty(0))) for k in range(len(columns))] for m in range(n)]


def binned_blocks(table: DataFrame, columns: list[str], cuts: list[list[np.ndarray]], parts: int) -> RDD:
    """Blocks of at most BLOCK rows and a batch: for each model its rows' bins and labels. They are dealt out to `parts` tasks."""
    held = table.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0

        def block() -> pd.DataFrame:
            x, y, models = (np.concatenate(p) for p in zip(*waiting, strict=True))
            inside = members(models, len(held.value))
            return pd.DataFrame({"block": [pickle.dumps([(bins_of(x[at], c, np.uint8), y[at]) for c, at in zip(held.value, inside.T, strict=True)])]})

        for pdf in batches:
            waiting.append((pdf[columns].to_numpy(float), pdf["label"].to_numpy(), pdf["_models"].to_numpy()))
            n += len(pdf)
            if n >= BLOCK:
                yield block()
                waiting, n = [], 0
        if n:
            yield block()

    return table.mapInPandas(run, "block binary").repartition(parts).rdd.map(lambda r: pickle.loads(r.block))


def passed(table: DataFrame, columns: list[str], sizes: list[tuple[int, float]], rounds: int = 300, rate: float = 0.08, depth: int = 4, least: int = 20) -> list[Boosted]:
    """The models that `Boosted` makes of the rows of `marked`, which has sizes (rows, positive ones): all are grown in the same passes."""
    parts = table.sparkSession.sparkContext.defaultParallelism
    cuts = cut_points(table, columns, len(sizes), 4 * parts)
    blocks = binned_blocks(table, columns, cuts, parts).persist(StorageLevel.MEMORY_AND_DISK)
    alike = blocks.mapPartitions(lambda part: [[digests(b) for b, _ in block] for block in part]).collect()
    own = [firsts(list(zip(*[block[m] for block in alike], strict=True))) for m in range(len(sizes))]
    bases, units = [Boosted.log_odds(p, n) for n, p in sizes], [bits(n) for n, _ in sizes]
    state = blocks.map(lambda block: [(b[:, k], y, np.full(len(y), f)) for (b, y), k, f in zip(block, own, bases, strict=True)]).persist(StorageLevel.MEMORY_AND_DISK)
    state.localCheckpoint()
    trees: list[list[tuple]] = [[] for _ in sizes]
    gone = [blocks]
    for done in range(rounds):
        growing = [Growing(unit, rate, depth, least) for unit in units]
        for level in range(depth):
            asked, grown = [g.asked for g in growing], [g.tree for g in growing]
            if not any(map(len, asked)):
                break
            sums = added(state.mapPartitions(lambda part, grown=grown, asked=asked, level=level: level_sums(part, grown, asked, units, level)).collect())
            while gone:
                gone.pop().unpersist()
            for g, s in zip(growing, sums, strict=True):
                if s is not None:
                    g.add(s)
        grown = [g.tree for g in growing]
        for kept, tree, k in zip(trees, grown, own, strict=True):
            kept.append(Boosted.renamed(tree, k))
        if done + 1 < rounds:
            gone.append(state)
            state = state.map(lambda block, grown=grown: moved(block, grown, depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if (done + 1) % CUT == 0:
                state.localCheckpoint()
    for rdd in (*gone, state):
        rdd.unpersist()
    return [Boosted.of(c, depth, base, kept) for c, base, kept in zip(cuts, bases, trees, strict=True)]


# ---- models of tables


def labelled(rows: DataFrame, columns: list[str], also: list[str], key: str = "key") -> pd.DataFrame:
    """All labelled rows, on the driver: for tables of up to AT_ONCE."""
    return rows.where("label is not null").select(key, "label", *columns, *also).toPandas()


def sizes(rows: DataFrame, training: dict[str, Column]) -> dict[str, tuple[int, float]]:
    """The labelled rows of each model, and how many of them are positive."""
    if not training:
        return {}
    of = [F.coalesce(c, F.lit(False)) for c in training.values()]
    both = [f for k, c in enumerate(of) for f in (F.count(F.when(c, 1)).alias(f"n{k}"), F.coalesce(F.sum(F.when(c, F.col("label"))), F.lit(0)).cast("double").alias(f"p{k}"))]
    told = rows.where("label is not null").agg(*both).first()
    return {name: (told[f"n{k}"], told[f"p{k}"]) for k, name in enumerate(training)}


def fitted(rows: DataFrame, columns: list[str], training: dict[str, Column], at_once: int = AT_ONCE, **options) -> dict[str, Boosted]:
    """A model for each name of `training`, fitted on all labelled rows that its condition holds for."""
    if len(training) > SIDE_BY_SIDE:
        names, out = list(training), {}
        for low in range(0, len(names), SIDE_BY_SIDE):
            out |= fitted(rows, columns, {n: training[n] for n in names[low : low + SIDE_BY_SIDE]}, at_once, **options)
        return out
    if not training:
        return {}
    names, spark = list(training), rows.sparkSession
    table = marked(rows, columns, training).cache()
    if table.count() > at_once:
        of = sizes(table, {name: F.col("_models").bitwiseAND(F.lit(1 << k)) != 0 for k, name in enumerate(names)})
        models = passed(table, columns, [of[n] for n in names], **options)
        table.unpersist()
        return dict(zip(names, models, strict=True))
    whole = table.toPandas()
    table.unpersist()
    held = spark.sparkContext.broadcast((whole[columns].to_numpy(float), whole["label"].to_numpy(float), members(whole["_models"].to_numpy(), len(names))))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, inside = held.value
        for pdf in batches:
            for k in pdf["id"]:
                yield pd.DataFrame({"k": [k], "model": [pickle.dumps(Boosted(x[inside[:, k]], y[inside[:, k]], **options))]})

    models = spark.range(0, len(names), 1, len(names)).mapInPandas(fit, "k long, model binary").collect()
    held.destroy()
    return {names[r.k]: pickle.loads(r.model) for r in models}


def predicted(rows: DataFrame, columns: list[str], models: dict[str, Boosted], by: str) -> DataFrame:
    """rows with p, the probability of the model that the column `by` names; rows of no model go. Models are some 300 kB each."""
    held = rows.sparkSession.sparkContext.broadcast(models)
    kept = [c for c in rows.columns if c not in columns]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby(by):
                if name in held.value:
                    yield part[kept].assign(p=held.value[name].probability(part[columns].to_numpy(float)))

    return rows.select(*kept, *columns).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", p double")


def held_out(
    rows: DataFrame, columns: list[str], fold: str, apart: str | None = None, least_train: int = 30, least_test: int = 5, only: Column | None = None, within: str | None = None, at_once: int = AT_ONCE, **options
) -> DataFrame:
    """rows with p from the model that saw no row of their fold, nor any that shares the fold's value of `apart`; within: a model
    sees the rows alone that share the fold's value of it; only: the rows that may be trained on at all. Folds with one class, or too few
    rows, on either side are left out."""
    rows = rows.cache()  # the counts, the models and the scores are passes over it
    tested = rows.where("label is not null") if only is None else rows.where("label is not null and part = 'test'")
    more = [F.min(c).alias(to) for c, to in ((apart, "apart"), (within, "within")) if c]
    training = {}
    for c in tested.groupBy(fold).agg(F.count("*").alias("n"), F.sum("label").alias("p"), *more).where(F.col(fold).isNotNull()).collect():
        if c.n >= least_test and 0 < c.p < c.n:
            of = ~F.col(fold).eqNullSafe(F.lit(c[fold]))
            of = of & ~F.col(apart).eqNullSafe(F.lit(c["apart"])) if apart else of
            of = of & F.col(within).eqNullSafe(F.lit(c["within"])) if within else of
            training[c[fold]] = of if only is None else of & only
    enough = [name for name, (n, p) in sizes(rows, training).items() if n >= least_train and 0 < p < n]
    return predicted(tested, columns, fitted(rows, columns, {name: training[name] for name in enough}, at_once, **options), fold)
