"""Graph repair, deletion baselines, ensembles over perturbed graphs, and interventions on simulated series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import arrays
from causeway.operators import attribution, graphs
from causeway.operators.scorers import stacked
from causeway.sources import simulators

Edges = list[tuple[int, int, float]]


def perturbed(edges: Edges, instances: int, share: float, size: int, seed: int) -> list[Edges]:
    """Deletions and rewirings in turn; a graph has few edges, so draws are made at once and hashed by place."""
    out = []
    for m in range(instances):
        rng = np.random.default_rng([seed, m])
        keep = rng.random(len(edges)) >= share
        if m % 2 == 0:
            out.append([e for e, k in zip(edges, keep, strict=True) if k])
            continue
        rest = [e for e, k in zip(edges, keep, strict=True) if k]
        at = {v: p for p, v in enumerate(graphs.topological_order([e[:2] for e in rest], range(size)))}
        moved = [e if at[e[0]] < at[e[1]] else (e[1], e[0], e[2]) for e, k in zip(edges, keep, strict=True) if not k]
        out.append(list({e[:2]: e for e in [*rest, *moved]}.values()))
    return out


def tops(z: DataFrame, edges: Edges, size: int) -> DataFrame:
    return z.select("window_id", attribution.proprank(F.col("phi"), edges, size).alias("phi"))


def mean_consistency(z: DataFrame, edges: Edges, others: list[Edges], size: int) -> float:
    """Mean overlap of the top three of one graph with those of the others: one job."""
    return attribution.graph_overlaps(z, edges, [None], others, size)[0]


def repaired(z: DataFrame, edges: Edges, size: int, instances: int = 6, most: float = 0.3, least: float = 0.0) -> tuple[Edges, list[tuple[int, int, float]]]:
    """The graph without the edges whose removal raises consistency by more than `least`, at most a share `most` of them. Every
    edge is tried, all in one job."""
    others = perturbed(edges, instances, 0.15, size, 42)
    base, *without = attribution.graph_overlaps(z, edges, [None, *[(s, d, 0.0) for s, d, _ in edges]], others, size)
    gain = [(e[0], e[1], c - base) for e, c in zip(edges, without, strict=True)]
    worst = sorted((g for g in gain if g[2] > least), key=lambda g: (-g[2], g[0], g[1]))[: int(len(edges) * most)]
    gone = {g[:2] for g in worst}
    return [e for e in edges if e[:2] not in gone], gain


def deletion_baselines(edges: Edges, budget: int) -> dict[str, Edges]:
    """The graph without its `budget` edges of most summed degree, and without those of most confidence."""
    degree: dict[int, int] = {}
    for s, d, _ in edges:
        degree[s] = degree.get(s, 0) + 1
        degree[d] = degree.get(d, 0) + 1
    by_degree = sorted(edges, key=lambda e: (-(degree[e[0]] + degree[e[1]]), e[0], e[1]))
    by_confidence = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    return {"degree": by_degree[budget:], "confidence": by_confidence[budget:]}


#: Windows whose scores are ranked at once: a comparison of all pairs of variables each.
RANKED = 500


def midranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 along the last axis, the least first; ties get the mean of theirs."""
    below = (x[..., None, :] < x[..., :, None]).sum(-1)
    return below + ((x[..., None, :] == x[..., :, None]).sum(-1) + 1) / 2


def combined(phi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phi: (instances, windows, variables). Per window the mean of the shares over instances, that of their scaled ranks, and the
    mean weighted by the largest share."""
    a = np.abs(phi) + 1e-12
    p = a / a.sum(2, keepdims=True)
    ranks = np.concatenate([midranks(p[:, k : k + RANKED]) for k in range(0, max(p.shape[1], 1), RANKED)], axis=1)
    weight = p.max(2, keepdims=True)
    return p.mean(0), ((ranks - 1) / (p.shape[2] - 1)).mean(0), (weight * p).sum(0) / weight.sum(0)


def listed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def ensembles(instances: DataFrame, keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Per window: mean of the shares over instances, mean of their scaled ranks, and the mean weighted by the largest share. Scores
    that are null or hold nulls take no part. A window's instances, which are few, meet as arrays; variables don't become rows."""
    fine = instances.where("phi is not null and forall(phi, x -> x is not null)")
    all_ = fine.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("instance", "phi"))), lambda x: x["phi"]).alias("_all"))

    @F.pandas_udf("mean array<double>, rank array<double>, weighted array<double>")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = [[c[0] for c in combined(np.stack(list(r))[:, None])] for r in rows]
        return pd.DataFrame(out, columns=["mean", "rank", "weighted"])

    return all_.withColumn("_e", run("_all")).select(*keys, "_e.mean", "_e.rank", "_e.weighted")


def graph_ensembles(z: DataFrame, graphs_: list[Edges], size: int) -> DataFrame:
    """The columns of z but phi, with the ensembles of PropRank over some graphs: all graphs are told where the window is, in one
    pass. Windows without scores, or with scores that are no numbers, are left out."""
    kernels = [graphs.kernel(edges, size) for edges in graphs_]
    kept = [c for c in z.columns if c != "phi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, RANKED) for k in range(0, batch.num_rows, RANKED)):
                x = stacked(part.column(len(kept)))
                phi = np.stack([(x / (x.max(1, keepdims=True) + 1e-9)) @ k for k in kernels])
                fine = ~np.isnan(phi).any((0, 2))
                columns = [c.filter(pa.array(fine)) for c in part.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*columns, *map(listed, combined(phi[:, fine]))], [*kept, "mean", "rank", "weighted"])

    kinds = dict(z.dtypes)
    told = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", mean array<double>, rank array<double>, weighted array<double>"
    return z.where("phi is not null").select(*kept, "phi").mapInArrow(run, told)


def intervention_scores(spark, units: int, nodes: int = 8, steps: int = 600) -> DataFrame:
    """(unit, tag, repair): how much of an injected deviation goes when variables are held at their normal course from the start
    of the episode on: the root itself (oracle), the three most deviating (top3), or three at random. One task a unit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for unit in pdf["unit"]:
                rng = np.random.default_rng([21, int(unit)])
                a = simulators.random_dag(nodes, 0.3, rng)
                w, noise = 0.6 * a / np.maximum(a.sum(0), 1), rng.normal(0, 0.1, (steps, nodes))
                root, start = int(rng.integers(nodes)), steps // 2

                def course(injected: bool, held: set[int], normal: np.ndarray | None, w=w, noise=noise, root=root, start=start) -> np.ndarray:
                    x = np.zeros((steps, nodes))
                    for t in range(1, steps):
                        x[t] = np.tanh(x[t - 1] @ w) + noise[t]
                        if injected and t >= start:
                            x[t, root] += 1.0
                        if normal is not None and t >= start:
                            for v in held:
                                x[t, v] = normal[t, v]
                    return x

                normal = course(False, set(), None)
                bad = course(True, set(), None)
                med = np.median(normal[:start], 0)
                mad = np.median(np.abs(normal[:start] - med), 0) * 1.4826 + 1e-9
                score = lambda x: float((((x[start : start + 16] - med) / mad) ** 2).sum())
                z = np.abs((bad[start : start + 16] - med) / mad).mean(0)
                sets = {"oracle": {root}, "top3": set(np.argsort(-z, kind="stable")[:3].tolist()), "random": set(rng.choice(nodes, 3, replace=False).tolist())}
                for tag, held in sets.items():
                    rows.append((int(unit), tag, (score(bad) - score(course(True, held, normal))) / (abs(score(bad) - score(normal)) + 1e-9)))
            yield pd.DataFrame(rows, columns=["unit", "tag", "repair"])

    return simulators.scm_units(spark, units).repartition(units).mapInPandas(run, "unit int, tag string, repair double")
