"""Sums over whole tables that are one small matrix a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of a block of a series; a block also has the last steps of the one before it.
BLOCK = 4096
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def gram(windows: DataFrame) -> np.ndarray:
    """Sums of products of (1, values): one partial matrix per partition, added up by cell. D * D sums reach the driver."""

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["values"].to_numpy())
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    rows = windows.select("values").mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if rows.empty:
        return np.zeros((1, 1))
    n = rows["i"].max() + 1
    out = np.zeros((n, n))
    out[rows["i"], rows["j"]] = rows["s"]
    return out


def grouped_correlations(windows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(groups, i, j, n, r): of all pairs i < j of variables |correlation| within each group of windows. windows: the groups' columns and
    values."""
    kinds = dict(windows.dtypes)
    ddl = ", ".join(f"{g} {kinds[g]}" for g in groups) + ", i int, j int, n double, si double, sj double, sii double, sjj double, sij double"

    def partial(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(list(groups)):
                x = np.stack(part["values"].to_numpy())
                x = np.hstack([np.ones((len(x), 1)), x])
                total[key] = total.get(key, 0) + x.T @ x
        for key, g in total.items():
            i, j = np.triu_indices(len(g) - 1, 1)
            a, b = i + 1, j + 1
            named = dict(zip(groups, key if isinstance(key, tuple) else (key,), strict=True))
            yield pd.DataFrame({**named, "i": i, "j": j, "n": g[0, 0], "si": g[0, a], "sj": g[0, b], "sii": g[a, a], "sjj": g[b, b], "sij": g[a, b]})

    s = windows.select(*groups, "values").mapInPandas(partial, ddl).groupBy(*groups, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])
    n = F.col("n")
    vi, vj = F.col("sii") - F.col("si") * F.col("si") / n, F.col("sjj") - F.col("sj") * F.col("sj") / n
    r = F.abs((F.col("sij") - F.col("si") * F.col("sj") / n) / F.sqrt(vi * vj))
    return s.select(*groups, "i", "j", n.cast("long").alias("n"), F.when((vi > 1e-12 * F.col("sii")) & (vj > 1e-12 * F.col("sjj")), r).alias("r"))


def correlations(g: np.ndarray) -> np.ndarray:
    """Of a Gram matrix of (1, values); NaN where a variable is constant."""
    n = max(g[0, 0], 1.0)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(sd, sd)


def lagged_sums(series: DataFrame, max_lag: int, block: int = BLOCK) -> DataFrame:
    """(unit, i, j, lag, n, sx, sy, sxx, syy, sxy): over the steps at which both are there, sums of x = x_i(t - lag), of
    y = x_j(t) and of their squares and products, for the lags 0 .. max_lag and all pairs. series: unit, t, var, x; a step may lack
    variables, which are numbered from 0.

    Series are cut into blocks of time that overlap by max_lag steps, so every pair of steps meets within one block. A task takes
    blocks one after another, holds one as a matrix, and hands on one row for each unit, pair and lag, however many steps it
    had: what is shuffled is each value about once, and those rows. Values are centred by their variable's mean in the unit, so
    nothing cancels; correlations are those of the values.
    """
    spark = series.sparkSession
    rows = series.select("unit", F.col("t").cast("long").alias("t"), F.col("var").cast("int").alias("var"), F.col("x").cast("double").alias("x")).where("x is not null and not isnan(x)")
    means = rows.groupBy("unit", "var").agg(F.avg("x").alias("m"))
    size = (means.agg(F.max("var")).first()[0] or 0) + 1
    own = F.floor(F.col("t") / block)
    # A step that is early for the next block goes there too.
    places = F.array_distinct(F.array(own, F.floor((F.col("t") + max_lag) / block)))
    centred = rows.join(means, ["unit", "var"]).select("unit", F.explode(places).alias("block"), "t", "var", (F.col("x") - F.col("m")).alias("x"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = centred.repartition(tasks, "unit", "block").sortWithinPartitions("unit", "block", "t", "var")
    kind = dict(series.dtypes)["unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, number, held = None, None, []
        total = np.zeros((max_lag + 1, len(SUMS), size, size))
        found = False

        def add() -> None:
            """The sums of one block: its own steps are late ones, those before it early ones only."""
            nonlocal held
            t, var, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held = []
            first = number * block - max_lag
            here, values = np.zeros((block + max_lag, size)), np.zeros((block + max_lag, size))
            here[t - first, var], values[t - first, var] = 1.0, x
            late = slice(max_lag, None)
            for lag in range(max_lag + 1):
                early = slice(max_lag - lag, block + max_lag - lag)
                m, v, q = here[early].T, values[early].T, (values[early] ** 2).T
                total[lag] += np.stack([m @ here[late], v @ here[late], m @ values[late], q @ here[late], m @ values[late] ** 2, v @ values[late]])

        def told() -> pa.RecordBatch:
            lag, i, j = np.nonzero(total[:, 0] > 0)
            columns = [pa.array([unit] * len(i), kinds[0]), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(lag.astype(np.int32))]
            sums = [total[lag, k, i, j] for k in range(len(SUMS))]
            columns += [pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])]
            total[:] = 0
            return pa.RecordBatch.from_arrays(columns, names=["unit", "i", "j", "lag", *SUMS])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [f.type for f in batch.schema]
            units, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            t, var, x = (batch.column(c).to_numpy() for c in (2, 3, 4))
            at = 0
            while at < batch.num_rows:
                end = at + 1
                while end < batch.num_rows and blocks[end] == blocks[at] and units[end] == units[at]:
                    end += 1
                if held and (units[at] != unit or blocks[at] != number):
                    add()
                if found and units[at] != unit:
                    yield told()
                unit, number, found = units[at], int(blocks[at]), True
                held.append((t[at:end], var[at:end], x[at:end]))
                at = end
        if held:
            add()
            yield told()

    ddl = f"unit {kind}, i int, j int, lag int, n long, " + ", ".join(f"{c} double" for c in SUMS[1:])
    parts = dealt.mapInArrow(run, ddl)
    return parts.groupBy("unit", "i", "j", "lag").agg(*[F.sum(c).alias(c) for c in SUMS])


def lagged_correlations(series: DataFrame, max_lag: int, block: int = BLOCK) -> DataFrame:
    """(unit, i, j, lag, r, n): the correlation of x_i(t - lag) and x_j(t), null where one of them is constant."""
    s = lagged_sums(series, max_lag, block)
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    even = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    return s.select("unit", "i", "j", "lag", F.when(even, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"), "n")
