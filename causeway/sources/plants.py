"""Series of industrial plants: matrix files, fault batches, an expert graph, injected sensor faults."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The variables of the water plant in the order of their columns, and the edges experts drew between them.
WATER_VARIABLES = (
    "FIT101", "LIT101", "MV101", "P101", "P102", "AIT201", "AIT202", "AIT203", "FIT201", "MV201", "P201", "P202",
    "P203", "P204", "P205", "P206", "DPIT301", "FIT301", "LIT301", "MV301", "MV302", "MV303", "MV304", "P301",
    "P302", "AIT401", "AIT402", "FIT401", "LIT401", "P401", "P402", "P403", "P404", "UV401", "AIT501", "AIT502",
    "AIT503", "AIT504", "FIT501", "FIT502", "FIT503", "FIT504", "P501", "P502", "PIT501", "PIT502", "PIT503", "FIT601",
    "P601", "P602", "P603",
)
WATER_EDGES = (
    ("MV101", "FIT101"), ("P101", "FIT101"), ("FIT101", "LIT101"), ("FIT101", "FIT201"), ("FIT201", "FIT301"),
    ("FIT301", "FIT401"), ("FIT401", "FIT501"), ("FIT501", "FIT601"), ("P203", "AIT202"), ("P205", "AIT202"),
    ("MV201", "FIT201"), ("MV302", "FIT301"), ("MV304", "FIT301"), ("P302", "FIT301"), ("FIT301", "LIT301"),
    ("FIT401", "LIT401"), ("FIT501", "PIT501"), ("FIT501", "PIT502"), ("FIT501", "PIT503"),
)
# Fault batches of the chemical plant in the order of their rows, rows of the normal part and of a batch, and the
# root variable of each fault.
CHEMICAL_BATCHES = ("idv1", "idv1", "idv4", "idv4", "idv11", "idv11")
CHEMICAL_NORMAL, CHEMICAL_BATCH = 30001, 3001
CHEMICAL_ROOTS = {"idv1": 3, "idv4": 18, "idv11": 18}


def matrix_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, name, t, values) of .npy and .npz files; name is the array's within an archive. A file is one task's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                arrays = {"": held} if isinstance(held, np.ndarray) else {k: held[k] for k in held.files}
                for name, a in arrays.items():
                    a = np.asarray(a, float).reshape(len(a), -1)
                    for low in range(0, len(a), 10_000):
                        part = a[low : low + 10_000]
                        yield pd.DataFrame({"file": file, "name": name, "t": np.arange(low, low + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, name string, t long, values array<double>")


def fault_batches(rows: DataFrame, flag: str = "y") -> tuple[DataFrame, DataFrame]:
    """Rows (t, values, y) as the normal part, and as units (unit, fault, t, values, onset, roots) with t from 0 in each batch;
    the onset is the first flagged row of a batch, and a batch without one is left out."""
    normal = rows.where(F.col("t") < CHEMICAL_NORMAL)
    k = F.floor((F.col("t") - CHEMICAL_NORMAL) / CHEMICAL_BATCH).cast("int")
    batches = rows.where((F.col("t") >= CHEMICAL_NORMAL) & (k < len(CHEMICAL_BATCHES))).withColumn("k", k)
    batches = batches.withColumn("t", F.col("t") - CHEMICAL_NORMAL - F.col("k") * CHEMICAL_BATCH)
    onset = batches.groupBy("k").agg(F.min(F.when(F.col(flag) == 1, F.col("t"))).alias("onset")).where("onset is not null")
    fault = F.element_at(F.array(*map(F.lit, CHEMICAL_BATCHES)), F.col("k") + 1)
    root = F.create_map(*[F.lit(x) for pair in CHEMICAL_ROOTS.items() for x in pair])
    units = batches.join(F.broadcast(onset), "k").withColumn("fault", fault)
    return normal, units.select(F.concat_ws("_", "fault", F.concat(F.lit("b"), F.col("k") % 2)).alias("unit"), "fault", "t", "values", "onset", F.array(root[F.col("fault")]).alias("roots"))


def expert_graph(spark: SparkSession) -> DataFrame:
    """(src, dst, w) by column number."""
    at = {name: k for k, name in enumerate(WATER_VARIABLES)}
    return spark.createDataFrame([(at[a], at[b], 1.0) for a, b in WATER_EDGES], "src int, dst int, w double")


def faulty(kind: Column, x: Column, at_start: Column, since: Column, length: int, scale: float, noise: Column) -> Column:
    """x with a sensor fault: a drift that levels off, stuck at its value at the start, more variance, or a step."""
    inside = (since >= 0) & (since < length)
    moved = (
        F.when(kind == "drift", x + scale * (1 - F.exp(-since / (length / 4))))
        .when(kind == "stuck", at_start)
        .when(kind == "var", x + scale / 2 * noise)
        .when(kind == "step", x + scale)
    )
    return F.when(inside, moved).otherwise(x)


# The kinds of injected sensor faults in the order in which events take turns.
FAULT_KINDS = ("drift", "stuck", "var", "step")


def injection_plan(spark: SparkSession, steps: int, channels: int, events: int = 24, gap: int = 1200, first: float = 0.55) -> DataFrame:
    """(event, t_start, kind, vars): an event every `gap` steps from `first` of the series on, kinds in turn, every third with two
    channels. Events that would start past the end are left out."""
    rows = []
    for e in range(events):
        start = int(steps * first) + e * gap
        if start < steps:
            two = [(7 * e) % channels] + ([(7 * e + 3) % channels] if e % 3 == 2 and channels > 1 else [])
            rows.append((e, start, FAULT_KINDS[e % 4], sorted(set(two))))
    return spark.createDataFrame(rows, "event int, t_start long, kind string, vars array<int>")


def injected_plant(series: DataFrame, plan: DataFrame, length: int, scale: float, noise: Column) -> DataFrame:
    """series (t, var, x) with the plan's faults: (t, var, x, event), event null outside of all. The plan is small."""
    hit = plan.select("event", "t_start", "kind", F.explode("vars").alias("var"))
    held = series.join(F.broadcast(hit.select("event", "t_start", F.col("var"))), "var").where(F.col("t") == F.col("t_start")).select("event", "var", F.col("x").alias("at_start"))
    inside = hit.join(held, ["event", "var"]).withColumn("t", F.explode(F.sequence("t_start", F.col("t_start") + length - 1)))
    both = series.join(F.broadcast(inside), ["t", "var"], "left")
    return both.select("t", "var", F.when(F.col("event").isNull(), F.col("x")).otherwise(faulty(F.col("kind"), F.col("x"), F.col("at_start"), F.col("t") - F.col("t_start"), length, scale, noise)).alias("x"), F.col("x").alias("before"), "event")


def prefix_scored(series: DataFrame, upto: int) -> DataFrame:
    """(t, var, x) with x scored by the mean and deviation (+ 1e-8) of the first `upto` steps."""
    stats = series.where(F.col("t") < upto).groupBy("var").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + 1e-8).alias("s"))
    return series.join(F.broadcast(stats), "var").select("t", "var", ((F.col("x") - F.col("m")) / F.col("s")).alias("x"))


def inferred_roots(series: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """(unit, start, root): of each segment the variable with the largest mean |x| in its first `width` steps."""
    first = segments.select("unit", "start", F.explode(F.sequence("start", F.least(F.col("stop"), F.col("start") + width) - 1)).alias("t"))
    means = first.join(series, ["unit", "t"]).groupBy("unit", "start", "var").agg(F.avg(F.abs("x")).alias("z"))
    return means.groupBy("unit", "start").agg(F.max_by("var", F.struct("z", -F.col("var"))).alias("root"))
