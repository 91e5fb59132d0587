"""Reliability predictors: features, folds, fits on pyspark.ml, recalibration."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.sources import scratch

# The window features, by name space.
FEATURES = {
    "g_": ("n_nodes", "n_edges", "density", "indeg_entropy", "outdeg_entropy", "indeg_max", "outdeg_max", "indeg_mean", "indeg_std", "sink_frac", "source_frac"),
    "c_": ("cons_topk3", "cons_top1"),
    "a_": ("top1_share", "top3_share", "attr_entropy", "top_gap", "top_ratio"),
    "s_": ("score_margin_rel", "score_z", "score_exceed99"),
    "d_": ("dev_entropy", "dev_top1", "dev_top3"),
}


#: Rounds of boosting, trees of the forest and passes of the network.
ITERATIONS = {"gbt": 300, "lr": 100, "rf": 300, "mlp": 400}


def model(kind: str, features: int, iterations: int | None = None, seed: int = 0):
    iterations = ITERATIONS.get(kind, 0) if iterations is None else iterations
    options = {"labelCol": "label", "featuresCol": "features"}
    if kind == "gbt":
        return GBTClassifier(maxDepth=4, maxIter=iterations, stepSize=0.08, seed=seed, **options)
    if kind == "lr":
        return LogisticRegression(maxIter=iterations, **options)
    if kind == "rf":
        return RandomForestClassifier(numTrees=iterations, maxDepth=8, seed=seed, **options)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[features, 64, 32, 2], maxIter=iterations, seed=seed, **options)
    raise ValueError(f"unknown model {kind}")


def with_missing_flags(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """NaN as null, and a flag column for every feature that can be missing (graph-free rows have no g_ features)."""
    out = rows.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns if c.startswith("g_")}
    return out.withColumns(flags) if flags else out, [*columns, *flags]


def pipeline(kind: str, columns: list[str], iterations: int | None = None) -> Pipeline:
    """Median imputation and scaling are fitted inside, on training rows alone."""
    filled = [f"{c}__f" for c in columns]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True), model(kind, len(columns), iterations),
    ])


def grouped_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """A fold per group, balanced: groups by falling size are dealt back and forth. Groups are counted, not gathered."""
    from pyspark.sql import Window

    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1
    turn, at = F.floor(place / folds), place % folds
    return rows.join(sizes.select(group, F.when(turn % 2 == 0, at).otherwise(folds - 1 - at).cast("int").alias("fold")), group)


def gathered(rows: DataFrame) -> DataFrame:
    """rows as a cached table of as many partitions as there are cores, each in the order of its keys. A fit makes hundreds of passes over
    a few numbers a row; every pass goes over the lineage once more, sends something for each partition, and a forest writes its
    histograms for each. So what a fit moves hangs on the cores, not on how many shuffle partitions or files the rows came in."""
    spark = rows.sparkSession
    cores, path = spark.sparkContext.defaultParallelism, scratch.fresh_dir(spark, "rows")
    rows.repartition(cores, "key").sortWithinPartitions("key").write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).coalesce(cores).cache()


def out_of_fold(rows: DataFrame, columns: list[str], kind: str, folds: int, iterations: int | None = None) -> DataFrame:
    """key, label, fold and the probability from the model that didn't see the fold; folds with one class in training are left out.
    The folds are fitted side by side: a pass over the rows is short, and a fit's passes wait for each other."""
    rows = rows if rows.is_cached else gathered(rows)
    counts = {r.fold: (r.n, r.p) for r in rows.groupBy("fold").agg(F.count("label").alias("n"), F.sum("label").alias("p")).collect()}

    def fit(k: int):
        n, p = (sum(c[i] or 0 for f, c in counts.items() if f != k) for i in (0, 1))
        return pipeline(kind, columns, iterations).fit(rows.where(F.col("fold") != k)) if 0 < p < n else None

    with ThreadPool(folds) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(folds))
    out = None
    for k, fitted in enumerate(models):
        if fitted is None:
            continue
        part = fitted.transform(rows.where(F.col("fold") == k)).select("key", "label", "fold", vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def few_shot(rows: DataFrame, group: str, share: float, draw: Column) -> tuple[DataFrame, DataFrame]:
    """Calibration and test rows by whole groups, so that no window is on both sides."""
    picked = rows.select(group).distinct().where(draw < share)
    return rows.join(picked, group, "left_semi"), rows.join(picked, group, "left_anti")


def selected(folds: list[str], prefixes: str) -> list[str]:
    """The columns of some feature groups, for ablations."""
    return [c for c in folds if c[:1] in prefixes and c[1:2] == "_"]
