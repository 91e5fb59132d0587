"""Exact order statistics against numpy, also where every group has to be bracketed and cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import selection, statistics

SHARES = {"low": 0.0, "q1": 0.25, "half": 0.5, "q9": 0.9, "most": 0.999, "high": 1.0}


def grouped_values():
    rng = np.random.default_rng(4)
    return {
        "normal": rng.normal(size=5000), "ties": rng.integers(0, 4, 4000).astype(float), "one value": np.full(3000, 7.5), "heavy tie": np.concatenate([np.zeros(5000), rng.normal(size=500)]),
        "far apart": np.concatenate([10.0 ** rng.uniform(-300, 300, 2000), -(10.0 ** rng.uniform(-300, 300, 2000))]), "few": np.array([3.0, 1.0, 2.0, 2.0]), "single": np.array([-1.5]), None: rng.exponential(size=1000),
    }


@pytest.mark.parametrize("limit", [1_000_000, 60])
def test_quantiles_by_group(spark, limit, monkeypatch):
    if limit == 60:
        monkeypatch.setattr(selection, "SKETCH", 100)  # a poor sketch: brackets have to be put right
    groups = grouped_values()
    rows = [(g, float(v), 1) for g, values in groups.items() for v in values] + [("only nulls", None, 1), ("few", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(7)
    got = {r.g: r for r in selection.quantiles(df, "v", SHARES, ("g",), limit=limit).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, p in SHARES.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300), (g, name)


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_quantiles_of_all_rows(spark, limit):
    values = np.concatenate(list(grouped_values().values()))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    (row,) = selection.quantiles(df, F.col("v") * 2, {"a": 0.1, "b": 0.5}, limit=limit).collect()
    assert [row.a, row.b] == pytest.approx([np.quantile(2 * values, 0.1), np.quantile(2 * values, 0.5)], rel=1e-12)
    (row,) = selection.quantiles(df.where("v is null"), "v", {"a": 0.1}).collect()
    assert row.a is None


def test_many_groups_go_by_tables(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 3)
    df = spark.range(4000).select((F.col("id") % 40).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.3)).alias("m")).collect()}
    assert {r.g: r.m for r in selection.quantiles(df, "v", {"m": 0.3}, ("g",), limit=20).collect()} == pytest.approx(want)


def test_pool_statistics_beyond_the_sketch(spark):
    """120,000 values of each variable: the medians are those of numpy and not the sketch's."""
    df = spark.range(240_000).select((F.col("id") % 2).alias("var"), F.rand(3).alias("x")).withColumn("x", F.when(F.col("var") == 0, F.col("x")).otherwise(F.exp(3 * F.col("x"))))
    df = df.persist()
    values = df.toPandas()
    got = {r["var"]: r for r in statistics.pool_stats(df).collect()}
    for var, part in values.groupby("var"):
        x = part["x"].to_numpy()
        assert got[var].med == np.median(x)
        assert got[var].mad == pytest.approx(np.median(np.abs(x - np.median(x))) * 1.4826 + 1e-9, rel=1e-14)
        assert got[var].std == pytest.approx(x.std() + 1e-9)
