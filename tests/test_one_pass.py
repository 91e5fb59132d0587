"""Costly columns are computed once a row, however often a query goes over its result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import scorers, statistics


def test_windows_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class First:
        def scores(self, x):
            seen.add(len(x))
            return x[:, 0]

    rows = spark.range(400).select((F.col("id") % 2).alias("y"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("values"))
    s = scorers.scored(rows, {"a": First(), "b": First()})
    found = statistics.auroc(s, "y", "s", ("scorer",)).collect()
    assert {r.scorer: r.auroc for r in found} == {"a": pytest.approx(0.5025), "b": pytest.approx(0.5025)}
    assert seen.value == 2 * 400


def test_samples_are_drawn_once(spark, monkeypatch):
    """One pass: each window's id is hashed once a draw; the samples are the least hashes, in their order."""
    seen, plain = spark.sparkContext.accumulator(0), scorers.mixed_bits

    def counted(ids, seed):
        seen.add(len(ids))
        return plain(ids, seed)

    monkeypatch.setattr(scorers, "mixed_bits", counted)
    pool = spark.range(3000).select(F.col("id").alias("window_id"), F.array(F.col("id").cast("double"), F.col("id") * 2.0).alias("values"))
    got = scorers.samples(pool, 3, 40)
    for d, part in enumerate(got):
        want = np.argsort(plain(np.arange(3000), d), kind="stable")[:40]
        assert np.array_equal(part, np.stack([want, want * 2.0], axis=1))
    assert seen.value == 3 * 3000


def test_windows_of_unequal_length_are_refused(spark):
    import pyarrow as pa

    assert np.array_equal(scorers.stacked(pa.array([[1.0, None], [3.0, 4.0]])), [[1, np.nan], [3, 4]], equal_nan=True)
    for rows in ([[1.0], [2.0, 3.0]], [[1.0], None]):
        with pytest.raises(ValueError, match="one length"):
            scorers.stacked(pa.array(rows))


def test_ensembles_are_told_where_the_window_is(spark):
    """Of three graphs in one pass without a shuffle, as the ensembles of instances that meet by window, as by definition."""
    from causeway.operators import graphs, repair

    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (1200, 5)) / 4
    several = [[(0, 1, 0.5), (1, 2, 0.3)], [(0, 1, 0.5)], []]
    z = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [float("nan")] * 5)], "window_id long, phi array<double>")
    one = repair.graph_ensembles(z, several, 5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    instances = None
    for m, edges in enumerate(several):
        part = repair.tops(z.where("window_id < 1200"), edges, 5).withColumn("instance", F.lit(m))
        instances = part if instances is None else instances.unionByName(part)
    got, met = ({r.window_id: r for r in d.collect()} for d in (one, repair.ensembles(instances)))
    assert set(got) == set(met) == set(range(1200))
    for k in (0, 1, 499, 500, 1199):
        phi = np.stack([(x[k] / (x[k].max() + 1e-9)) @ graphs.kernel(e, 5) for e in several])
        p = (phi + 1e-12) / (phi + 1e-12).sum(1, keepdims=True)
        ranks = [[(sum(b < a for b in row) + (sum(b == a for b in row) + 1) / 2 - 1) / 4 for a in row] for row in p]
        for r in (got[k], met[k]):
            assert r.mean == pytest.approx(p.mean(0)) and r["rank"] == pytest.approx(np.mean(ranks, axis=0))
            assert r.weighted == pytest.approx((p.max(1, keepdims=True) * p).sum(0) / p.max(1).sum())
