"""Boosting over folds, interval joins, exact signed ranks, staged tables and grouped graphs, each against plain Python."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.operators import boosting, graphs, moments, statistics, windows
from causeway.sources import files


def labelled_rows(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[rng.random((n, 4)) < 0.1] = np.nan
    y = ((np.nan_to_num(x[:, 0]) > 0) ^ (np.nan_to_num(x[:, 1]) > 0.5) ^ (np.isnan(x[:, 2]) & (rng.random(n) < 0.9))).astype(float)
    return x, y


def rank_auroc(y, p):
    r = pd.Series(p).rank().to_numpy()
    n1 = int(y.sum())
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def plain_first_tree(x, y, rate, depth, least):
    """Predictions after one round, by trying every split of every feature in full."""
    base = np.log(y.mean() / (1 - y.mean()))
    g, h = np.full(len(y), y.mean()) - y, np.full(len(y), y.mean() * (1 - y.mean()))
    f = np.full(len(y), base)

    def split(rows, level):
        best = (1e-9, None)
        if level < depth:
            for k in range(x.shape[1]):
                column = x[rows, k]
                known = np.unique(x[~np.isnan(x[:, k]), k])
                for cut in (known[1:] + known[:-1]) / 2:
                    for missing_left in (False, True):
                        left = np.where(np.isnan(column), missing_left, column < cut)
                        if left.sum() < least or (~left).sum() < least:
                            continue
                        a, b = rows[left], rows[~left]
                        gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum()
                        if gain > best[0] + 1e-9:
                            best = (gain, (a, b))
        if best[1] is None:
            f[rows] -= rate * g[rows].sum() / h[rows].sum()
        else:
            for part in best[1]:
                split(part, level + 1)

    split(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-f))


def test_a_tree_takes_the_best_splits():
    x, y = labelled_rows(160)
    x = np.round(x, 1)
    model = boosting.Boosted(x, y, rounds=1, rate=0.3, depth=2, least=10)
    assert model.probability(x) == pytest.approx(plain_first_tree(x, y, 0.3, 2, 10), abs=1e-9)


def test_boosting_learns_and_fits_alike(spark):
    x, y = labelled_rows()
    model = boosting.Boosted(x[:600], y[:600], rounds=100)
    assert rank_auroc(y[600:], model.probability(x[600:])) > 0.9
    rows = [(f"k{i}", f"g{i % 3}", f"t{i % 2}", *(None if np.isnan(v) else float(v) for v in r), float(label)) for i, (r, label) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "key string, fold string, kind string, a double, b double, c double, d double, label double")
    got = boosting.held_out(df, ["a", "b", "c", "d"], "fold", rounds=20).toPandas().set_index("key")["p"]
    assert len(got) == len(x)
    sample = boosting.labelled(df, ["a", "b", "c", "d"], ["fold"])
    for k in range(3):
        train = sample[sample["fold"] != f"g{k}"]
        own = boosting.Boosted(train[["a", "b", "c", "d"]].to_numpy(float), train["label"].to_numpy(float), rounds=20)
        at = np.arange(len(x)) % 3 == k
        assert got[[f"k{i}" for i in np.flatnonzero(at)]].to_numpy() == pytest.approx(own.probability(x[at]))
    one = df.withColumn("label", F.when(F.col("fold") == "g0", 1.0).otherwise(F.col("label")))
    assert {r.fold for r in boosting.held_out(one, ["a"], "fold", rounds=2).select("fold").distinct().collect()} == {"g1", "g2"}
    assert boosting.held_out(df, ["a"], "fold", apart="kind", rounds=2).count() == len(x)


@pytest.mark.parametrize("rows", [65_536, 7])
def test_interval_join_is_the_range_join(spark, rows):
    rng = np.random.default_rng(3)
    points = [(int(u), int(t), float(k)) for k, (u, t) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(-60, 300, 400), strict=True))] + [(0, 50, -1.0)] * 40 + [(1, None, 0.0), (None, 5, 0.0)]
    spans = [(int(u), int(a), int(a + d), k) for k, (u, a, d) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-80, 280, 60), rng.choice([0, 1, 2, 15, 16, 17, 33, 64, 200, 500], 60), strict=True))] + [(0, 5, 3, 99), (2, None, 4, 98)]
    p, s = spark.createDataFrame(points, "unit int, t int, x double"), spark.createDataFrame(spans, "unit int, start int, stop int, id int")
    got = sorted((r.unit, r.t, r.x, r.id) for r in windows.interval_join(p, s, ("unit",), rows=rows).collect())
    want = sorted((u, t, x, i) for u, t, x in points for v, a, b, i in spans if u is not None and t is not None and a is not None and u == v and a <= t < b)
    assert got == want
    assert windows.interval_join(p, s.limit(0), ("unit",)).count() == 0


def test_signed_ranks_are_enumerated():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9, 12, 15):
        d = np.round(rng.normal(0.3, 1, n), 0 if n % 2 else 1)
        d = d[d != 0]
        if not len(d):
            continue
        doubled = (2 * pd.Series(np.abs(d)).rank()).round().astype(int).tolist()
        positive = int(sum(r for r, v in zip(doubled, d, strict=True) if v > 0))
        sums = np.array([sum(r for r, s in zip(doubled, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))])
        want = min(1.0, 2 * min((sums <= positive).mean(), (sums >= positive).mean()))
        assert statistics.signed_rank_p(doubled, positive) == pytest.approx(want)


def test_wilcoxon_is_exact_for_few_and_normal_for_many(spark):
    few = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, -4.0, 5.0, 0.0)], "d double")
    r = statistics.wilcoxon(few, "d").first()
    assert (r.w, r.n, r.p_value) == (11.0, 5, pytest.approx(2 * 7 / 32))
    many = spark.range(200).select(((F.col("id") % 7) - 2.5).alias("d"))
    r = statistics.wilcoxon(many, "d").first()
    assert r.n == 200 and 0 < r.p_value < 0.1


def test_staged_runs_never_double_a_unit(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 4).alias("unit"), "id")
    table = files.StagedTable(spark, f"file://{tmp_path}/t", ["unit"])
    assert table.read() is None
    table.stage(df.where("unit < 3"))  # a run that stops before it publishes
    assert table.read() is None
    first, second = table.stage(df.where("unit < 2")), files.StagedTable(spark, f"file://{tmp_path}/t", ["unit"]).stage(df.where("unit > 0"))
    table.publish(*first)
    files.StagedTable(spark, f"file://{tmp_path}/t", ["unit"]).publish(*second)  # it had staged unit 1 too
    assert sorted(r.id for r in table.read().collect()) == list(range(40))
    table.add(df)
    assert table.read().count() == 40 and len(table.published()) == 3


def test_staged_number_is_taken_once(spark, tmp_path, monkeypatch):
    """Both runs see the same number free: the rename of the second fails and it starts over."""
    df = spark.range(10).select((F.col("id") % 2).alias("unit"), "id")
    a, b = (files.StagedTable(spark, f"file://{tmp_path}/t", ["unit"]) for _ in range(2))
    mine, other = a.stage(df), b.stage(df)
    look, seen = b.published, []

    def late():
        found = look()
        if not seen:  # what b sees, before a publishes
            seen.append(1)
            a.publish(*mine)
        return found

    monkeypatch.setattr(b, "published", late)
    b.publish(*other)
    assert a.read().count() == 10


def test_graphs_of_groups(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    x[:, 1] += x[:, 0]
    x[::2, 3] -= 2 * x[::2, 4]
    df = spark.createDataFrame([(i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "g int, values array<double>").repartition(4)
    got = {(r.g, r.src, r.dst): r.w for r in graphs.correlation_graphs(df, ("g",), 0.3).collect()}
    for g in range(2):
        c = np.abs(np.corrcoef(x[g::2], rowvar=False))
        want = {(g, i, j): c[i, j] for i in range(5) for j in range(i + 1, 5) if c[i, j] > 0.3}
        assert {k: v for k, v in got.items() if k[0] == g} == pytest.approx(want)
    assert moments.grouped_correlations(df.limit(0), ("g",)).collect() == []


def test_fits_go_over_as_many_partitions_as_there_are_cores(spark, monkeypatch):
    from causeway.operators import predict

    seen = []
    plain = predict.pipeline

    def told(kind, columns, iterations=None):
        fit = plain(kind, columns, iterations)
        monkeypatch.setattr(fit, "fit", lambda df, fit=fit.fit: (seen.append(df.rdd.getNumPartitions()), fit(df))[1], raising=False)
        return fit

    monkeypatch.setattr(predict, "pipeline", told)
    rows = spark.range(0, 300, 1, 60).selectExpr("cast(id as string) as key", "cast(id % 3 as int) as fold", "cast(id % 2 as double) as label", "cast(id % 7 as double) as a_x")
    out = predict.out_of_fold(rows, ["a_x"], "lr", 3)
    assert out.count() == 300 and len(seen) == 3 and max(seen) <= spark.sparkContext.defaultParallelism


def test_boosting_adds_up_equal_features_once(monkeypatch):
    from causeway.operators.boosting import Boosted

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[rng.random(400) < 0.2, 1] = np.nan
    graph = np.where(rng.random((400, 1)) < 0.5, np.arange(11.0), np.nan)
    y = (x[:, 0] + np.isnan(graph[:, 0]) + rng.normal(size=400) > 0).astype(float)
    seen, plain = [], Boosted.grow
    monkeypatch.setattr(Boosted, "grow", lambda self, binned, *a: (seen.append(binned.shape[1]), plain(self, binned, *a))[1])
    every, once = (Boosted(np.hstack(c), y, rounds=20) for c in ((x, graph, x), (x, graph[:, :1])))
    assert set(seen) == {4}
    assert np.array_equal(every.probability(np.hstack((x, graph, x))), once.probability(np.hstack((x, graph[:, :1]))))
    assert {int(k) for t in every.trees for k in t[0]} <= {-1, 0, 1, 2, 3}
