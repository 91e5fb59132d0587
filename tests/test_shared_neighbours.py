"""What is the same for all scorers is looked for once, and windows are dealt out over the cores."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import attribution, methods, scorers


def pool_of(spark, rng, n=300, steps=2, size=4):
    x = rng.normal(size=(n, steps, size))
    return spark.createDataFrame([(k, v.tolist(), [int(k % size)]) for k, v in enumerate(x)], "window_id long, values array<array<double>>, roots array<int>").coalesce(1)


@pytest.mark.parametrize("steps", [1, 3])
def test_a_forest_walks_anew_only_where_a_path_turns(spark, steps):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (150, steps * 4)) / 2.0
    pool = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "window_id long, values array<double>")
    forest = scorers.IsolationForest(pool, trees=30, size=64)
    to = rng.integers(-3, 4, x.shape) / 2.0
    to[:20] = x[:20]
    assert np.array_equal(attribution.one_changed(forest.scores, x, to, 4), attribution.one_changed(lambda v: forest.scores(v), x, to, 4))


def test_neighbours_are_looked_for_once_for_all_scorers(spark, monkeypatch):
    pool = pool_of(spark, np.random.default_rng(7))
    flat = methods.flattened(pool)
    ctx, seen, plain = methods.fit_context(pool), [], attribution.nearest_ids
    for module in (attribution, methods):
        monkeypatch.setattr(module, "nearest_ids", lambda *a, **k: (seen.append(1), plain(*a, **k))[1])
    by_scorer = {kind: scorers.make_scorer(kind, flat).scores for kind in ("pca", "iforest")}
    changes = [("noise", 0.5, 0), ("noise", 0.5, 1), ("slice", 1, 0)]
    rows = methods.audit(pool, ctx, ["CondAttr"], {}, [], changes, pool=pool, by_scorer=by_scorer)
    got = {(r.scorer, r.family, r.instance): (r.n, r.acr, r.hit3, r.base_hit1) for r in rows.collect()}
    assert len(seen) == 1 and len(got) == 8
    # As by definition: each copy on its own.
    pdf = flat.toPandas()
    x, ids, roots = np.stack(pdf["values"].to_numpy()).reshape(300, 2, 4), pdf["window_id"].to_numpy(), methods.root_mask(pdf["roots"], 4)
    for scorer, score in by_scorer.items():
        phi = {}
        for change in [None, *changes]:
            y = methods.changed_input(ctx, *change, x, ids) if change else x
            asked = spark.createDataFrame([(int(i), v.ravel().tolist()) for i, v in zip(ids, y, strict=True)], "window_id long, values array<double>")
            told = {r.window_id: r.phi for r in methods.cond_attr(flat.drop("roots"), asked, 2, score).collect()}
            phi[change] = np.array([told[i] for i in ids])
        for change, p in phi.items():
            want = methods.compared(p, phi[None], phi[None], roots).mean(0)
            n, *others = got[scorer, *((change[0], change[2]) if change else ("none", 0))]
            assert n == 300 and others == pytest.approx([want[1], want[2], want[3]])


def test_windows_of_one_file_are_dealt_out(spark):
    pool, tasks = pool_of(spark, np.random.default_rng(3), 400), spark.sparkContext.accumulator(0)

    def counted(ctx, a):
        def run(x):
            tasks.add(1)
            return np.abs(x).mean(1)

        return run

    ctx = methods.fit_context(pool)
    methods.METHODS["counted"] = ("free", counted)
    try:
        assert methods.audit(pool, replace(ctx), ["counted"], {}, []).first().n == 400
    finally:
        del methods.METHODS["counted"]
    assert tasks.value > 1


def test_a_query_goes_once_to_a_tile(spark):
    """Not once to each pool in reach; with pools above the block's size, which are tiles of their own, the result is the same."""
    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(600, 12)).round(2), rng.normal(size=(200, 12)).round(2)
    frame = lambda x, low: spark.createDataFrame([(low + k, [float(c) for c in v], int(k % 2)) for k, v in enumerate(x)], "window_id long, code array<double>, grp int")
    sent, plain = [], attribution.met
    try:
        attribution.met = lambda pool, queries, *a: (sent.append(queries.count()), plain(pool, queries, *a))[1]
        got = [{(r.window_id, r.r): r.id for r in attribution.nearest_ids(frame(p, 0), frame(q, 1000), 5, block=block).collect()} for block in (16_384, 20)]
    finally:
        attribution.met = plain
    assert sent[1] <= len(q) < sent[3]
    d = ((q[:, None] - p[None]) ** 2).sum(2)
    for k in range(len(q)):
        same = np.arange(k % 2, len(p), 2)
        best = same[np.lexsort((same, d[k, same]))[:5]]
        assert [got[0][1000 + k, r + 1] for r in range(5)] == best.tolist()
    assert got[0] == got[1]
