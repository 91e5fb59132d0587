"""Kernel updates, neighbours by pivots, scorers on whole pools, and the audit over scorers, each against plain arrays."""

import numpy as np
import pytest

from causeway.operators import attribution, graphs, methods, scorers
from causeway.operators.moments import gram


def random_graph(size, seed=0):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((size, size)) < 0.2, rng.random((size, size)), 0.0)
    np.fill_diagonal(a, 0)
    a[3] = 0  # a node without children
    return a


def test_updated_kernels_are_the_full_ones():
    size = 12
    a = random_graph(size)
    updates = graphs.KernelUpdates(a)
    changes = [None, *[(s, d, w) for s in range(size) for d in range(size) if s != d for w in (0.0, 1.0, 0.3)]]
    lefts, rights = updates.lefts(changes), updates.rights[updates.sources(changes)]
    for change, left, right in zip(changes, lefts, rights, strict=True):
        b = a.copy()
        if change:
            b[change[0], change[1]] = change[2]
        assert updates.kernel + left.T @ right == pytest.approx(graphs.matrix_kernel(b), abs=1e-9)


def test_overlaps_of_changed_graphs(spark, monkeypatch):
    size, rng = 9, np.random.default_rng(1)
    a, z = random_graph(size, 2), rng.random((700, size))
    edges = methods.edges_of(a)
    changes = [None, *[(s, d, 0.0) for s, d, _ in edges], (3, 1, 1.0), (0, 5, 1.0)]
    others = [edges, methods.edges_of(random_graph(size, 4))]
    frame = spark.createDataFrame([([float(v) for v in r],) for r in z], "phi array<double>")
    scaled = z / (z.max(1, keepdims=True) + 1e-9)
    want = []
    for change in changes:
        b = a.copy()
        if change:
            b[change[0], change[1]] = change[2]
        mine = methods.top(scaled @ graphs.matrix_kernel(b), 3)
        want.append(np.mean([(mine & methods.top(scaled @ graphs.kernel(o, size), 3)).sum(1).mean() / 3 for o in others]))
    assert attribution.graph_overlaps(frame, edges, changes, others, size) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(attribution, "CORRECTIONS", 8 * 20 * size * 2)  # two changes a pass
    assert attribution.graph_overlaps(frame, edges, changes[:7], others, size) == pytest.approx(want[:7], abs=1e-12)
    assert attribution.graph_overlaps(frame, edges, [], others, size) == []


@pytest.mark.parametrize("pivots", [1, 4, 32])
def test_neighbours_by_pivots_are_the_nearest(spark, pivots):
    """Clusters far apart, ties, a group with fewer rows than k, and a group without any."""
    rng = np.random.default_rng(5)
    centres = rng.normal(scale=20, size=(6, 3))
    p = np.vstack([centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 3)), np.zeros((9, 3)), np.full((3, 3), 50.0)])
    grp = np.array([k % 2 for k in range(409)] + [7] * 3)
    q, of = np.vstack([centres + 0.1, np.zeros((4, 3)), rng.normal(scale=30, size=(20, 3))]), [0, 1] * 12 + [7, 7, 7, 9, 9, 0]

    def frame(x, groups, start):
        rows = [(start + i, [float(v) for v in r], [float(v) for v in r], int(g)) for i, (r, g) in enumerate(zip(x, groups, strict=True))]
        return spark.createDataFrame(rows, "window_id long, values array<double>, code array<double>, grp int")

    got = {r.window_id: r.template for r in attribution.nearest_means(frame(p, grp, 0), frame(q, of, 1000), 5, block=16, pivots=pivots).collect()}
    for i, (w, g) in enumerate(zip(q, of, strict=True)):
        inside = np.flatnonzero(grp == g)
        near = inside[np.argsort(((p[inside] - w) ** 2).sum(1), kind="stable")[:5]]
        assert (1000 + i in got) == bool(len(inside))
        if len(inside):
            assert got[1000 + i] == pytest.approx(p[near].mean(0).tolist())


def test_pivots_rule_pools_out():
    rng = np.random.default_rng(6)
    centres = rng.normal(scale=50, size=(8, 4))
    index = attribution.Pivots({0: centres})
    p = centres[rng.integers(0, 8, 800)] + rng.normal(size=(800, 4))
    at, away = index.nearest(0, p)
    for k in range(8):
        index.pools[0, k] = (int((at == k).sum()), away[at == k].min(), away[at == k].max())
    reach = np.sqrt(np.sort(((p[:, None] - p[None]) ** 2).sum(2), axis=1)[:, 4])
    found = index.within(0, p, reach, at)
    assert sum(map(len, found)) < 0.05 * 7 * 800


def stack(n=300, steps=8, size=4, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, steps, size)) + rng.normal(size=(n, 1, 1)) * np.arange(size)


def windows(spark, x, start=0, roots=None):
    rows = [(start + i, [[float(v) for v in step] for step in w], [int(roots[i])] if roots is not None else []) for i, w in enumerate(x)]
    return spark.createDataFrame(rows, "window_id long, values array<array<double>>, roots array<int>")


def plain_conditional(pool, x, fit, k=5):
    """Templates and drops by the definition, with the given mixture."""
    n, steps, size = x.shape
    t = np.arange(steps) - (steps - 1) / 2

    def shape(w):
        return np.hstack([w.mean(1), (w * t[None, :, None]).sum(1) / (t**2).sum(), w.var(1)])

    f = shape(pool)
    mean, std = f.mean(0), f.std(0) + 1e-9
    values, vectors = np.linalg.eigh(np.cov((f - mean) / std, rowvar=False, bias=True))
    order = np.argsort(-values)
    keep = np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.95) + 1
    basis = vectors[:, order[:keep]]
    fp, fq = (f - mean) / std @ basis, (shape(x) - mean) / std @ basis
    # signs of components are free: distances and densities of the same fit are compared in its own basis
    flat = pool.reshape(len(pool), -1)
    centre = flat.mean(0)
    v, e = np.linalg.eigh(np.cov(flat, rowvar=False, bias=True))
    o = np.argsort(-v)
    e = e[:, o[: np.searchsorted(np.cumsum(v[o]) / v.sum(), 0.95) + 1]]
    rest = np.eye(len(centre)) - e @ e.T
    score = lambda w: (((w.reshape(len(w), -1) - centre) @ rest) ** 2).sum(1)
    gp, gq = fit(fp, basis), fit(fq, basis)
    phi = np.zeros((n, size))
    for i in range(n):
        inside = np.flatnonzero(gp == gq[i])
        near = inside[np.argsort(((fp[inside] - fq[i]) ** 2).sum(1), kind="stable")[:k]]
        template = pool[near].mean(0) if len(near) else pool.mean(0)
        for j in range(size):
            y = x[i : i + 1].copy()
            y[0, :, j] = template[:, j]
            phi[i, j] = (score(x[i : i + 1]) - score(y))[0]
    return phi


def test_conditional_attribution_of_several_steps(spark, monkeypatch):
    pool, x = stack(), stack(40, seed=8)
    x[:, 4:, 1] += 3
    found = {}
    first = attribution.mixture

    def kept(codes, components):
        found["fit"] = first(codes, components)
        found["codes"] = {r.window_id: np.array(r.code) for r in codes.collect()}
        return found["fit"]

    monkeypatch.setattr(attribution, "mixture", kept)
    got = {r.window_id: r.phi for r in attribution.conditional(windows(spark, pool), windows(spark, x, 1000)).collect()}

    def groups(f, basis):
        # turn the plain basis into the one that the fit was made in
        mine = np.stack([found["codes"][i] for i in range(len(pool))])
        signs = np.sign((mine * plain["codes"]).sum(0))
        return attribution.log_densities(f * signs, *found["fit"]).argmax(1)

    plain = {}
    t = np.arange(8) - 3.5
    f = np.hstack([pool.mean(1), (pool * t[None, :, None]).sum(1) / (t**2).sum(), pool.var(1)])
    z = (f - f.mean(0)) / (f.std(0) + 1e-9)
    v, e = np.linalg.eigh(np.cov(z, rowvar=False, bias=True))
    o = np.argsort(-v)
    plain["codes"] = z @ e[:, o[: np.searchsorted(np.cumsum(v[o]) / v.sum(), 0.95) + 1]]
    want = plain_conditional(pool, x, groups)
    assert len(got) == 40
    for i in range(40):
        assert got[1000 + i] == pytest.approx(want[i].tolist(), rel=1e-6, abs=1e-8)


def flat_pool(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "window_id long, values array<double>").repartition(5)


def test_samples_come_from_the_whole_pool(spark):
    pool = flat_pool(spark, np.arange(3000.0)[:, None])
    drawn = scorers.samples(pool, 40, 64, seed=2)
    again = scorers.samples(pool.coalesce(1), 40, 64, seed=2)
    assert len(drawn) == 40 and all((a == b).all() and len(np.unique(a)) == 64 for a, b in zip(drawn, again, strict=True))
    taken = np.concatenate(drawn).ravel()
    assert taken.min() < 50 and taken.max() > 2950 and abs(taken.mean() - 1499.5) < 60 and len(np.unique(taken)) > 1500
    assert [len(s) for s in scorers.samples(pool.limit(10), 3, 64)] == [10, 10, 10]


def test_passes_over_the_cluster_give_the_same_network(spark):
    x = np.random.default_rng(1).normal(size=(600, 6))
    pool = flat_pool(spark, x)
    near, far = scorers.AutoEncoder(pool, (8, 4), epochs=4), scorers.AutoEncoder(pool, (8, 4), epochs=4, in_hand=100)
    for a, b in zip(near.w + near.b, far.w + far.b, strict=True):
        assert a == pytest.approx(b, abs=1e-12)


@pytest.mark.parametrize("kind", list(scorers.SCORERS))
def test_scorers_tell_moved_windows(spark, kind):
    rng = np.random.default_rng(9)
    pool = rng.normal(size=(2000, 6)) @ np.diag([3, 2, 1, 0.3, 0.2, 0.1])
    bad = pool[:400].copy()
    bad[:, 4:] += 2.0
    fitted = scorers.make_scorer(kind, flat_pool(spark, pool))
    s = np.concatenate([fitted.scores(pool), fitted.scores(bad)])
    ranks = np.argsort(np.argsort(s))
    auroc = (ranks[2000:].sum() - 400 * 399 / 2) / (400 * 2000)
    assert auroc > (0.65 if kind in ("iforest", "ae") else 0.9)
    if kind == "ocsvm":  # the gradient's passes over the cluster are those over the rows in hand
        far = scorers.make_scorer(kind, flat_pool(spark, pool), in_hand=50, passes=3)
        near = scorers.make_scorer(kind, flat_pool(spark, pool), passes=3)
        assert far.w == pytest.approx(near.w, abs=1e-9)
        assert abs(np.mean(fitted.scores(pool) > 0) - 0.05) < 0.03  # nu of the pool lies outside


def test_audit_by_scorer_and_pool_method(spark):
    x = stack(60)
    rng = np.random.default_rng(2)
    roots = rng.integers(0, 4, 30)
    y = stack(30, seed=4)
    y[np.arange(30), :, roots] += 2.5
    pool = windows(spark, x)
    ctx = methods.fit_context(pool, rebuild=True)
    scores = {kind: scorers.make_scorer(kind, methods.flattened(pool)).scores for kind in ("pca", "iforest")}
    names = ["zDev", "GlobalCF", "AERec", "Random", "CondAttr", "PropRank"]
    a = np.triu(np.ones((4, 4)), 1)
    rows = methods.audit(windows(spark, y, 500, roots), ctx, names, {"clean": a}, [("del", 0.5, 0)], [("noise", 0.2, 0), ("slice", 1, 0)], pool=pool, by_scorer=scores).collect()
    got = {(r.method, r.scorer, r.family): r for r in rows}
    assert len(got) == len(rows) == 5 * 2 * 3 + 2 * 4 and {r.n for r in rows} == {30}
    for kind, score in scores.items():
        base = methods.global_cf(methods.replace(ctx, score=score), None)(y)
        assert got["GlobalCF", kind, "none"].base_hit1 == pytest.approx(np.mean(base.argmax(1) == roots))
        assert got["Random", kind, "noise"].acr == 1.0
        assert got["CondAttr", kind, "none"].acr == 1.0 and 0 < got["CondAttr", kind, "slice"].acr <= 1
    assert got["CondAttr", "pca", "none"].base_hit1 > 0.5
    assert got["zDev", "pca", "none"] == got["zDev", "iforest", "none"].__class__(**{**got["zDev", "iforest", "none"].asDict(), "scorer": "pca"})
    assert gram(methods.steps(pool)).shape == (5, 5)


def test_meetings_hand_on_no_values(spark, monkeypatch):
    """A query meets many pivots' pools: what each meeting tells are ids and distances, however wide the windows are."""
    rng = np.random.default_rng(21)
    told, met = [], attribution.met

    def watched(*args):
        out = met(*args)
        told.append(out.columns)
        return out

    monkeypatch.setattr(attribution, "met", watched)
    rows = [(i, x, x[:2], 0) for i, x in enumerate(rng.normal(size=(60, 6)).tolist())]
    pool = spark.createDataFrame(rows, "window_id long, values array<double>, code array<double>, grp int")
    asked = pool.where("window_id < 5")
    got = {r.window_id: r.template for r in attribution.nearest_means(pool, asked, 3, pivots=4).collect()}
    assert told == [["window_id", "d", "id"]] * 2
    for w in range(5):
        near = sorted(rows, key=lambda r: (sum((a - b) ** 2 for a, b in zip(r[2], rows[w][2], strict=True)), r[0]))[:3]
        assert got[w] == pytest.approx(np.mean([r[1] for r in near], axis=0))


def test_a_pass_deals_out_a_pool_of_one_partition(spark):
    """Windows of one file are one task to read; the passes over them aren't."""
    x = np.random.default_rng(4).normal(size=(3000, 64))
    every = scorers.Passes(flat_pool(spark, x).coalesce(1), in_hand=100)

    def by_task(part: np.ndarray) -> np.ndarray:
        from pyspark import TaskContext

        return np.append(np.bincount([TaskContext.get().partitionId()], weights=[len(part)], minlength=64), part.sum(0))

    got = every.total(by_task)
    every.done()
    assert (every.n, every.size, got[:64].sum()) == (3000, 64, 3000)
    assert np.allclose(got[64:], x.sum(0))
    assert np.count_nonzero(got[:64]) > 1


@pytest.mark.parametrize("kind", ["float", "int"])
def test_passes_over_windows_of_other_numbers(spark, kind):
    x = np.arange(1800).reshape(300, 6)
    every = scorers.Passes(flat_pool(spark, x).selectExpr(f"cast(values as array<{kind}>) as values"), in_hand=50)
    assert (every.total(lambda part: part.sum(0)) == x.sum(0)).all()
    every.done()
