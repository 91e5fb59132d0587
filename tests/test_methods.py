"""Methods on windows of several steps, perturbations and the audit, against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import hashing
from causeway.operators import graphs, methods, moments, statistics
from causeway.sources import files, plants, scratch


@pytest.fixture(scope="module")
def stack():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6, 4))
    x[:, 1:, 1] += 0.9 * x[:, :-1, 0]
    x[:, :, 3] += 0.7 * x[:, :, 2]
    return x


def frame(spark, x, **columns):
    rows = [(k, v.tolist(), [int(k) % x.shape[2]]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "window_id long, values array<array<double>>, roots array<int>")


A = graphs.weights([(0, 1, 0.8), (2, 3, 0.5), (1, 2, 0.2)], 4)


def test_context(spark, stack):
    ctx = methods.fit_context(frame(spark, stack))
    flat = stack.reshape(-1, 4)
    assert np.allclose(ctx.med, np.median(flat, 0)) and np.allclose(ctx.mean, flat.mean(0)) and np.allclose(ctx.std, flat.std(0) + 1e-9)
    assert np.allclose(ctx.mad, np.median(np.abs(flat - np.median(flat, 0)), 0) * 1.4826 + 1e-9)
    assert ctx.moments[0, 0] == 720 and ctx.lagged[0, 0] == 600 and len(ctx.flat_mean) == 24


def test_methods_by_direct_computation(spark, stack):
    ctx = methods.fit_context(frame(spark, stack))
    z = (np.abs(stack - ctx.med) / ctx.mad).mean(1)
    assert np.allclose(methods.zdev(ctx, None)(stack), z)
    zn = z / (z.max(1, keepdims=True) + 1e-9)
    phi = zn.copy()
    out = A.sum(1)
    for _ in range(20):
        passed = np.array([[sum(row[j] * A[i, j] / out[i] for j in range(4)) if out[i] else 0.0 for i in range(4)] for row in phi])
        phi = 0.5 * zn + 0.5 * passed
    assert np.allclose(methods.proprank(ctx, A)(stack), phi)
    # Residuals: variable 3 on 2, by ridge with a penalised intercept.
    flat = stack.reshape(-1, 4)
    design = np.hstack([np.ones((len(flat), 1)), flat[:, [2]]])
    c = np.linalg.solve(design.T @ design + 1e-2 * np.eye(2), design.T @ flat[:, 3])
    r = flat[:, 3] - design @ c
    want = (np.abs(stack[:, :, 3] - c[0] - stack[:, :, 2] * c[1]) / (r.std() + 1e-9)).mean(1)
    assert np.allclose(methods.residuals(ctx, A)(stack)[:, 3], want)
    # The score's drop with one variable at its mean.
    score = lambda y: (((y.reshape(len(y), -1) - ctx.flat_mean) @ ctx.flat_rest) ** 2).sum(1)
    y = stack.copy()
    y[:, :, 2] = ctx.mean[2]
    assert np.allclose(methods.global_cf(ctx, None)(stack)[:, 2], score(stack) - score(y))
    step = 1e-6
    moved = stack.copy()
    moved[:, 3, 1] += step
    slope = (score(moved) - score(stack)) / step
    flat_grad = np.abs(2 * (stack.reshape(120, -1) - ctx.flat_mean) @ ctx.flat_rest).reshape(stack.shape)
    assert np.allclose(flat_grad[:, 3, 1], np.abs(slope), rtol=1e-3, atol=1e-3)
    assert methods.granger(ctx, A)(stack)[:, 0].mean() > 1
    assert np.allclose(methods.shares(methods.dpta(ctx, A)(stack)).sum(1), 1)


def test_gated_variants(spark, stack):
    ctx = methods.fit_context(frame(spark, stack))
    p, z = methods.shares(methods.proprank(ctx, A)(stack)), methods.shares(methods.zdev(ctx, A)(stack))
    left, kept = methods.pruned(A, 0.4)
    assert kept == [0.5, 0.8] and left[1, 2] == 0
    prop = methods.shares(methods.proprank(ctx, left)(stack))
    assert np.allclose(methods.graa(ctx, A)(stack), 0.65 * prop + 0.35 * z)
    for variant, want in (("prune_only", prop), ("fixed_gate", 0.5 * p + 0.5 * z)):
        ctx.options["variant"] = variant
        assert np.allclose(methods.graa(ctx, A)(stack), want)
    ctx.options.clear()
    phi = methods.proprank(ctx, A)(stack)
    others = [methods.proprank(ctx, methods.perturbed((A > 0).astype(float), ("del", "rew")[m % 2], 0.2, "v2", m))(stack) for m in range(4)]
    three = lambda row: set(np.argsort(-row, kind="stable")[:3].tolist())
    cons = np.array([np.mean([len(three(phi[k]) & three(o[k])) / 3 for o in others]) for k in range(len(phi))])
    w = cons[:, None] ** 0.7
    assert np.allclose(methods.graa_v2(ctx, A)(stack), w * p + (1 - w) * z)
    assert methods.graa_v1(ctx, A)(stack).shape == (120, 4)


def test_draws_are_those_of_the_columns(spark):
    got = spark.range(20).select(hashing.uniform("del", "0.2", 3, F.col("id"), F.col("id") + 1).alias("u")).collect()
    assert [r.u for r in got] == [methods.draw("del", 0.2, 3, k, k + 1) for k in range(20)]


def test_perturbed_graphs():
    a = graphs.weights([(s, d, 0.5) for s in range(6) for d in range(s + 1, 6) if (s + d) % 2], 6)
    edges = {e[:2] for e in methods.edges_of(a)}
    gone = {e[:2] for e in methods.edges_of(methods.perturbed(a, "del", 0.5, "x"))}
    assert gone < edges and gone == {e for e in edges if methods.draw("x", *e) >= 0.5}
    more = {e[:2] for e in methods.edges_of(methods.perturbed(a, "add", 0.5, "x"))}
    absent = 15 - len(edges)
    assert edges < more and len(more) == len(edges) + round(0.5 * absent) and all(s < d for s, d in more)
    turned = graphs.weights([(5, 0, 0.9), (0, 1, 0.4), (1, 5, 0.3)], 6)  # a cycle: something has to turn
    after = {e[:2] for e in methods.edges_of(methods.perturbed(turned, "rew", 0.3, "y"))}
    picked = min([(5, 0), (0, 1), (1, 5)], key=lambda e: (methods.draw("y", *e), *e))
    rest = [e for e in [(5, 0), (0, 1), (1, 5)] if e != picked]
    at = {v: k for k, v in enumerate(graphs.topological_order(rest, range(6)))}
    assert after == set(rest) | {picked if at[picked[0]] < at[picked[1]] else picked[::-1]}


def test_inputs_change_alike_anywhere(stack):
    ctx = methods.Context(*[np.ones(4)] * 4, np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1), np.zeros(1))
    ids = np.arange(120)
    whole = methods.changed_input(ctx, "noise", 0.5, 2, stack, ids)
    part = methods.changed_input(ctx, "noise", 0.5, 2, stack[40:50], ids[40:50])
    assert np.allclose(whole[40:50], part)
    noise = (whole - stack) / 0.5
    assert abs(noise.mean()) < 0.1 and abs(noise.std() - 1) < 0.1
    moved = methods.changed_input(ctx, "slice", 3, 1, stack, ids)
    assert np.allclose(np.sort(moved, axis=1), np.sort(stack, axis=1)) and not np.allclose(moved, stack)


def test_audit_against_a_loop(spark, stack):
    windows = frame(spark, stack).repartition(3)
    ctx = methods.fit_context(windows)
    got = {(r.method, r.source, r.family, r.instance): r for r in methods.audit(windows, ctx, ["zDev", "PropRank"], {"a": A, "b": (A > 0.4) * A}, [("del", 0.5, 0), ("del", 0.5, 1)], [("noise", 0.2, 0)], reference="b").collect()}
    three = lambda row: set(np.argsort(-row, kind="stable")[:3].tolist())
    for source, a in (("a", A), ("b", (A > 0.4) * A)):
        for m in range(2):
            phi = methods.proprank(ctx, methods.perturbed(a, "del", 0.5, "del", 0.5, m))(stack)
            ref = methods.proprank(ctx, (A > 0.4) * A)(stack)
            r = got["PropRank", source, "del", m]
            assert r.acr == pytest.approx(np.mean([len(three(p) & three(q)) / 3 for p, q in zip(phi, ref, strict=True)]))
            assert r.hit3 == pytest.approx(np.mean([k % 4 in three(p) for k, p in enumerate(phi)])) and r.n == 120
    assert ("zDev", "none", "noise", 0) in got and ("zDev", "none", "del", 0) not in got
    assert methods.audit(windows.limit(0), ctx, ["zDev"], {}, []).count() == 0


def test_running_sums_and_orders(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v), int(rng.integers(2))) for k, v in enumerate(rng.integers(0, 40, 500) / 7)]
    df = spark.createDataFrame(rows, "k int, v double, y int")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = statistics.ordered(df.withColumnRenamed("k", "key"), "v", "key", down=True, sums=("y",)).orderBy("k").collect()
    assert [r.key for r in got] == [r[0] for r in want] and [r.y_so_far for r in got] == np.cumsum([r[2] for r in want]).tolist()
    assert [r.k for r in got] == list(range(1, 501))
    v, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    pos, neg = v[y == 1], v[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    assert statistics.auroc(df, "y", "v").first().auroc == pytest.approx(auc)
    assert statistics.cliffs_delta(df, "y", "v").first().delta == pytest.approx(2 * auc - 1)


def test_median_sketch_is_exact_on_small_groups(spark):
    for n in (1, 2, 3, 10, 4001):
        x = np.random.default_rng(n).normal(size=n)
        df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
        assert df.agg(statistics.median("x").alias("m")).first().m == pytest.approx(float(np.median(x)), abs=1e-12)


def test_resampling_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 10).cast("double").alias("v"))
    rows = statistics.resampled(df, "v", "key", 50, "poisson").collect()
    assert len(rows) == 50 and all(r.n == 4000 for r in rows) and abs(np.mean([r.w for r in rows]) - 4000) < 60
    signs = statistics.resampled(df, "v", "key", 50, "sign").orderBy("round").collect()
    assert signs[0].s == 18000 and abs(np.mean([r.s for r in signs[1:]])) < 200


def test_correlations_of_a_constant(spark):
    df = spark.createDataFrame([([1.0, k * 1.0, -k * 1.0],) for k in range(9)], "values array<double>")
    r = moments.correlations(moments.gram(df))
    assert np.isnan(r[0, 1]) and r[1, 2] == pytest.approx(-1)
    assert {(e.src, e.dst) for e in graphs.correlation_graph(df, 0.5).collect()} == {(1, 2)}


def test_labelled_table_in_parts(spark, tmp_path):
    """Rows count on over the blocks of a file, in the file's order."""
    with open(tmp_path / "a.csv", "w") as f:
        f.write('junk\nRow,Date,Time,"p","Attack LABLE"\n' + "".join(f"{k},d,h,{k}.5,{-1 if k % 7 == 0 else 1}\n" for k in range(3000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.labelled_csv(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert [(r.row, r.x) for r in rows] == [(k, k + 0.5) for k in range(3000)] and sum(r.attack for r in rows) == 429


def test_stored_is_computed_once(spark, tmp_path):
    path, calls = f"file://{tmp_path}/t", []

    def build():
        calls.append(1)
        return spark.range(3)

    assert scratch.stored(spark, path, build).count() == 3 == scratch.stored(spark, path, build).count()
    assert calls == [1]


def test_injection_plan(spark):
    plan = plants.injection_plan(spark, 40_000, 51).orderBy("event").collect()
    assert [p.t_start for p in plan] == [22_000 + 1200 * k for k in range(15)]
    assert [p.kind for p in plan[:5]] == ["drift", "stuck", "var", "step", "drift"] and [len(p.vars) for p in plan[:6]] == [1, 1, 2, 1, 1, 2]


def test_noise_is_the_hashed_one_and_takes_no_digest_inside_a_lambda(spark):
    from causeway.functions import hashing
    from causeway.plans.attribution_queries import noisy

    held = {"med": [0.1, 0.2, 0.3], "mad": [1.0, 2.0, 0.5]}
    rows = [(7, [0.5, 1.0, -2.0]), (123456789012, [0.0, None, 1.0]), (None, [1.0, 2.0, 3.0]), (8, None), (9, [1.0, 2.0]), (10, [])]
    base = spark.createDataFrame(rows, "window_id long, values array<double>").withColumn("phi", F.col("values"))
    got = noisy(base, held, 3)
    old = base.withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(
        "values", F.transform("values", lambda x, i: x + F.get(F.array(*map(F.lit, held["mad"])), i) * 0.5 * hashing.normal(F.col("instance"), F.col("window_id"), i))
    )
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()
    ours, theirs = ({(r.window_id, r.instance): r["values"] for r in df.collect()} for df in (got, old))
    assert ours.keys() == theirs.keys() and len(ours) == 18
    for k, v in theirs.items():
        assert (ours[k] is None) == (v is None)
        for x, y in zip(ours[k] or [], v or [], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-12))


def test_rank_ensemble_averages_before_variables_become_rows(spark):
    from causeway.functions import arrays
    from causeway.plans import registry

    row = spark.createDataFrame([([3.0, 1.0, 3.0, 2.0],)], "phi array<double>").select(arrays.midranks(F.col("phi")).alias("r")).first()
    assert row.r == [3.5, 1.0, 3.5, 2.0]
    df = registry.QUERIES["rank_ensemble"](spark, "/root/testdata/sf0.001")
    assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()
