"""Small cases with hand-computed answers, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import arrays, hashing
from causeway.operators import attribution, discovery, graphs, metrics, moments, predict, scorers, statistics, text, windows
from causeway.sources import files, simulators


def one(spark, column, **values):
    """Value of a column over one row of arrays or numbers."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first().out


def test_topk_takes_the_lower_index_on_ties(spark):
    assert one(spark, arrays.topk(F.col("p"), 3), p=[0.2, 0.9, 0.9, 0.1]) == [1, 2, 0]


def test_hit_and_overlap(spark):
    ref, pert = [0.5, 0.3, 0.2, 0.1], [0.1, 0.6, 0.2, 0.3]
    assert one(spark, arrays.hit(F.col("p"), F.array(F.lit(3)), 3), p=ref) == 0
    assert one(spark, arrays.hit(F.col("p"), F.array(F.lit(3)), 3), p=pert) == 1
    assert one(spark, arrays.overlap(F.col("a"), F.col("b"), 3), a=ref, b=pert) == pytest.approx(2 / 3)
    assert one(spark, arrays.overlap(F.col("a"), F.col("a"), 3), a=ref) == 1


def test_quadrants_are_strict_on_stability(spark):
    df = spark.createDataFrame([(0.9, 0.3), (0.9, 0.5), (0.8, 0.4), (0.5, 0.1)], "a double, h double")
    r = metrics.quadrant_shares(df, "a", "h", ()).first()
    assert (r.sw, r.sr, r.ur, r.uw) == (0.25, 0.25, 0.25, 0.25)


CHAIN = [(0, 1, 1.0), (1, 2, 1.0)]


def test_propagation_on_a_chain(spark):
    z = spark.createDataFrame([([0.0, 0.0, 1.0],)], "z array<double>")
    r = z.select(attribution.proprank(F.col("z"), CHAIN, 3).alias("p"), attribution.gcn_rank(F.col("z"), CHAIN, 3).alias("g")).first()
    assert r.p == pytest.approx([0.125, 0.25, 0.5], abs=1e-5)
    assert r.g == pytest.approx([0.227033, 0.431808, 0.227033], abs=1e-5)
    none = z.select(attribution.proprank(F.col("z"), [], 3).alias("p")).first()
    assert none.p == pytest.approx([0, 0, 0.5], abs=1e-6)


def edges(spark, rows):
    return spark.createDataFrame(rows, "src int, dst int, w double")


def test_graph_features_of_a_chain(spark):
    f = graphs.features(edges(spark, CHAIN), spark.range(3).toDF("node")).first()
    want = dict(n_edges=2, density=1 / 3, indeg_entropy=math.log(2), outdeg_entropy=math.log(2), indeg_max=1, indeg_mean=2 / 3, indeg_std=0.471405, sink_frac=1 / 3, source_frac=1 / 3)
    for k, v in want.items():
        assert f[f"g_{k}"] == pytest.approx(v, abs=1e-6)


def test_edge_precision_recall(spark):
    e = edges(spark, [(0, 1, 1.0), (0, 2, 1.0)])
    r = graphs.precision_recall(e, edges(spark, [(0, 1, 1.0), (1, 2, 1.0)])).first()
    assert (r.recall, r.precision, r.f1) == (0.5, 0.5, 0.5)
    nothing = e.where("src > 9")
    r = graphs.precision_recall(e, nothing).first()
    assert (r.recall, r.precision) == (1, 1)
    r = graphs.precision_recall(nothing, e).first()
    assert (r.recall, r.precision, r.f1) == (0, 1, 0)


def test_graph_perturbations(spark):
    e = edges(spark, [(a, b, 0.1 * a + 0.01 * b) for a in range(6) for b in range(a + 1, 6)])
    order = spark.range(6).select(F.col("id").cast("int").alias("node"), F.col("id").cast("int").alias("pos"))
    assert graphs.delete_edges(e, 0.0, 1).count() == 15
    same = {(r.src, r.dst) for r in e.collect()}
    flipped = {(r.src, r.dst) for r in graphs.rewire_edges(e, order.withColumn("pos", -F.col("pos")), 0.5, "s").collect()}
    assert flipped <= same | {(b, a) for a, b in same} and len(flipped) <= 15 and flipped != same
    few = e.where("src = 0")
    assert graphs.add_edges(few, order, order, 0.5, "s").count() == 5 + 5
    assert graphs.topological_order([(2, 1), (1, 0)], range(3)) == [2, 1, 0]
    assert graphs.topological_order([(0, 1), (1, 0)], range(3)) == [0, 1, 2]
    assert {(r.node, r.descendant) for r in graphs.closure(edges(spark, CHAIN)).collect()} == {(0, 1), (1, 2), (0, 2)}
    long = [(k, k + 1, 1.0) for k in range(12)] + [(12, 0, 1.0)]
    assert graphs.closure(edges(spark, long)).count() == 13 * 13


def test_pruning_and_gate(spark):
    e = edges(spark, [(0, k, w) for k, w in enumerate((0.1, 0.5, 0.9, 0.2, 0.7), 1)])
    kept = graphs.prune(e, 0.4)
    assert sorted(r.w for r in kept.collect()) == [0.5, 0.7, 0.9]
    assert attribution.graa_gate(kept).first().gate == pytest.approx(0.7)
    assert attribution.graa_gate(e.where("w > 5")).first().gate == 0


def test_rank_biased_overlap(spark):
    assert one(spark, arrays.rbo(F.col("a"), F.col("b")), a=[1, 0, 2], b=[0, 1, 2]) == pytest.approx(0.630996, abs=1e-6)
    assert one(spark, arrays.rbo(F.col("a"), F.col("a")), a=[1, 0, 2]) == pytest.approx(1)


def test_islands_and_episode_ends(spark):
    df = spark.createDataFrame([(0, k, v == -1) for k, v in enumerate([1, -1, -1, 1, -1])], "unit int, t long, bad boolean")
    assert {(r.start, r.stop) for r in windows.islands(df, "bad").collect()} == {(1, 3), (4, 5)}
    ep = spark.createDataFrame([(600, 200)], "t_start long, length long")
    ends = [r.t_end for r in windows.episode_ends(ep, 16, 20).orderBy("t_end").collect()]
    assert ends == list(range(616, 800, 20)) and len(ends) == 10


def test_segment_sampling(spark):
    seg = spark.createDataFrame([(0, 0, 5000)], "unit int, start long, stop long")
    rows = windows.segment_ends(seg, 30, 30, 60).orderBy("at").collect()
    assert (rows[0].n_win, rows[0]["take"], rows[0].step, len(rows)) == (166, 60, 2, 60)
    assert [r["at"] for r in rows[:3]] == [0, 60, 120]


def test_knee(spark):
    df = spark.createDataFrame([(0, x, y) for x, y in zip([0.1, 0.2, 0.3, 0.5], [0.95, 0.9, 0.6, 0.55], strict=True)], "g int, x double, y double")
    assert windows.knee(df, "x", "y", ("g",)).first().knee == 0.2


def test_holm_wilson_auroc_calibration(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    got = {r.k: r.adjusted for r in statistics.holm(p, "p", "k").collect()}
    assert [got[k] for k in "abc"] == pytest.approx([0.03, 0.06, 0.06])
    low, high = statistics.wilson(F.lit(30.0), F.lit(47.0))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (r.l, r.h) == pytest.approx((0.495356, 0.760340), abs=1e-6)
    s = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert statistics.auroc(s, "y", "s").first().auroc == 0.75
    c = spark.createDataFrame([(0, 0.05), (1, 0.15), (1, 0.95)], "y int, p double")
    r = statistics.ece_brier(c, "y", "p").first()
    assert (r.ece, r.brier) == pytest.approx((0.316667, 0.2425), abs=1e-6)
    assert statistics.auroc(s.where("y = 1"), "y", "s").first().auroc is None


def test_certificates(spark):
    base = spark.createDataFrame([(1, [0.9, 0.8, 0.7, 0.1])], "window_id int, phi array<double>")
    for move, certified in ((0.2, 1), (0.35, 0)):
        pert = spark.createDataFrame([(1, m, [0.9 + move, 0.8, 0.7, 0.1]) for m in range(2)], "window_id int, instance int, phi array<double>")
        r = metrics.certificates(base, pert, ("window_id",), 1).first()
        assert r.cert_worst == certified and r.gap == pytest.approx(0.6)
    assert one(spark, metrics.signed_margin(F.col("a"), F.col("b")), a=[0.9, 0.8, 0.7, 0.1], b=[0.2, 0.8, 0.7, 0.5]) == pytest.approx(-0.3)


def test_attribution_shares(spark):
    p = [0.5, 0.3, 0.2]
    assert one(spark, arrays.entropy(F.col("p")), p=p) / math.log(3) == pytest.approx(0.937231, abs=1e-6)
    assert one(spark, arrays.total(arrays.normalized(F.col("p"))), p=[-2.0, 1.0, 5.0]) == pytest.approx(1)


def test_pool_statistics_and_deviation(spark):
    cells = spark.createDataFrame([(k, 0, x) for k, x in enumerate([1.0, 2.0, 3.0, 4.0, 10.0])], "window_id int, var int, x double")
    s = statistics.pool_stats(cells)
    r = s.first()
    assert (r.med, r.mad) == pytest.approx((3.0, 1.4826 + 1e-9))
    z = attribution.zdev_long(spark.createDataFrame([(1, 0, 5.0), (1, 0, 6.0)], "window_id int, var int, x double"), s)
    assert z.first().z == pytest.approx(1.686227, abs=1e-6)


def test_roll_trim_and_seed(spark):
    assert one(spark, arrays.rolled(F.col("a"), F.lit(1)), a=[1, 2, 3, 4]) == [4, 1, 2, 3]
    assert one(spark, arrays.rolled(F.col("a"), F.lit(-1)), a=[1, 2, 3, 4]) == [2, 3, 4, 1]
    assert one(spark, arrays.trimmed_mean(F.col("a")), a=[float(k) for k in range(1, 11)]) == 5.5
    assert one(spark, hashing.seed("0", "iforest", "PropRank", "true", "del", "0.1", "0")) == 2190678222


def test_hashed_draws_look_uniform_and_normal(spark):
    r = spark.range(20_000).select(hashing.uniform("s", F.col("id")).alias("u"), hashing.normal("s", F.col("id")).alias("z"))
    s = r.agg(F.avg("u"), F.stddev("u"), F.avg("z"), F.stddev("z")).first()
    assert list(s) == pytest.approx([0.5, 12**-0.5, 0, 1], abs=0.02)


def windows_of(spark, n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 1] = 0.8 * x[:, 0] + 0.2 * rng.normal(size=n)
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "window_id long, values array<double>"), x


def test_gram_and_regression(spark):
    frame, x = windows_of(spark)
    g = moments.gram(frame)
    full = np.hstack([np.ones((len(x), 1)), x])
    assert np.allclose(g, full.T @ full)
    pa, c, sd = attribution.ridge_models(g, [(0, 1, 1.0)])[1]
    assert pa == [0] and c[1] == pytest.approx(0.8, abs=0.05)
    r = x[:, 1] - c[0] - x[:, 0] * c[1]
    assert sd == pytest.approx(r.std(), rel=1e-6)


def test_scorers_rank_outliers_first(spark):
    frame, x = windows_of(spark)
    odd = spark.createDataFrame([(1000 + k, (x[k] + 8).tolist()) for k in range(30)], "window_id long, values array<double>")
    both = frame.withColumn("y", F.lit(0)).unionByName(odd.withColumn("y", F.lit(1)))
    for kind in scorers.SCORERS:
        scored = both.select("y", scorers.make_scorer(kind, frame).score("values").alias("s"))
        assert statistics.auroc(scored, "y", "s").first().auroc > 0.9, kind
    with pytest.raises(ValueError):
        scorers.make_scorer("nothing", frame)


def test_counterfactual_and_gradient_equal_direct_computation(spark):
    frame, x = windows_of(spark)
    p = scorers.PcaScorer(frame)
    r = frame.limit(1).select("values", p.counterfactual("values").alias("c"), p.gradient("values").alias("g")).first()
    v = np.array(r["values"])
    score = lambda y: (((y - p.mean) @ p.rest) ** 2).sum()
    for j in range(len(v)):
        w = v.copy()
        w[j] = p.mean[j]
        assert r.c[j] == pytest.approx(score(v) - score(w), abs=1e-9)
        e = np.zeros(len(v))
        e[j] = 1e-6
        assert r.g[j] == pytest.approx(abs((score(v + e) - score(v - e)) / 2e-6 * v[j]), abs=1e-4)


def test_granger_blames_the_driver(spark):
    rng = np.random.default_rng(3)
    rows = []
    for w in range(40):
        a = rng.normal(size=20)
        b = np.concatenate([[0], a[:-1]]) + 0.05 * rng.normal(size=20)
        rows.append((w, np.stack([a, b], 1).tolist()))
    frame = spark.createDataFrame(rows, "window_id long, values array<array<double>>")
    phi = np.array([r.phi for r in attribution.granger(frame, frame.limit(5), [(0, 1, 1.0)]).collect()])
    assert (phi[:, 0] > phi[:, 1]).all()


def test_discovery_finds_lagged_links(spark):
    rng = np.random.default_rng(5)
    n = 3000
    a, c = rng.normal(size=n), rng.normal(size=n)
    b = 0.6 * np.concatenate([[0], a[:-1]]) + rng.normal(size=n)
    d = 0.6 * np.concatenate([[0, 0], b[:-2]]) + rng.normal(size=n)
    rows = [(0, t, v, float(x[t])) for v, x in enumerate((a, b, c, d)) for t in range(n)]
    got = discovery.pcmci(spark.createDataFrame(rows, "unit int, t long, var int, x double"), max_lag=2)
    assert {(r.src, r.dst) for r in got.collect()} == {(0, 1), (1, 3)}
    lagged = graphs.lagged_correlation_graph(spark.createDataFrame(rows, "unit int, t long, var int, x double"), 0.3, 2)
    assert {(r.src, r.dst, r.lag) for r in lagged.collect()} >= {(0, 1, 1), (1, 3, 2)}


def test_simulated_units(spark):
    e = simulators.scm_episodes(simulators.scm_units(spark, 3)).collect()
    assert len(e) == 21 and sum(len(r.roots) == 2 for r in e) == 6
    assert all(not set(r.roots) & set(r.propagation) for r in e)
    ends = sum(len(range(r.t_start + 16, r.t_start + 200, 20)) for r in e if r.unit == 0)
    assert ends == 70
    again = simulators.scm_series(spark, 2, nodes=4, steps=50)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, simulators.scm_series(spark, 2, nodes=4, steps=50).collect()))
    rng = np.random.default_rng(0)
    a = simulators.random_dag(6, 0.5, rng)
    graphs.topological_order(list(zip(*np.nonzero(a), strict=True)), range(6))
    x = simulators.tanh_series(a, 30, 0.1, rng, {2: 1.5})
    assert (x[1:, 2] == 1.5).all()
    kinds = spark.createDataFrame([(k,) for k in simulators.KINDS], "kind string")
    moved = kinds.select("kind", simulators.injected(F.col("kind"), F.lit(1.0), F.lit(100.0), F.lit(200.0), 2.0, F.lit(1.0), F.lit(0.5)).alias("x")).collect()
    assert {r.kind: r.x for r in moved} == {"step": 3.0, "ramp": 2.0, "spike": 1.0, "drift": 1.5, "var": 2.0}


def test_file_sources(spark, tmp_path):
    for rep in ("1", "2"):
        d = tmp_path / "rc" / "cart_cpu" / rep
        d.mkdir(parents=True)
        (d / "data.csv").write_text('time,cart_cpu,db_mem,cart_cpu,flat_mem,10.0.0.1_cpu\n' + "".join(f"{t},{t * t % 7},{t % 3},9,1,{t}\n" for t in range(20)))
        (d / "inject_time.txt").write_text("12.0\n")
    obs, onsets = files.fault_units(spark, str(tmp_path / "rc"))
    assert {r.name for r in obs.select("name").distinct().collect()} == {"cart_cpu", "db_mem", "flat_mem"}
    assert obs.count() == 2 * 20 * 3 and {r.onset for r in onsets.collect()} == {12.0}
    assert files.service_roots(obs).first().roots == ["cart_cpu"]
    assert {r.name for r in files.without_constants(obs, onsets).select("name").distinct().collect()} == {"cart_cpu", "db_mem"}
    (tmp_path / "m.txt").write_text("3-5:1,2\n9-9:4\n")
    assert {(r.t, r["var"]) for r in files.interval_marks(spark, str(tmp_path / "m.txt")).collect()} == {(t, v) for t in (3, 4, 5) for v in (0, 1)} | {(9, 3)}
    (tmp_path / "w.csv").write_text('junk\nRow,Date,Time,"S1",S2,Attack LABLE\n1,d,t,1.5,,1\n2,d,t,2.5,7,-1\n')
    got = {(r["row"] is not None, r.name, r.x, r.attack) for r in files.labelled_csv(spark, str(tmp_path / "w.csv")).collect()}
    assert got == {(True, "S1", 1.5, False), (True, "S2", None, False), (True, "S1", 2.5, True), (True, "S2", 7.0, True)}
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert [tuple(r) for r in files.aligned([a, b]).orderBy("x").collect()] == [(1, 2), (3, None)]


def test_sinks_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "unit string, v int")
    assert files.write_missing(df.where("unit = 'a'"), f"{tmp_path}/t", ["unit"]) == 0
    assert files.write_missing(df, f"{tmp_path}/t", ["unit"]) == 1
    assert files.StagedTable(spark, f"{tmp_path}/t", ["unit"]).read().count() == 2
    files.write_json(df, f"{tmp_path}/j")
    files.log_run(spark, f"{tmp_path}/log", "q", "ok", 1.0)
    assert spark.read.json(f"{tmp_path}/log").count() == 1


def test_folds_and_missing_values(spark):
    rows = spark.createDataFrame([(k, f"g{k % 7}", float(k % 2), float(k % 2) + 0.01 * k if k % 5 else float("nan"), None if k % 3 else 1.0) for k in range(140)], "key long, grp string, label double, a_x double, g_y double")
    folded = predict.grouped_folds(rows, "grp", 3)
    assert folded.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    flagged, columns = predict.with_missing_flags(folded, ["a_x", "g_y"])
    assert columns == ["a_x", "g_y", "g_y_missing"]
    out = predict.out_of_fold(flagged, columns, "lr", 3)
    assert out.count() == 140 and statistics.auroc(out, "label", "p").first().auroc > 0.7
    cal, test = predict.few_shot(rows, "grp", 0.5, hashing.uniform("x", F.col("grp")))
    assert cal.join(test, "grp").count() == 0 and cal.count() + test.count() == 140
    assert sum(map(len, predict.FEATURES.values())) == 24


def test_wilcoxon_permutation_and_tail(spark):
    d = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 2.0, -0.5, 3.0, 0.0, 1.5])], "k int, d double")
    r = statistics.wilcoxon(d, "d").first()
    assert (r.w, r.n) == (14.0, 5)
    p = statistics.paired_permutation(d, "d", "k", 400).first()
    assert p.observed == pytest.approx(7 / 6) and 0 < p.p_value < 0.3
    h = statistics.hypergeometric_tail(spark.createDataFrame([(10, 5, 5, 5)], "a int, b int, c int, d int"), "a", "b", "c", "d").first()
    assert h.p_value == pytest.approx(1 / 252)


def test_text_operators(spark):
    assert one(spark, text.words(F.col("t")), t="The [1, 2] well-known RULE is ok") == ["the", "well-known", "rule"]
    assert one(spark, text.shingles(F.col("w"), 2), w=["a", "b", "a", "b"]) == ["a b", "b a"]
    assert one(spark, text.plain_dashes(F.col("t")), t="1–2 and so — then") == "1-2 and so, then"
    assert one(spark, text.word_count(text.without_markup(F.col("t"))), t="<p>two <b>words</b></p><script>no</script>&nbsp;") == 2


def test_methods_are_registered():
    from causeway.operators import methods

    assert {k for k, _ in methods.METHODS.values()} == {"graph", "free", "pool"}
    with pytest.raises(ValueError):
        methods.register_method("x", "odd", len)
    with pytest.raises(ValueError):
        methods.method("x")
    with pytest.raises(ValueError):
        methods.perturbed(np.eye(2), "odd", 0.1)


def test_plants(spark, tmp_path):
    from causeway.sources import plants

    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(6, 2))
    np.savez(tmp_path / "b.npz", X=np.ones((3, 2)), Y=np.zeros(3))
    got = plants.matrix_files(spark, f"{tmp_path}/*.np*").collect()
    assert sorted((r.name, r.t) for r in got) == [("", t) for t in range(6)] + [("X", t) for t in range(3)] + [("Y", t) for t in range(3)]
    assert next(r for r in got if r.name == "" and r.t == 2)["values"] == [4.0, 5.0]
    g = plants.expert_graph(spark)
    assert g.count() == 19 and len(plants.WATER_VARIABLES) == 51
    rows = spark.range(plants.CHEMICAL_NORMAL - 5, plants.CHEMICAL_NORMAL + 2 * plants.CHEMICAL_BATCH).select(F.col("id").alias("t"), F.array(F.lit(0.0)).alias("values"), ((F.col("id") - plants.CHEMICAL_NORMAL) % plants.CHEMICAL_BATCH > 480).cast("int").alias("y"))
    normal, units = plants.fault_batches(rows)
    assert normal.count() == 5
    assert {(r.unit, r.onset, tuple(r.roots)) for r in units.select("unit", "onset", "roots").distinct().collect()} == {("idv1_b0", 481, (3,)), ("idv1_b1", 481, (3,))}
    kinds = spark.createDataFrame([(k,) for k in ("drift", "stuck", "var", "step")], "kind string")
    moved = {r.kind: r.x for r in kinds.select("kind", plants.faulty(F.col("kind"), F.lit(1.0), F.lit(0.3), F.lit(50), 200, 6.0, F.lit(0.5)).alias("x")).collect()}
    assert moved == pytest.approx({"drift": 1 + 6 * (1 - math.exp(-1)), "stuck": 0.3, "var": 2.5, "step": 7.0})


def test_adversarial_flip_tries_all_deletions_and_additions(spark):
    from causeway.plans.learning_queries import greedy_flips

    rng = np.random.default_rng(5)
    size, given = 8, [(i, j, 0.9 - 0.02 * (8 * i + j) % 1) for i in range(8) for j in range(i + 1, 8) if (i * 3 + j) % 2]
    x = np.abs(rng.normal(size=(40, size)))
    z = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "window_id int, phi array<double>")
    x = x / (x.max(1, keepdims=True) + 1e-9)

    def tops(weights):
        return [set(np.argsort(-r, kind="stable")[:3]) for r in x @ graphs.kernel([(*k, w) for k, w in weights.items()], size)]

    current = {e[:2]: e[2] for e in given}
    first, want = tops(current), []
    for budget in (1, 2):
        best = None
        for op in [(s, d, 0.0) for s, d in sorted(current)] + [(s, d, 1.0) for s in range(size) for d in range(size) if s != d and (s, d) not in current]:
            acr = sum(len(a & b) for a, b in zip(first, tops({**current, op[:2]: op[2]}), strict=True)) / (3 * len(x))
            if best is None or acr < best[0] - 1e-12:
                best = (acr, op)
        acr, (s, d, w) = best
        current = {k: v for k, v in {**current, (s, d): w}.items() if v}
        want.append((budget, "add" if w else "del", s, d, pytest.approx(acr)))
    assert greedy_flips(z, given, size) == want and len(given) > 12 and want[0][1] == "add"


def test_repair_scores_every_edge(spark):
    from causeway.operators import repair

    rng, size = np.random.default_rng(10), 9
    pairs = [(i, j) if rng.random() < 0.5 else (j, i) for i in range(size) for j in range(i + 1, size)]
    given = [(i, j, float(rng.random())) for i, j in pairs]
    x = np.abs(rng.normal(size=(60, size)))
    z = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "window_id int, phi array<double>")
    x = x / (x.max(1, keepdims=True) + 1e-9)

    def tops(edges):
        return [set(np.argsort(-r, kind="stable")[:3]) for r in x @ graphs.kernel(edges, size)]

    others = [tops(o) for o in repair.perturbed(given, 6, 0.15, size, 42)]

    def agreement(edges):
        return np.mean([len(a & b) / 3 for o in others for a, b in zip(tops(edges), o, strict=True)])

    want = {e[:2]: agreement([x for x in given if x != e]) - agreement(given) for e in given}
    left, gain = repair.repaired(z, given, size)
    assert len(gain) == len(given) == 36
    for s, d, g in gain:
        assert g == pytest.approx(want[s, d], abs=1e-9)
    harmful = {k for k, v in want.items() if v > 1e-9}
    least = {e[:2] for e in sorted(given, key=lambda e: e[2])[:16]}
    assert {e[:2] for e in given} - {e[:2] for e in left} == harmful and harmful - least


def test_influence_of_every_edge(spark):
    from causeway.plans.series_queries import influences

    z = spark.createDataFrame([([0.9 - 0.01 * v + 0.3 * ((v * k) % 5) for v in range(12)],) for k in range(1, 21)], "phi array<double>")
    given = [(v, v + 1, 0.2 + 0.05 * v) for v in range(11)]
    ref = z.select(F.monotonically_increasing_id().alias("window_id"), "phi").cache()
    got = influences(ref, given, 12)
    assert [e[:2] for e in got] == [e[:2] for e in given]
    for (s, d, v), e in zip(got, given, strict=True):
        both = [ref.select("window_id", attribution.proprank(F.col("phi"), g, 12).alias("phi")) for g in (given, [x for x in given if x != e])]
        assert v == pytest.approx(1 - metrics.acr(*both, ("window_id",)).agg(F.avg("acr")).first()[0]), (s, d)
    assert influences(ref, [], 12) == []


def test_graa_v3_runs_on_the_repaired_graph_with_one_gate(spark):
    from causeway.operators import repair
    from causeway.plans.learning_queries import graa_v3

    rng, size = np.random.default_rng(10), 9
    pairs = [(i, j) if rng.random() < 0.5 else (j, i) for i in range(size) for j in range(i + 1, size)]
    given = [(i, j, float(rng.random())) for i, j in pairs]
    x = np.abs(rng.normal(size=(60, size)))
    z = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "window_id int, phi array<double>")
    left, _ = repair.repaired(z, given, size)
    gate = repair.mean_consistency(z, left, repair.perturbed(left, 6, 0.15, size, 42), size)
    prop = (x / (x.max(1, keepdims=True) + 1e-9)) @ graphs.kernel(left, size)
    share = [v / v.sum(1, keepdims=True) for v in (prop, x)]
    got = np.array([r.v3 for r in graa_v3(z, given, size).orderBy("window_id").collect()])
    assert len(left) < len(given) and gate >= 0.5 and np.allclose(got, gate * share[0] + (1 - gate) * share[1], atol=1e-9)
    alone = np.array([r.v3 for r in graa_v3(z, given, size, fallback=1.1).orderBy("window_id").collect()])
    assert np.allclose(alone, share[1], atol=1e-9)


def test_reliability_models_have_the_sizes_of_the_reference(spark):
    models = {kind: predict.pipeline(kind, ["a", "b", "c"]).getStages()[-1] for kind in ("gbt", "rf", "mlp")}
    assert models["gbt"].getMaxIter() == 300 and models["gbt"].getStepSize() == 0.08
    assert models["rf"].getNumTrees() == 300
    assert list(models["mlp"].getLayers()) == [3, 64, 32, 2] and models["mlp"].getMaxIter() == 400


def test_conditional_neighbours_come_from_the_whole_pool(spark):
    rng = np.random.default_rng(4)
    p, q, group = rng.normal(size=(90, 3)), rng.normal(size=(20, 3)), [k % 2 for k in range(90)]

    def frame(x, grp, start):
        return spark.createDataFrame([(start + i, [float(v) for v in r], [float(v) for v in r[:2]], g) for i, (r, g) in enumerate(zip(x, grp, strict=False))], "window_id long, values array<double>, code array<double>, grp int")

    got = {r.window_id: r.template for r in attribution.nearest_means(frame(p, group, 0), frame(q, group, 500), 5, block=8).collect()}
    assert len(got) == 20
    for i, w in enumerate(q):
        inside = np.flatnonzero(np.array(group) == i % 2)
        near = inside[np.argsort(((p[inside, :2] - w[:2]) ** 2).sum(1), kind="stable")[:5]]
        assert got[500 + i] == pytest.approx(p[near].mean(0).tolist())


def test_mixture_has_a_variance_for_each_component(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.1, (300, 2)), rng.normal([3, 0], [1.0, 0.2], (100, 2))])
    codes = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "window_id long, code array<double>")
    weight, mean, var = attribution.mixture(codes, 2)
    at = np.argsort(mean[:, 0])
    assert weight[at] == pytest.approx([0.75, 0.25], abs=0.02) and mean[at, 0] == pytest.approx([0, 3], abs=0.3)
    assert np.sqrt(var[at]) == pytest.approx(np.array([[0.1, 0.1], [1.0, 0.2]]), abs=0.2)
