"""Protocols of the reliability predictor: feature tables of two methods, folds, transfer, purging, edge confidence."""

from __future__ import annotations

from itertools import groupby

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import arrays, hashing
from causeway.operators import attribution, boosting, graphs, predict, scorers, selection, statistics
from causeway.plans.attribution_queries import SIZE, edge_list, noisy, setup, vector_graph
from causeway.plans.core import BASE, NOISE, query, u
from causeway.plans.statistics_queries import POISSON
from causeway.sources import adapters


def concentrations(phi, prefix: str) -> list:
    """Entropy, largest and three largest shares of an array of scores."""
    p = F.sort_array(arrays.normalized(phi), asc=False)
    return [arrays.entropy(p).alias(f"{prefix}entropy"), F.element_at(p, 1).alias(f"{prefix}top1"), arrays.total(F.slice(p, 1, 3)).alias(f"{prefix}top3")]


#: Scorers whose scores are features, one at a time, where the protocol holds out data sets by scorer.
SCORERS = ("pca", "iforest", "ocsvm")


def method_rows(spark, sf_dir, by_scorer: bool = False) -> DataFrame:
    """Feature rows of two methods on the same windows: key, window_id, dataset, trajectory, method, t, label (hit at 3), c_, a_,
    s_ and d_ features, and g_ features where the method uses a graph (null for zDev). by_scorer: a row for each scorer, with its
    score in place of the sum of squared deviations."""
    base, held, _ = setup(spark, sf_dir)
    edges = vector_graph(spark, sf_dir)
    first = edge_list(edges)
    g = graphs.features(edges, spark.range(SIZE).select(F.col("id").alias("node"))).first().asDict() if first else {}
    cons = noisy(base, held, 4).withColumn("acr", arrays.overlap(F.col("phi"), F.col("phi0"), 3)).groupBy("window_id").agg(F.avg("acr").alias("c_cons_topk3"))
    prop = base.withColumn("prop", attribution.proprank(F.col("phi"), first, SIZE))
    trajectory, out = F.concat(F.lit("emb"), (F.col("label") % 3).cast("string")), None
    for name, column in (("zDev", "phi"), ("PropRank", "prop")):
        rows = prop.select(
            "window_id", F.lit(name).alias("method"), F.concat_ws("_m", trajectory, (F.col("window_id") % 2).cast("string")).alias("dataset"), trajectory.alias("trajectory"), F.col("window_id").alias("t"), arrays.hit(F.col(column), F.col("roots"), 3).cast("double").alias("hit"),
            *concentrations(F.col(column), "a_"), *concentrations(F.col("phi"), "d_"), arrays.dot(F.col("phi"), F.col("phi")).alias("s_score"),
            *[F.lit(float(v) if name == "PropRank" else None).cast("double").alias(k) for k, v in g.items()],
        )
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("key", F.concat_ws("|", F.col("window_id").cast("string"), "method")).withColumnRenamed("hit", "label")
    out = out.join(cons, "window_id")
    if not by_scorer:
        return out
    pool = adapters.vectors(spark, sf_dir)
    told_by = [F.struct(F.lit(kind).alias("scorer"), scorers.make_scorer(kind, pool).score("values").alias("s_score")) for kind in SCORERS]
    scores = base.select("window_id", F.explode(F.array(*told_by)).alias("s")).select("window_id", "s.scorer", "s.s_score")
    return out.drop("s_score").join(scores, "window_id").withColumn("key", F.concat_ws("|", "key", "scorer"))


def feature_columns(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    return predict.with_missing_flags(rows, [c for c in rows.columns if c[:2] in ("a_", "s_", "c_", "d_", "g_")])


def held_out(rows: DataFrame, fold: str, apart: str | None = None, least_train: int = 30, least_test: int = 5, within: str | None = None) -> DataFrame:
    """key, method, label, fold (and within) and the probability of the boosted model of 300 rounds that saw no row of the fold."""
    rows, columns = feature_columns(rows)
    out = boosting.held_out(rows, columns, fold, apart, least_train, least_test, within=within)
    return out.select("key", "method", *([within] if within not in (None, "method") else []), "label", F.col(fold).alias("fold"), "p")


def told(rows: DataFrame) -> DataFrame:
    """Pooled AUROC, and the mean of the folds'."""
    rows = rows.cache()
    pooled = statistics.auroc(rows, "label", "p").select(F.round("auroc", 6).alias("pooled"))
    macro = statistics.auroc(rows, "label", "p", ("fold",)).agg(F.round(F.avg("auroc"), 6).alias("macro"), F.count("*").alias("folds"))
    return pooled.join(macro)  # one row each


@query("method_features", f"""{BASE}, {NOISE}, s as (select window_id, any_value(label) as label, sum(z * z) as score, sum(z + 1e-12) as t from z group by 1), p as (select z.window_id, (z.z + 1e-12) / s.t as p, row_number() over (partition by z.window_id order by z.z desc, z.var) as r from z join s on s.window_id = z.window_id),
d as (select window_id, -sum(p * ln(p)) as e, max(p) as t1, sum(case when r <= 3 then p end) as t3 from p group by 1), c as (select window_id, avg(acr) as cons from acrs where instance < 4 group by 1), h as (select window_id, max(case when var = root then 1.0 else 0 end) as hit from top0 group by 1)
select s.window_id, round(hit, 6) as label, round(e, 6) as d_entropy, round(t1, 6) as d_top1, round(t3, 6) as d_top3, round(score, 4) as s_score, round(cons, 6) as c_cons_topk3, true as no_graph from s join d on d.window_id = s.window_id join c on c.window_id = s.window_id join h on h.window_id = s.window_id""")
def method_features(spark, sf_dir):
    """The feature rows of the graph-free method: graph features are missing."""
    rows = method_rows(spark, sf_dir).where("method = 'zDev'")
    missing = [c for c in rows.columns if c.startswith("g_")]
    return rows.select("window_id", "label", *[F.round(c, 6).alias(c) for c in ("d_entropy", "d_top1", "d_top3")], F.round("s_score", 4).alias("s_score"), F.round("c_cons_topk3", 6).alias("c_cons_topk3"), F.coalesce(*[F.col(c) for c in missing] or [F.lit(None)]).isNull().alias("no_graph"))


@query("dataset_folds")
def dataset_folds(spark, sf_dir):
    """Leave one pair of data set and scorer out: its other magnitudes and scorers stay in training, which leaks."""
    rows = method_rows(spark, sf_dir, by_scorer=True)
    return told(held_out(rows.withColumn("pair", F.concat_ws("|", "dataset", "scorer")), "pair"))


@query("strict_folds")
def strict_folds(spark, sf_dir):
    """Leave one trajectory out, with all its magnitudes."""
    return told(held_out(method_rows(spark, sf_dir), "trajectory"))


@query("dataset_method_folds")
def dataset_method_folds(spark, sf_dir):
    """Leave out one pair of trajectory and method; training has neither the trajectory nor the method's pair."""
    rows = method_rows(spark, sf_dir).withColumn("pair", F.concat_ws("|", "trajectory", "method"))
    return told(held_out(with_one_hot(rows, "method"), "pair", apart="trajectory"))


def with_one_hot(rows: DataFrame, name: str) -> DataFrame:
    """rows with a 0/1 feature for each value of a column: methods are few."""
    values = [r[0] for r in rows.select(name).distinct().orderBy(name).collect()]
    return rows.withColumns({f"a_is_{v}": (F.col(name) == v).cast("double") for v in values})


@query("per_method_models")
def per_method_models(spark, sf_dir):
    """A model for each method alone, trajectory by trajectory. The methods' models are fitted together; zDev has no graph, so what it lacks
    of one is the same in all of its rows and splits nothing."""
    rows = method_rows(spark, sf_dir).withColumn("own", F.concat("method", F.lit("|"), "trajectory"))
    p = held_out(rows, "own", within="method").cache()
    parts = [told(p.where(F.col("method") == name)).withColumn("method", F.lit(name)) for name in ("zDev", "PropRank")]
    return parts[0].unionByName(parts[1])


@query("purged_folds")
def purged_folds(spark, sf_dir):
    """The last 30 percent of each series as tests, training without the five rows before them and without the tested data set."""
    rows = method_rows(spark, sf_dir)
    w = Window.partitionBy("dataset", "method")
    i, n = F.row_number().over(w.orderBy("t")), F.count("*").over(w)
    cut = F.floor(n * 0.7)
    rows = rows.withColumn("part", F.when(i > cut, "test").when(i > cut - 5, "purged").otherwise("train"))
    rows, columns = feature_columns(rows)
    p = boosting.held_out(rows, columns, "dataset", only=F.col("part") == "train")
    return told(p.select("label", F.col("dataset").alias("fold"), "p"))


def by_target(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Feature rows with target: whether they are of the trajectory that a model of the others is taken to."""
    rows, columns = feature_columns(method_rows(spark, sf_dir))
    return rows.withColumn("target", F.col("trajectory").eqNullSafe("emb0")), columns


@query("zero_shot")
def zero_shot(spark, sf_dir):
    """A boosted model of all trajectories but one on that one: as it is, recalibrated on a fourth of its windows, and fitted anew
    with those. They are chosen as whole windows that no test row shares."""
    rows, columns = by_target(spark, sf_dir)
    rows = rows.withColumn("few", F.col("target") & (hashing.uniform("few", F.col("window_id")) < 0.25)).cache()
    source, few = ~F.col("target"), F.col("few")
    if not all(0 < p < n for n, p in boosting.sizes(rows, {"source": source, "few": few}).values()):
        return spark.createDataFrame([], "model string, auroc double, brier double, n long")
    models = boosting.fitted(rows, columns, {"zero-shot": source, "few-shot union": source | few})
    every = rows.where("target").select("key", "few", "label", *columns)
    p = boosting.predicted(every.withColumn("model", F.explode(F.array(*map(F.lit, models)))), columns, models, "model").cache()
    logit = F.log(F.greatest("p", F.lit(1e-6)) / F.greatest(1 - F.col("p"), F.lit(1e-6)))
    # Recalibration: the source model's log odds become the one feature of a small model of the few windows.
    plain = p.where("model = 'zero-shot'").withColumn("a_logit", logit)
    again = predict.pipeline("lr", ["a_logit"]).fit(plain.where("few").select("label", "a_logit")).transform(plain.where("not few"))
    tested = p.where("not few").select("model", "label", "p").unionByName(again.select(F.lit("recalibrated").alias("model"), "label", vector_to_array("probability")[1].alias("p")))
    brier = tested.groupBy("model").agg(F.round(F.avg(F.pow(F.col("p") - F.col("label"), 2)), 6).alias("brier"), F.count("*").alias("n"))
    return statistics.auroc(tested, "label", "p", ("model",)).select("model", F.round("auroc", 6).alias("auroc")).join(brier, "model")


#: Labelled rows of the target that recalibration has, and splits for each number.
LABELLED, SPLITS = (0, 50, 100, 200, 400), 5


@query("recalibration")
def recalibration(spark, sf_dir):
    """The curve of recalibration: a boosted model of the other trajectories and of 0 to 400 rows of the target, tested on the rest of
    the target, five times over. Rows are taken as whole windows, in hashed order, half of them from windows with more than the
    median of hits, so no window is on both sides. All models are fitted together; that of no row of the target is one for all splits."""
    rows, columns = by_target(spark, sf_dir)
    rows = rows.cache()
    windows = rows.where("target").groupBy("window_id").agg(F.avg("label").alias("hits"), F.count("*").alias("n"))
    middle = selection.quantiles(windows, "hits", {"middle": 0.5})
    windows = windows.join(F.broadcast(middle)).withColumn("high", F.col("hits") > F.col("middle"))  # one row
    per = max(1, windows.agg(F.max("n")).first()[0] or 1)
    chosen: dict[tuple[int, int], set[int]] = {}
    for split in range(SPLITS):
        for high in (True, False):
            drawn = windows.where(F.col("high") == high).orderBy(hashing.uniform("recalibrate", split, F.col("window_id")), "window_id").limit(max(LABELLED)).select("window_id")
            ids = [r.window_id for r in drawn.collect()]  # a bounded number
            for n in LABELLED:
                take = -(-n // per) // 2 if high else -(-n // per) - -(-n // per) // 2
                chosen.setdefault((n, split), set()).update(ids[:take])
    names = {f"{n}|{split}": (n, split, ids) for (n, split), ids in chosen.items()}
    also: dict[int, list[str]] = {}
    for name, (_, _, ids) in names.items():
        for i in ids:
            also.setdefault(i, []).append(name)
    picked = spark.createDataFrame(list(also.items()), "window_id long, _picked array<string>")
    whole = rows.join(F.broadcast(picked), "window_id", "left")  # a bounded number of windows
    few = {name: ~F.col("target") | F.array_contains("_picked", name) for name, (_, _, ids) in names.items() if ids}
    models = boosting.fitted(whole, columns, {"source": ~F.col("target"), **few})
    models = {name: models[name if name in few else "source"] for name in names}
    mine = spark.createDataFrame([(name, n, split, sorted(ids)) for name, (n, split, ids) in names.items()], "model string, labelled int, split int, ids array<long>")
    tested = rows.where("target").select("window_id", "label", *columns).join(F.broadcast(mine), ~F.array_contains("ids", F.col("window_id"))).drop("ids")  # 25 models
    a = statistics.auroc(boosting.predicted(tested, columns, models, "model"), "label", "p", ("labelled", "split"))
    return a.groupBy("labelled").agg(F.count("auroc").alias("splits"), F.round(F.avg("auroc"), 6).alias("auroc"), F.round(F.stddev_pop("auroc"), 6).alias("spread"))


@query("difficulty_auroc", f"""{BASE}, s as (select window_id, max(z + 1e-12) / sum(z + 1e-12) as p from z group by 1), top0_ as (select * from (select *, row_number() over (partition by window_id order by z desc, var) as r from z) where r <= 3), h as (select window_id, max(case when var = root then 1 else 0 end) as y from top0_ group by 1), c as (select s.window_id, round(p, 9) as p, y, row_number() over (order by round(p, 9), s.window_id) as k, count(*) over () as n from s join h on h.window_id = s.window_id),
b as (select least((k - 1) * 3 // n, 2) as tercile, p, y from c), g as (select tercile, p, sum(y) as a, sum(1 - y) as b from b group by 1, 2), w as (select *, coalesce(sum(b) over (partition by tercile order by p rows between unbounded preceding and 1 preceding), 0) as below from g)
select cast(tercile as int) as tercile, round(sum(a * (below + b / 2.0)) / nullif(sum(a) * sum(b), 0), 6) as auroc, cast(sum(a + b) as bigint) as n from w group by 1""")
def difficulty_auroc(spark, sf_dir):
    """AUROC of the largest share for a hit, within terciles of concentration."""
    base, _, _ = setup(spark, sf_dir)
    rows = base.select("window_id", F.round(F.array_max(arrays.normalized(F.col("phi"))), 9).alias("p"), arrays.hit(F.col("phi"), F.col("roots"), 3).alias("y"))
    k = statistics.ordered(rows, "p", "window_id").join(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    part = k.withColumn("tercile", F.least(F.floor((F.col("k") - 1) * 3 / F.col("n")), F.lit(2)).cast("int"))
    a = statistics.auroc(part, "y", "p", ("tercile",))
    return a.select("tercile", F.round("auroc", 6).alias("auroc"), (F.col("np") + F.col("nn")).cast("long").alias("n"))


@query("budget_curve")
def budget_curve(spark, sf_dir):
    """The predictor with consistency estimated on 1, 2, 4 and 6 perturbations."""
    base, held, _ = setup(spark, sf_dir)
    acr = noisy(base, held, 6).withColumn("acr", arrays.overlap(F.col("phi"), F.col("phi0"), 3)).select("window_id", "instance", "acr").cache()
    rows, every = method_rows(spark, sf_dir).drop("c_cons_topk3"), (1, 2, 4, 6)
    cons = acr.withColumn("instances", F.explode(F.array(*[F.when(F.col("instance") < m, m) for m in every]))).where("instances is not null")
    cons = cons.groupBy("window_id", "instances").agg(F.avg("acr").alias("c_cons_topk3"))
    own = rows.join(cons, "window_id").withColumn("own", F.concat(F.col("instances").cast("string"), F.lit("|"), "trajectory"))
    p, out = held_out(own, "own", within="instances").cache(), None  # all budgets' models are fitted together
    for m in every:
        row = told(p.where(F.col("instances") == m)).withColumn("instances", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out


@query("episode_folds")
def episode_folds(spark, sf_dir):
    """Episodes of twenty windows; features are means over an episode, and one episode in five is a fold."""
    rows = method_rows(spark, sf_dir).where("method = 'zDev'").withColumn("episode", F.floor(F.col("window_id") / 20))
    features = [c for c in rows.columns if c[:2] in ("a_", "s_", "c_", "d_")]
    e = rows.groupBy("episode").agg(*[F.avg(c).alias(c) for c in features], (F.avg("label") >= 0.9).cast("double").alias("label"))
    e = e.select(F.col("episode").cast("string").alias("key"), F.lit("zDev").alias("method"), (F.col("episode") % 5).cast("int").alias("fold_of"), "label", *features)
    e, columns = feature_columns(e)
    # Episodes are few: leaves of two are allowed.
    return told(boosting.held_out(e, columns, "fold_of", least_train=4, least_test=1, least=2).select("key", "method", "label", F.col("fold_of").alias("fold"), "p"))


def edge_rows(spark, sf_dir, threshold: float = 0.3, samples: int = 4) -> DataFrame:
    """Of each label's learnt graph its edges: magnitude (the label), confidence, degrees, density, stability over half samples,
    and whether the whole pool's graph has them. The graphs of all labels and halves are groups of one aggregate; a row per group
    and pair of variables reaches the driver."""
    pool = adapters.vectors(spark, sf_dir)
    true = {e[:2] for e in edge_list(graphs.correlation_graph(pool, 0.08))}
    halves = F.filter(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.when(hashing.uniform("half", k, F.col("window_id")) < 0.5, k)), lambda k: k.isNotNull())
    parts = F.explode(F.concat(F.array(F.lit(-1)), halves)).alias("half")
    found = graphs.correlation_graphs(pool.where("label is not null").select("label", "values", parts), ("label", "half"), threshold)
    whole = {(label, half): [(s, d, w) for _, _, s, d, w in part] for (label, half), part in groupby(sorted(map(tuple, found.collect())), key=lambda r: r[:2])}
    rows = []
    for label in sorted({label for label, _ in whole}):
        edges = whole.get((label, -1), [])
        a = graphs.weights(edges, SIZE) > 0
        stable = sum(graphs.weights(whole.get((label, k), []), SIZE) > 0 for k in range(samples))
        most = max((w for _, _, w in edges), default=1.0)
        rows += [(f"{label}|{s}|{d}", int(label), float(w / (most + 1e-9)), float(a[s].sum()), float(a[:, d].sum()), float(a.mean()), float(stable[s, d] / samples), float((s, d) in true)) for s, d, w in edges]
    return spark.createDataFrame(rows, "key string, magnitude int, a_conf double, a_out double, a_in double, a_density double, a_stable double, label double")


@query("edge_features")
def edge_features(spark, sf_dir):
    """Edge features by label's graph: how many edges, their mean confidence and stability, and the share that the pool confirms."""
    return edge_rows(spark, sf_dir).groupBy("magnitude").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("a_conf", "a_stable", "a_density")], F.round(F.avg("label"), 6).alias("confirmed"))


@query("edge_confidence")
def edge_confidence(spark, sf_dir):
    """Leave one magnitude out: a learnt confidence of edges, with all five features and without stability, against the plain one."""
    rows, out = edge_rows(spark, sf_dir).withColumn("method", F.lit("edge")).cache(), None
    for name, columns in (("full", ["a_conf", "a_out", "a_in", "a_density", "a_stable"]), ("lite", ["a_conf", "a_out", "a_in", "a_density"])):
        part = told(held_out(rows.select("key", "method", "magnitude", "label", *columns), "magnitude", least_train=10, least_test=2)).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    plain = told(rows.select("label", F.col("magnitude").alias("fold"), F.col("a_conf").alias("p"))).withColumn("model", F.lit("confidence"))
    return out.unionByName(plain)


@query("learnt_ranker")
def learnt_ranker(spark, sf_dir):
    """A trained ranker of variables: a small network on a variable's own deviation and what its children pass on, fitted on windows
    of even numbers, and its hits at 3 on the others, against PropRank there. Of the variables that are no roots, 63 for each root,
    a hashed tenth is trained on: the network has no class weights."""
    base, _, _ = setup(spark, sf_dir)
    edges = edge_list(vector_graph(spark, sf_dir))
    rows = base.withColumn("prop", attribution.proprank(F.col("phi"), edges, SIZE))
    long = rows.select("window_id", "roots", F.posexplode(F.arrays_zip("phi", "prop")).alias("var", "v")).select(
        "window_id", "var", F.col("v.phi").alias("a_own"), F.col("v.prop").alias("a_passed"), F.array_contains("roots", F.col("var")).cast("double").alias("label")
    )
    even = long.where("window_id % 2 = 0")
    model = predict.pipeline("mlp", ["a_own", "a_passed"], 60).fit(even.where((F.col("label") == 1) | (hashing.uniform("negative", F.col("window_id"), F.col("var")) < 0.1)))
    p = model.transform(long.where("window_id % 2 = 1")).select("window_id", "var", "label", vector_to_array("probability")[1].alias("p"))
    top = p.withColumn("r", F.row_number().over(Window.partitionBy("window_id").orderBy(F.desc("p"), "var"))).where("r <= 3")
    own = top.groupBy("window_id").agg(F.max("label").alias("hit")).agg(F.round(F.avg("hit"), 6).alias("learnt"), F.count("*").alias("n"))
    return own.join(rows.where("window_id % 2 = 1").agg(F.round(F.avg(arrays.hit(F.col("prop"), F.col("roots"), 3)), 6).alias("proprank")))  # one row


@query("half_life", f"""{BASE}, {NOISE}, w as (select window_id, avg(acr) as acr, avg(hit3) as hit from acrs group by 1), s as (select window_id // 50 as seg, avg(acr) as acr, avg(hit) as hit from w group by 1),
a as (select acr, hit, (seg - min(seg) over ()) / nullif((max(seg) over () - min(seg) over ())::double, 0) as age from s) select count(*) as segments, round(corr(age, hit), 6) as age_hit, round(corr(age, acr), 6) as age_acr from a""")
def half_life(spark, sf_dir):
    """Pearson of a segment's age, scaled to 0 .. 1, with its hits and its stability; segments are fifty windows each."""
    base, held, _ = setup(spark, sf_dir)
    rows = noisy(base, held).select("window_id", arrays.overlap(F.col("phi"), F.col("phi0"), 3).alias("acr"), arrays.hit(F.col("phi"), F.col("roots"), 3).alias("hit"))
    w = rows.groupBy("window_id").agg(F.avg("acr").alias("acr"), F.avg("hit").alias("hit"))
    s = w.groupBy(F.floor(F.col("window_id") / 50).alias("seg")).agg(F.avg("acr").alias("acr"), F.avg("hit").alias("hit"))
    ends = s.agg(F.min("seg").alias("a"), F.max("seg").alias("b"))
    aged = s.join(F.broadcast(ends)).withColumn("age", (F.col("seg") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0)))  # one row
    return aged.agg(F.count("*").alias("segments"), F.round(F.corr("age", "hit"), 6).alias("age_hit"), F.round(F.corr("age", "acr"), 6).alias("age_acr"))


@query("stability_wrongness", f"""{BASE}, {NOISE}, w as (select label, window_id, avg(acr) as cons, avg(1.0 - hit3) as wrong from acrs group by 1, 2)
select label, count(*) as n, round(avg(case when cons > 0.8 then wrong end) - avg(case when cons <= 0.8 then wrong end), 6) as gap from w group by label""")
def stability_wrongness(spark, sf_dir):
    """How much more often stable windows are wrong than unstable ones."""
    base, held, _ = setup(spark, sf_dir)
    rows = noisy(base, held).select("label", "window_id", arrays.overlap(F.col("phi"), F.col("phi0"), 3).alias("acr"), (1 - arrays.hit(F.col("phi"), F.col("roots"), 3)).alias("wrong"))
    w = rows.groupBy("label", "window_id").agg(F.avg("acr").alias("cons"), F.avg("wrong").alias("wrong"))
    stable = F.col("cons") > 0.8
    return w.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when(stable, F.col("wrong"))) - F.avg(F.when(~stable, F.col("wrong"))), 6).alias("gap"))


WRONG = f"""{BASE}, {NOISE}, w as (select label, window_id, avg(acr) as cons, avg(1.0 - hit3) as wrong from acrs group by 1, 2),
c as (select label, sum(case when cons > 0.8 then 1.0 else 0 end) as nh, sum(case when cons > 0.8 then wrong else 0 end) as wh, sum(case when cons <= 0.8 then 1.0 else 0 end) as nl, sum(case when cons <= 0.8 then wrong else 0 end) as wl from w group by 1)"""


@query("wrongness_interval", f"""{WRONG}, b as (select unnest(range(500)) as round_), k as (select b.round_, c.*, {POISSON.format(u=u("'wrong'", 'b.round_', 'label'))} as w from c, b),
m as (select round_, sum(w * wh) / nullif(sum(w * nh), 0) - sum(w * wl) / nullif(sum(w * nl), 0) as rd from k group by 1)
select (select round(sum(wh) / nullif(sum(nh), 0) - sum(wl) / nullif(sum(nl), 0), 6) from c) as gap, round(quantile_cont(rd, 0.025), 6) as low, round(quantile_cont(rd, 0.975), 6) as high, count(rd) as rounds from m""")
def wrongness_interval(spark, sf_dir):
    """How much more often windows of consistency above .8 are wrong than the others, with the interval of a bootstrap of whole labels;
    rounds without windows on either side are left out."""
    base, held, _ = setup(spark, sf_dir)
    rows = noisy(base, held).select("label", "window_id", arrays.overlap(F.col("phi"), F.col("phi0"), 3).alias("acr"), (1 - arrays.hit(F.col("phi"), F.col("roots"), 3)).alias("wrong"))
    w = rows.groupBy("label", "window_id").agg(F.avg("acr").alias("cons"), F.avg("wrong").alias("wrong"))
    high = (F.col("cons") > 0.8).cast("double")
    c = w.groupBy("label").agg(F.sum(high).alias("nh"), F.sum(high * F.col("wrong")).alias("wh"), F.sum(1 - high).alias("nl"), F.sum((1 - high) * F.col("wrong")).alias("wl"))
    k = c.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(499)))).withColumn("w", statistics.poisson_weight(hashing.uniform("wrong", F.col("round"), F.col("label"))))

    def gap(*weight):
        s = [F.sum(F.col(x) if not weight else weight[0] * F.col(x)) for x in ("wh", "nh", "wl", "nl")]
        return s[0] / F.nullif(s[1], F.lit(0.0)) - s[2] / F.nullif(s[3], F.lit(0.0))

    m = k.groupBy("round").agg(gap(F.col("w")).alias("rd"))
    ends = m.agg(F.round(F.percentile("rd", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("rd", F.lit(0.975)), 6).alias("high"), F.count("rd").alias("rounds"))
    return c.agg(F.round(gap(), 6).alias("gap")).join(ends)  # one row each
