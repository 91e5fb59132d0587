"""Repairs, baselines, ensembles, resampling and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import arrays, hashing
from causeway.operators import attribution, graphs, metrics, repair, scorers, statistics
from causeway.plans.attribution_queries import EDGES, SIZE, edge_list, setup, vector_graph
from causeway.plans.core import BASE, CELLS, SERIES, STATS, query, u
from causeway.plans.statistics_queries import DIFF, POISSON, PREDS, preds, rounded, spread
from causeway.sources import adapters


@query("graph_repair")
def graph_repair(spark, sf_dir):
    """Hit at 3 before and after repair, and how many edges went."""
    base, _, _ = setup(spark, sf_dir)
    edges = edge_list(vector_graph(spark, sf_dir))
    z = base.select("window_id", "phi").cache()
    fixed, _ = repair.repaired(z, edges, SIZE)
    both = base.select("window_id", "roots", attribution.proprank(F.col("phi"), edges, SIZE).alias("a"), attribution.proprank(F.col("phi"), fixed, SIZE).alias("b"))
    return both.agg(F.avg(arrays.hit(F.col("a"), F.col("roots"), 3)).alias("before"), F.avg(arrays.hit(F.col("b"), F.col("roots"), 3)).alias("after")).withColumn("removed", F.lit(len(edges) - len(fixed)))


@query("deletion_baselines")
def deletion_baselines(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    edges = edge_list(vector_graph(spark, sf_dir))
    ref, rows = repair.tops(base, edges, SIZE), None
    for kind, left in repair.deletion_baselines(edges, 2).items():
        part = repair.tops(base, left, SIZE).withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    return metrics.acr(ref, rows, ("window_id",)).groupBy("kind").agg(F.round(F.avg("acr"), 6).alias("acr"))


@query("confidence_deletion", f"with {CELLS}, {EDGES} select src, dst from (select src, dst, row_number() over (order by w desc, src, dst) as r from edges) where r <= 5")
def confidence_deletion(spark, sf_dir):
    """The five edges of most confidence: what the confidence baseline deletes."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.orderBy(F.desc("w"), "src", "dst"))
    return vector_graph(spark, sf_dir).withColumn("r", r).where("r <= 5").select("src", "dst")


@query("perturbed_ensembles")
def perturbed_ensembles(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    edges = vector_graph(spark, sf_dir)
    kept = [edge_list(graphs.delete_edges(edges, 0.2, "ens", m)) for m in range(3)]
    e = repair.graph_ensembles(base.select("label", "roots", "phi"), kept, SIZE)
    return e.groupBy("label").agg(*[F.round(F.avg(arrays.hit(F.col(c), F.col("roots"), 3)), 6).alias(c) for c in ("mean", "rank", "weighted")])


@query("damping_sweep")
def damping_sweep(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    edges, out = edge_list(vector_graph(spark, sf_dir)), None
    for d in (0.1, 0.3, 0.5, 0.7, 0.9):
        phi = attribution.proprank(F.col("phi"), edges, SIZE, damping=d)
        row = base.select("roots", phi.alias("p")).agg(F.round(F.avg(arrays.hit(F.col("p"), F.col("roots"), 3)), 6).alias("hit3")).withColumn("damping", F.lit(d))
        out = row if out is None else out.unionByName(row)
    return out


@query("alpha_sweep")
def alpha_sweep(spark, sf_dir):
    base, held, _ = setup(spark, sf_dir)
    pool = adapters.vectors(spark, sf_dir)
    models = attribution.ridge_models(attribution.gram(pool), edge_list(vector_graph(spark, sf_dir)))
    rows = base.withColumn("r", attribution.residual_z(F.col("values"), models, held)).withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.3, 0.5, 0.7, 1.0)))))
    phi = F.zip_with(arrays.normalized(F.col("phi")), arrays.normalized(F.col("r")), lambda x, y: F.col("alpha") * x + (1 - F.col("alpha")) * y)
    return rows.withColumn("phi", phi).groupBy("alpha").agg(F.round(F.avg(arrays.hit(F.col("phi"), F.col("roots"), 3)), 6).alias("hit3"))


@query("intervention_repair")
def intervention_repair(spark, sf_dir):
    return repair.intervention_scores(spark, 6).groupBy("tag").agg(F.avg("repair").alias("repair"), F.count("*").alias("n"))


@query("contaminated_pool")
def contaminated_pool(spark, sf_dir):
    """Detection with a clean pool, one that half of the anomalies are in, and a quarter of the pool."""
    base, _, _ = setup(spark, sf_dir)
    pool = adapters.vectors(spark, sf_dir)
    half = base.where(hashing.uniform("mix", F.col("window_id")) < 0.5).select((F.col("window_id") + 10**9).alias("window_id"), "values")
    quarter = pool.where(hashing.uniform("frac", F.col("window_id")) < 0.25)
    both = pool.select("values", F.lit(0).alias("y")).unionByName(base.select("values", F.lit(1).alias("y")))
    out = None
    for name, fit in (("clean", pool), ("contaminated", pool.select("window_id", "values").unionByName(half)), ("quarter", quarter)):
        s = both.select("y", scorers.PcaScorer(fit).score("values").alias("s"))
        row = statistics.auroc(s, "y", "s").select(F.lit(name).alias("pool"), F.round("auroc", 5).alias("auroc"))
        out = row if out is None else out.unionByName(row)
    return out


@query("global_noise", f"""{BASE}, sd as (select stddev_pop(x) as s from inj), n as (select i.window_id, i.var, abs(i.x + 0.1 * sd.s * sqrt(-2.0 * ln(1.0 - {u("'g'", 'i.window_id', 'i.var', "'a'")})) * cos(2 * pi() * {u("'g'", 'i.window_id', 'i.var', "'b'")}) - s.med) / s.mad as z
from inj i join stats s on i.var = s.var, sd), a as (select window_id, var from (select *, row_number() over (partition by window_id order by z desc, var) as r from n) where r <= 3),
b as (select window_id, var from (select *, row_number() over (partition by window_id order by z desc, var) as r from z) where r <= 3)
select b.window_id, round(count(a.var) / 3.0, 6) as acr from b left join a on a.window_id = b.window_id and a.var = b.var group by 1""")
def global_noise(spark, sf_dir):
    """One draw of noise at a tenth of the deviation of all cells."""
    base, held, _ = setup(spark, sf_dir)
    sd = base.select(F.explode("values").alias("x")).agg(F.stddev_pop("x")).first()[0]
    moved = F.transform("values", lambda x, i: x + F.lit(0.1 * sd) * hashing.normal("g", F.col("window_id"), i))
    noisy = base.drop("phi").withColumn("values", moved).withColumn("phi", attribution.zdev(F.col("values"), held))
    return metrics.acr(base.select("window_id", "phi"), noisy.select("window_id", "phi"), ("window_id",)).select("window_id", F.round("acr", 6).alias("acr"))


@query("two_level_bootstrap", f"""with {PREDS}, b as (select unnest(range(100)) as round_), c as (select b.round_, source, sum(w * y)::double / nullif(sum(w), 0) as m from (select b.round_, source, y, {POISSON.format(u=spread('t', 'doc_id', 'b.round_'))} as w from preds, b) b group by 1, 2),
m as (select round_, avg(m) as m from c group by 1) select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""")
def two_level_bootstrap(spark, sf_dir):
    """Resampled within cells, then the mean over cells."""
    d = statistics.resampled(preds(spark, sf_dir), "y", "doc_id", 100, "poisson", "t", "source")
    c = d.select("round", (F.col("s") / F.nullif(F.col("w"), F.lit(0.0))).alias("m"))
    m = c.groupBy("round").agg(F.avg("m").alias("m"))
    return rounded(m.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")))


@query("paired_bootstrap", f"""with {PREDS}, {DIFF}, b as (select unnest(range(100)) as round_), m as (select round_, sum(w * d) / sum(w) as m from (select b.round_, d, {POISSON.format(u=spread('0', 'doc_id', 'b.round_'))} as w from diff, b) b group by 1)
select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""")
def paired_bootstrap(spark, sf_dir):
    d = preds(spark, sf_dir).select("doc_id", F.round(F.col("p") - hashing.uniform("q", F.col("doc_id")), 6).alias("d"))
    return rounded(statistics.bootstrap_ci(d, "d", "doc_id", 100))


@query("conditional_wrongness", f"""with {PREDS}, s as (select source, y, {u("'cons'", 'doc_id')} > 0.5 as stable from preds) select source, round(avg(case when stable then 1.0 - y end) - avg(case when not stable then 1.0 - y end), 6) as gap from s group by source""")
def conditional_wrongness(spark, sf_dir):
    s = preds(spark, sf_dir).withColumn("stable", hashing.uniform("cons", F.col("doc_id")) > 0.5)
    wrong = 1 - F.col("y")
    return s.groupBy("source").agg(F.round(F.avg(F.when(F.col("stable"), wrong)) - F.avg(F.when(~F.col("stable"), wrong)), 6).alias("gap"))


@query("age_correlation", f"""with {SERIES}, d as (select unit, t // 24 as day, avg(x) as hit from series group by 1, 2) select unit, round(corr(day, hit), 6) as r from d group by unit""")
def age_correlation(spark, sf_dir):
    """Pearson of a segment's age with its score; scaling the age does not change it."""
    d = adapters.event_series(spark, sf_dir).groupBy("unit", F.floor(F.col("t") / 24).alias("day")).agg(F.avg("x").alias("hit"))
    return d.groupBy("unit").agg(F.round(F.corr("day", "hit"), 6).alias("r"))


@query("batch_sensitivity", f"""with {PREDS}, b as (select unnest(range(100)) as draw), s as (select unnest([10, 50])::int as size), k as (select s.size, b.draw, p.y, row_number() over (partition by s.size, b.draw order by {spread('batch', 'p.doc_id', 'b.draw')}, p.doc_id) as r from preds p, b, s),
m as (select size, draw, avg(y) as m from k where r <= size group by 1, 2) select size, round(avg(m), 6) as mean, round(stddev_pop(m), 6) as spread from m group by size""")
def batch_sensitivity(spark, sf_dir):
    """Spread of a batch's mean over hashed draws, by batch size."""
    from pyspark.sql import Window

    m = statistics.batch_means(preds(spark, sf_dir), "y", "doc_id", 100, (10, 50), "batch")
    return m.groupBy("size").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("spread"))


@query("difficulty_terciles", f"""with {CELLS}, {STATS}, c as (select window_id, sum(abs(x - med) / mad) as s from cells join stats using (var) group by 1), r as (select window_id, s, row_number() over (order by s, window_id) as r, count(*) over () as n from c)
select cast(least((r - 1) * 3 // n, 2) as int) as tercile, count(*) as n, round(avg(s), 5) as mean from r group by 1""")
def difficulty_terciles(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    held = attribution.stat_arrays(statistics.pool_stats(adapters.cells(v)))
    z = v.select("window_id", arrays.total(attribution.zdev(F.col("values"), held)).alias("s"))
    r = statistics.ordered(z, "s", "window_id").join(F.broadcast(z.agg(F.count("*").alias("n"))))  # one row
    return r.groupBy(F.least(F.floor((F.col("k") - 1) * 3 / F.col("n")), F.lit(2)).cast("int").alias("tercile")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 5).alias("mean"))
