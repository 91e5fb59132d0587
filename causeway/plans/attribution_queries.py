"""Queries on vectors as single-step windows: pool statistics, attribution, stability, certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import arrays, hashing
from causeway.operators import attribution, graphs, metrics, scorers, statistics
from causeway.plans.core import BASE, CELLS, NOISE, STATS, query, u
from causeway.sources import adapters

SIZE = 64
THRESHOLD = 0.1


def setup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict, DataFrame]:
    """Injected windows with phi0 = z, and the pool's statistics as arrays and table."""
    windows = adapters.vectors(spark, sf_dir)
    stats = statistics.pool_stats(adapters.cells(windows))
    held = attribution.stat_arrays(stats)
    base = adapters.injected(windows).withColumn("phi", attribution.zdev(F.col("values"), held))
    return base, held, stats


def noisy(base: DataFrame, held: dict, instances: int = 8, strength: float = 0.5) -> DataFrame:
    """base once per instance, its values moved by hashed normal noise of `strength` deviations, with the new phi."""
    rows = base.withColumnRenamed("phi", "phi0").withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(instances - 1))))
    draws = hashing.normals(F.col("instance"), F.col("window_id"), size=len(held["mad"]))
    steps = F.zip_with(attribution.literal(held["mad"]), draws, lambda m, d: m * strength * d)
    moved = F.zip_with("values", F.slice(steps, F.lit(1), F.greatest(F.size("values"), F.lit(0))), lambda x, d: x + d)
    return rows.withColumn("values", moved).withColumn("phi", attribution.zdev(F.col("values"), held))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, held, _ = setup(spark, sf_dir)
    out = metrics.acr(base.select("window_id", "phi"), noisy(base, held), ("window_id",))
    return out.withColumn("hit3", arrays.hit(F.col("phi"), F.col("roots"), 3))


@query("zdev_topk_hit", f"""{BASE}, top as (select *, row_number() over (partition by window_id order by z desc, var) as r from z)
select label, round(avg(h1), 6) as hit1, round(avg(h3), 6) as hit3, round(avg(h5), 6) as hit5, count(*) as n_windows from (
  select window_id, label, max(case when var = root and r <= 1 then 1 else 0 end) as h1, max(case when var = root and r <= 3 then 1 else 0 end) as h3,
    max(case when var = root and r <= 5 then 1 else 0 end) as h5 from top group by window_id, label) group by label""")
def zdev_topk_hit(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    hits = metrics.hits(base)
    return hits.groupBy("label").agg(*[F.round(F.avg(f"hit{k}"), 6).alias(f"hit{k}") for k in (1, 3, 5)], F.count("*").alias("n_windows"))


@query("pool_stats", f"with {CELLS}, {STATS} select var, round(med, 6) as med, round(mad, 6) as mad, round(mean, 6) as mean, round(std, 6) as std from stats")
def pool_stats(spark, sf_dir):
    s = statistics.pool_stats(adapters.cells(adapters.vectors(spark, sf_dir)))
    return s.select("var", *[F.round(c, 6).alias(c) for c in ("med", "mad", "mean", "std")])


@query("zdev_checksum", f"with {CELLS}, {STATS} select round(sum(abs(x - med) / mad), 3) as checksum, count(*) as n_cells from cells join stats using (var)")
def zdev_checksum(spark, sf_dir):
    cells = adapters.cells(adapters.vectors(spark, sf_dir))
    z = attribution.zdev_long(cells, statistics.pool_stats(cells))
    return z.agg(F.round(F.sum("z"), 3).alias("checksum"), F.count("*").alias("n_cells"))


SHARES = f"""{BASE}, tot as (select window_id, sum(z + 1e-12) as s from z group by window_id),
p as (select z.window_id, z.var, (z.z + 1e-12) / t.s as p, row_number() over (partition by z.window_id order by z.z desc, z.var) as r from z join tot t on z.window_id = t.window_id)"""


@query("attribution_features", f"""{SHARES} select window_id, round(max(p), 6) as a_top1_share, round(sum(case when r <= 3 then p end), 6) as a_top3_share,
round(-sum(p * ln(p)) / ln(64), 6) as a_attr_entropy, round(max(case when r = 1 then p end) - max(case when r = 2 then p end), 6) as a_top_gap,
round(max(case when r = 1 then p end) / max(case when r = 2 then p end), 5) as a_top_ratio from p group by window_id""")
def attribution_features(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    p = base.select("window_id", F.sort_array(arrays.normalized(F.col("phi")), asc=False).alias("p"))
    return p.select(
        "window_id", F.round(F.element_at("p", 1), 6).alias("a_top1_share"), F.round(arrays.total(F.slice("p", 1, 3)), 6).alias("a_top3_share"),
        F.round(arrays.entropy(F.col("p")) / F.log(F.size("p")), 6).alias("a_attr_entropy"), F.round(F.element_at("p", 1) - F.element_at("p", 2), 6).alias("a_top_gap"),
        F.round(F.element_at("p", 1) / F.element_at("p", 2), 5).alias("a_top_ratio"),
    )


@query("row_confidence", f"{SHARES} select label, round(avg(m), 6) as confidence from (select p.window_id, max(r.label) as label, max(p) as m from p join roots r on r.window_id = p.window_id group by p.window_id) group by label")
def row_confidence(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    return base.withColumn("m", F.array_max(arrays.normalized(F.col("phi")))).groupBy("label").agg(F.round(F.avg("m"), 6).alias("confidence"))


def edge_list(edges: DataFrame) -> list[tuple[int, int, float]]:
    """Edges of one graph over few variables."""
    return [(r.src, r.dst, r.w) for r in edges.select("src", "dst", "w").collect()]


def vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.correlation_graph(adapters.vectors(spark, sf_dir), THRESHOLD)


EDGES = f"edges as (select a.var as src, b.var as dst, abs(corr(a.x, b.x)) as w from cells a join cells b on a.window_id = b.window_id and a.var < b.var group by 1, 2 having abs(corr(a.x, b.x)) > {THRESHOLD})"
PRUNED = "pruned as (select src, dst, w from (select *, row_number() over (order by w, src, dst) as r, count(*) over () as n from edges) where r > floor(n * 0.4))"


def propagation(graph: str, weight: str, steps: int = 20) -> str:
    out = [f"deg as (select src, sum({weight}) as s from {graph} group by src)", f"m as (select e.src, e.dst, e.{weight} / d.s as p from {graph} e join deg d on e.src = d.src)"]
    out.append("zn as (select window_id, var, root, z / (max(z) over (partition by window_id) + 1e-9) as z from z)")
    out.append("f0 as (select window_id, var, z as f from zn)")
    for k in range(steps):
        out.append(
            f"f{k + 1} as (select zn.window_id, zn.var, 0.5 * zn.z + 0.5 * coalesce(g.f, 0) as f from zn left join (select f.window_id, m.src, sum(f.f * m.p) as f from f{k} f join m on f.var = m.dst group by 1, 2) g on g.window_id = zn.window_id and g.src = zn.var)"
        )
    return ", ".join(out)


@query("proprank", f"{BASE}, {EDGES}, {propagation('edges', 'w')} select window_id, round(sum(f), 5) as total, round(max(f), 5) as top from f20 group by window_id")
def proprank(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    phi = base.select("window_id", attribution.proprank(F.col("phi"), edge_list(vector_graph(spark, sf_dir)), SIZE).alias("phi"))
    return phi.select("window_id", F.round(arrays.total(F.col("phi")), 5).alias("total"), F.round(F.array_max("phi"), 5).alias("top"))


@query("gcn_rank", f"""{BASE}, {EDGES}, av as (select dst as i, src as j, 1.0 as a from edges union all select distinct var, var, 1.0 from cells),
an as (select i, j, sum(a) as a from av group by i, j), ar as (select i, sum(a) as s from an group by i), ah as (select an.i, an.j, an.a / ar.s as a from an join ar on an.i = ar.i),
h0 as (select window_id, var, z / (max(z) over (partition by window_id) + 1e-9) as h from z),
h1 as (select h.window_id, ah.j as var, (exp(2 * sum(h.h * ah.a)) - 1) / (exp(2 * sum(h.h * ah.a)) + 1) as h from h0 h join ah on h.var = ah.i group by 1, 2),
h2 as (select h.window_id, ah.j as var, (exp(2 * sum(h.h * ah.a)) - 1) / (exp(2 * sum(h.h * ah.a)) + 1) as h from h1 h join ah on h.var = ah.i group by 1, 2)
select window_id, round(sum(h), 5) as total, round(max(h), 5) as top from h2 group by window_id""")
def gcn_rank(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    phi = base.select("window_id", attribution.gcn_rank(F.col("phi"), edge_list(vector_graph(spark, sf_dir)), SIZE).alias("phi"))
    return phi.select("window_id", F.round(arrays.total(F.col("phi")), 5).alias("total"), F.round(F.array_max("phi"), 5).alias("top"))


@query("graa_v4", f"""{BASE}, {EDGES}, {PRUNED}, {propagation('pruned', 'w')}, gate as (select coalesce(avg(w), 0) as g from pruned),
sz as (select window_id, sum(z + 1e-12) as s from z group by window_id), sf as (select window_id, sum(f + 1e-12) as s from f20 group by window_id),
phi as (select z.window_id, z.var, z.root, g.g * (f.f + 1e-12) / sf.s + (1 - g.g) * (z.z + 1e-12) / sz.s as phi from z join f20 f on f.window_id = z.window_id and f.var = z.var
  join sz on sz.window_id = z.window_id join sf on sf.window_id = z.window_id cross join gate g)
select window_id, round(max(phi), 6) as top, max(case when var = root and r <= 3 then 1 else 0 end) as hit3 from (select *, row_number() over (partition by window_id order by phi desc, var) as r from phi) group by window_id""")
def graa_v4(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    pruned = graphs.prune(vector_graph(spark, sf_dir), 0.4)
    gate = attribution.graa_gate(pruned).first().gate
    z = base.withColumn("prop", attribution.proprank(F.col("phi"), edge_list(pruned), SIZE))
    phi = z.withColumn("graa", attribution.mixed(F.lit(gate), F.col("prop"), F.col("phi")))
    return phi.select("window_id", F.round(F.array_max("graa"), 6).alias("top"), arrays.hit(F.col("graa"), F.col("roots"), 3).alias("hit3"))


@query("graa_gate_variants", f"""with {CELLS}, {EDGES}, {PRUNED}, srt as (select w, row_number() over (order by w) as r, count(*) over () as n from pruned)
select round((select avg(w) from pruned), 6) as mean, round((select quantile_cont(w, 0.5) from pruned), 6) as median, round((select max(w) from pruned), 6) as max,
round((select avg(w) from srt where r > greatest(1, n // 10) and r <= n - greatest(1, n // 10)), 6) as trimmed,
round((select least(greatest(1 - avg(w), 0.1), 0.6) from edges), 6) as adaptive_share""")
def graa_gate_variants(spark, sf_dir):
    edges = vector_graph(spark, sf_dir)
    pruned = graphs.prune(edges, 0.4)
    out = graphs.adaptive_share(edges).select(F.round("share", 6).alias("adaptive_share"))
    for how in ("mean", "median", "max", "trimmed"):
        out = out.join(attribution.graa_gate(pruned, how=how, none=None).select(F.round("gate", 6).alias(how)))
    return out


@query("random_attribution", f"""with {CELLS}, r as (select window_id, var, {u('0', 'window_id', 'var')} as v from cells) select window_id, round(sum(v), 6) as total, round(max(v), 6) as top from r group by window_id""")
def random_attribution(spark, sf_dir):
    phi = adapters.vectors(spark, sf_dir).select("window_id", attribution.random_phi(F.col("window_id"), SIZE).alias("phi"))
    return phi.select("window_id", F.round(arrays.total(F.col("phi")), 6).alias("total"), F.round(F.array_max("phi"), 6).alias("top"))


@query("acr_at_k", f"{BASE}, {NOISE} select instance, round(avg(acr), 6) as acr, round(avg(hit3), 6) as hit3, count(*) as n from acrs group by instance")
def acr_at_k(spark, sf_dir):
    return audited(spark, sf_dir).groupBy("instance").agg(F.round(F.avg("acr"), 6).alias("acr"), F.round(F.avg("hit3"), 6).alias("hit3"), F.count("*").alias("n"))


@query("cell_records", f"""{BASE}, {NOISE}, per as (select label, instance, avg(acr) as acr, avg(hit3) as h, count(*) as n from acrs group by 1, 2)
select label, round(avg(acr), 6) as acr, round(avg(h), 6) as hit3_pert, max(n) as n_windows from per group by label""")
def cell_records(spark, sf_dir):
    c = metrics.cells(audited(spark, sf_dir), ("label",))
    return c.select("label", F.round("acr", 6).alias("acr"), F.round("hit3_pert", 6).alias("hit3_pert"), "n_windows")


@query("quadrants", f"""{BASE}, {NOISE}, w as (select label, window_id, avg(acr) as acr, avg(hit3) as hit from acrs group by 1, 2)
select label, count(*) as n, round(avg(case when acr > 0.8 and hit < 0.4 then 1.0 else 0 end), 6) as sw, round(avg(case when acr > 0.8 and hit >= 0.4 then 1.0 else 0 end), 6) as sr,
round(avg(case when acr <= 0.8 and hit >= 0.4 then 1.0 else 0 end), 6) as ur, round(avg(case when acr <= 0.8 and hit < 0.4 then 1.0 else 0 end), 6) as uw
from w group by grouping sets ((), (label))""")
def quadrants(spark, sf_dir):
    w = audited(spark, sf_dir).groupBy("label", "window_id").agg(F.avg("acr").alias("acr"), F.avg("hit3").alias("hit"))
    q = metrics.quadrant_shares(w, "acr", "hit", (), ("label",))
    return q.select("label", "n", *[F.round(c, 6).alias(c) for c in ("sw", "sr", "ur", "uw")])


@query("sw_grid", f"""{BASE}, {NOISE}, w as (select window_id, avg(acr) as acr, avg(hit3) as hit from acrs group by 1), s as (select unnest([0.6, 0.7, 0.8, 0.9])::double as stable), r as (select unnest([0.3, 0.4, 0.5])::double as "right")
select stable, "right", round(avg(case when acr > stable and hit < "right" then 1.0 else 0 end), 6) as sw from w, s, r group by 1, 2""")
def sw_grid(spark, sf_dir):
    w = audited(spark, sf_dir).groupBy("window_id").agg(F.avg("acr").alias("acr"), F.avg("hit3").alias("hit"))
    g = metrics.threshold_grid(w, "acr", "hit", [0.6, 0.7, 0.8, 0.9], [0.3, 0.4, 0.5])
    return g.withColumn("sw", F.round("sw", 6))


@query("window_stable_wrong", f"""{BASE}, {NOISE}, w as (select label, window_id, avg(acr) as cons, max(hit3) as hit from acrs group by 1, 2)
select label, round(avg(case when cons > 0.8 and hit = 0 then 1.0 else 0 end), 6) as sw from w group by label""")
def window_stable_wrong(spark, sf_dir):
    w = audited(spark, sf_dir).groupBy("label", "window_id").agg(F.avg("acr").alias("cons"), F.max("hit3").alias("hit"))
    return w.groupBy("label").agg(F.round(F.avg(((F.col("cons") > 0.8) & (F.col("hit") == 0)).cast("int")), 6).alias("sw"))


@query("consistency_features", f"""{BASE}, {NOISE}, a0 as (select window_id, arg_max(var, (z, -var)) as a from z group by window_id), am as (select window_id, instance, arg_max(var, (z, -var)) as a from zp group by 1, 2),
t as (select am.window_id, avg(case when am.a = a0.a then 1.0 else 0 end) as c from am join a0 on a0.window_id = am.window_id group by 1)
select a.window_id, round(avg(a.acr), 6) as c_cons_topk3, round(max(t.c), 6) as c_cons_top1 from acrs a join t on t.window_id = a.window_id group by 1""")
def consistency_features(spark, sf_dir):
    a = audited(spark, sf_dir)
    same = (F.get(arrays.topk(F.col("phi"), 1), F.lit(0)) == F.get(arrays.topk(F.col("phi0"), 1), F.lit(0))).cast("int")
    return a.groupBy("window_id").agg(F.round(F.avg("acr"), 6).alias("c_cons_topk3"), F.round(F.avg(same), 6).alias("c_cons_top1"))


@query("instance_prefixes", f"{BASE}, {NOISE} select " + ", ".join(f"round(avg(case when instance < {m} then acr end), 6) as acr_m{m}" for m in (2, 4, 8)) + " from acrs")
def instance_prefixes(spark, sf_dir):
    p = metrics.prefix_means(audited(spark, sf_dir), (2, 4, 8))
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


@query("rbo_to_roots", f"""{BASE}, pr as (select window_id, root, var, row_number() over (partition by window_id order by z desc, var) as r from z),
gr as (select window_id, var, row_number() over (partition by window_id order by case when var = root then 0 else 1 end, var) as g from z),
d as (select unnest(range(1, 11)) as d), o as (select d.d, p.window_id, sum(case when p.r <= d.d and g.g <= d.d then 1 else 0 end) as c from pr p join gr g on g.window_id = p.window_id and g.var = p.var, d where p.r <= 10 and g.g <= 10 group by 1, 2),
w as (select window_id, d from (select distinct window_id from z), d)
select w.window_id, round(sum(pow(0.9, w.d - 1) * coalesce(o.c, 0) / w.d) / sum(pow(0.9, w.d - 1)), 6) as rbo from w left join o on o.window_id = w.window_id and o.d = w.d group by 1""")
def rbo_to_roots(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    rest = F.array_except(F.sequence(F.lit(0), F.lit(SIZE - 1)), F.col("roots"))
    truth = F.slice(F.concat(F.array_sort("roots"), rest), 1, 10)
    rows = base.select("window_id", F.slice(arrays.ranking(F.col("phi")), 1, 10).alias("a"), truth.alias("b"))
    return rows.select("window_id", F.round(arrays.rbo(F.col("a"), F.col("b")), 6).alias("rbo"))


@query("episode_accuracy", f"""{BASE}, t as (select *, row_number() over (partition by window_id order by z desc, var) as r from z)
select label, round(avg(ac), 6) as ac3, round(avg(pr), 6) as prec3 from (select window_id, label, sum(case when r <= 3 and var = root then 1.0 else 0 end) / least(3, 1) as ac, sum(case when r <= 3 and var = root then 1.0 else 0 end) / 3 as pr from t group by 1, 2) group by label""")
def episode_accuracy(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    phi, roots = F.col("phi"), F.col("roots")
    return base.groupBy("label").agg(F.round(F.avg(metrics.ac_at_k(phi, roots, 3)), 6).alias("ac3"), F.round(F.avg(metrics.precision3(phi, roots)), 6).alias("prec3"))


CERT = f"""{BASE}, {NOISE}, g as (select window_id, max(case when r = 3 then z end) - max(case when r = 4 then z end) as gap from (select window_id, z, row_number() over (partition by window_id order by z desc, var) as r from z) group by 1),
e as (select p.window_id, p.instance, max(abs(p.z - z.z)) as eta from zp p join z on z.window_id = p.window_id and z.var = p.var group by 1, 2),
ef as (select e.window_id, e.instance, e.eta, case when a.acr < 0.99 then 1.0 else 0 end as flip from e join acrs a on a.window_id = e.window_id and a.instance = e.instance)"""


@query("certificates", f"""{CERT}, c as (select window_id, max(case when instance < 4 then eta end) as em, quantile_cont(case when instance < 4 then eta end, 0.5) as e50, quantile_cont(case when instance < 4 then eta end, 0.75) as e75,
avg(case when instance >= 4 then flip end) as fe, max(case when instance >= 4 then eta end) as ee from ef group by 1)
select c.window_id, round(g.gap, 6) as gap, round(em, 6) as eta_max, round(fe, 6) as flip_eval, round(e50, 6) as eta50, round(e75, 6) as eta75, cast(ee > em as int) as violated,
cast(gap > 2 * em as int) as cert_worst, cast(gap > 2 * e50 as int) as cert_emp50, cast(gap > 2 * e75 as int) as cert_emp75 from c join g on g.window_id = c.window_id""")
def certificates(spark, sf_dir):
    base, held, _ = setup(spark, sf_dir)
    c = metrics.certificates(base.select("window_id", "phi"), noisy(base, held).select("window_id", "instance", "phi", "phi0"), ("window_id",), 4)
    return c.select("window_id", *[F.round(x, 6).alias(x) for x in ("gap", "eta_max", "flip_eval", "eta50", "eta75")], "violated", "cert_worst", "cert_emp50", "cert_emp75")


@query("certificate_coverage", f"""{CERT}, c as (select e.window_id, max(g.gap) as gap, max(eta) as em, max(a.h) as hit from ef e join g on g.window_id = e.window_id join (select window_id, max(case when var = root then 1 else 0 end) as h from top0 group by 1) a on a.window_id = e.window_id group by 1)
select round(avg(case when gap > 2 * em then 1.0 else 0 end), 6) as coverage, count(*) filter (gap > 2 * em) as certified, count(*) filter (gap > 2 * em and hit = 0) as certified_wrong from c""")
def certificate_coverage(spark, sf_dir):
    base, held, _ = setup(spark, sf_dir)
    c = metrics.certificates(base.select("window_id", "phi"), noisy(base, held).select("window_id", "instance", "phi", "phi0"), ("window_id",), 8)
    h = base.select("window_id", arrays.hit(F.col("phi"), F.col("roots"), 3).alias("hit"))
    ok = F.col("cert_worst") == 1
    return c.join(h, "window_id").agg(F.round(F.avg("cert_worst"), 6).alias("coverage"), F.count_if(ok).alias("certified"), F.count_if(ok & (F.col("hit") == 0)).alias("certified_wrong"))


@query("signed_margin", f"""{BASE}, {NOISE} select p.window_id, round(min(i) , 6) as least_margin from (
select p.window_id, p.instance, min(case when t.var is not null then p.z end) - max(case when t.var is null then p.z end) as i from zp p left join top0 t on t.window_id = p.window_id and t.var = p.var group by 1, 2) p group by 1""")
def signed_margin(spark, sf_dir):
    base, held, _ = setup(spark, sf_dir)
    return noisy(base, held).groupBy("window_id").agg(F.round(F.min(metrics.signed_margin(F.col("phi0"), F.col("phi"))), 6).alias("least_margin"))


@query("consensus_set", f"""{BASE}, {NOISE}, every as (select window_id, var from top0 union all select window_id, var from topm), c as (select window_id, var, count(*) as c from every group by 1, 2)
select window_id, string_agg(cast(var as varchar), ',' order by var) as vars from c where c >= 0.8 * 9 group by 1""")
def consensus_set(spark, sf_dir):
    base, held, _ = setup(spark, sf_dir)
    c = metrics.consensus(noisy(base, held).select("window_id", "phi").unionByName(base.select("window_id", "phi")), ("window_id",), 0.8)
    return c.select("window_id", F.array_join(F.transform("vars", lambda v: v.cast("string")), ",").alias("vars"))


@query("method_disagreement", f"""{BASE}, {EDGES}, {propagation('edges', 'w')}, ph as (select window_id, var, 'a' as method, z as phi from z union all select window_id, var, 'b', round(f, 9) from f20 union all select window_id, var, 'c', {u('0', 'window_id', 'var')} from z),
t as (select window_id, method, var from (select *, row_number() over (partition by window_id, method order by phi desc, var) as r from ph) where r <= 3),
p as (select a.window_id, a.method as m1, b.method as m2, count(case when a.var = b.var then 1 end) / 3.0 as o from t a join t b on a.window_id = b.window_id and a.method < b.method group by 1, 2, 3)
select window_id, round(avg(1 - o), 6) as disagreement from p group by 1""")
def method_disagreement(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    edges = edge_list(vector_graph(spark, sf_dir))
    prop = F.transform(attribution.proprank(F.col("phi"), edges, SIZE), lambda v: F.round(v, 9))
    each = {"a": F.col("phi"), "b": prop, "c": attribution.random_phi(F.col("window_id"), SIZE)}
    rows = None
    for name, phi in each.items():
        part = base.select("window_id", F.lit(name).alias("method"), phi.alias("phi"))
        rows = part if rows is None else rows.unionByName(part)
    return metrics.disagreement(rows, ("window_id",)).withColumn("disagreement", F.round("disagreement", 6))


@query("top_jaccard", f"""{BASE}, {NOISE}, i as (select m.window_id, m.instance, count(t.var) as c from topm m left join top0 t on t.window_id = m.window_id and t.var = m.var group by 1, 2)
select window_id, round(avg(c / (6.0 - c)), 6) as jaccard from i group by 1""")
def top_jaccard(spark, sf_dir):
    a = audited(spark, sf_dir)
    x, y = arrays.topk(F.col("phi"), 3), arrays.topk(F.col("phi0"), 3)
    return a.groupBy("window_id").agg(F.round(F.avg(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))), 6).alias("jaccard"))


@query("root_widening", f"""{BASE}, {EDGES}, r as (select distinct window_id, root from z),
k as (select window_id, root as v from r union select r.window_id, e.dst from r join edges e on e.src = r.root join z on z.window_id = r.window_id and z.var = e.dst where z.z > 3)
select window_id, string_agg(cast(v as varchar), ',' order by v) as wide from k group by 1""")
def root_widening(spark, sf_dir):
    base, _, _ = setup(spark, sf_dir)
    z = base.select("window_id", F.posexplode("phi").alias("var", "z"))
    w = metrics.widened_roots(base.select("window_id", "roots"), vector_graph(spark, sf_dir), z)
    return w.select("window_id", F.array_join(F.transform("wide", lambda v: v.cast("string")), ",").alias("wide"))


@query("rank_ensemble", f"""{BASE}, {NOISE}, s as (select window_id, instance, var, (rank() over (partition by window_id, instance order by z) + (count(*) over (partition by window_id, instance, z) - 1) / 2.0 - 1) / 63.0 as s from zp),
m as (select window_id, var, avg(s) as s from s group by 1, 2)
select window_id, round(max(s), 6) as top, arg_max(var, (round(s, 9), -var)) as var from m group by 1""")
def rank_ensemble(spark, sf_dir):
    base, held, _ = setup(spark, sf_dir)
    ranked = noisy(base.where("phi is not null"), held).select("window_id", arrays.midranks(F.col("phi")).alias("r"))
    # A row per window with a mean for each variable: variables don't become rows before they are averaged.
    m = ranked.groupBy("window_id").agg(F.array(*[F.avg((F.get("r", F.lit(i)) - 1) / (SIZE - 1)) for i in range(SIZE)]).alias("s"))
    best = F.element_at(arrays.topk(F.transform("s", lambda s: F.round(s, 9)), 1), 1)
    return m.select("window_id", F.round(F.array_max("s"), 6).alias("top"), best.alias("var"))


@query("deletion_faithfulness", f"""{BASE}, s as (select i.window_id, sum(z.z * z.z) as s0, sum(case when t.var is null then z.z * z.z else pow((s.mean - s.med) / s.mad, 2) end) as s1
from inj i join z on z.window_id = i.window_id and z.var = i.var join stats s on s.var = i.var left join (select window_id, var from (select *, row_number() over (partition by window_id order by z desc, var) as r from z) where r <= 3) t on t.window_id = i.window_id and t.var = i.var group by 1)
select window_id, round((s0 - s1) / greatest(abs(s0), 1e-9), 6) as drop3 from s""")
def deletion_faithfulness(spark, sf_dir):
    base, held, _ = setup(spark, sf_dir)
    at_mean = attribution.zdev(attribution.literal(held["mean"]), held)
    rows = base.select("window_id", "phi", arrays.topk(F.col("phi"), 3).alias("top"), at_mean.alias("m"))
    left = F.transform("phi", lambda v, i: F.when(F.array_contains("top", i), F.get("m", i)).otherwise(v))
    s0, s1 = arrays.dot(F.col("phi"), F.col("phi")), arrays.dot(left, left)
    return rows.select("window_id", F.round((s0 - s1) / F.greatest(F.abs(s0), F.lit(1e-9)), 6).alias("drop3"))


def frame(spark: SparkSession, sf_dir: str):
    base, held, _ = setup(spark, sf_dir)
    return base, held, adapters.vectors(spark, sf_dir)


def scored(phi: DataFrame) -> DataFrame:
    return phi.select("window_id", F.array_join(F.transform(arrays.topk(F.col("phi"), 3), lambda v: v.cast("string")), ",").alias("top3"), arrays.hit(F.col("phi"), F.col("roots"), 3).alias("hit3"))


@query("dpta_g")
def dpta_g(spark, sf_dir):
    base, held, pool = frame(spark, sf_dir)
    models = attribution.ridge_models(attribution.gram(pool), edge_list(vector_graph(spark, sf_dir)))
    rows = base.withColumn("r", attribution.residual_z(F.col("values"), models, held))
    return scored(rows.withColumn("phi", attribution.dpta(F.col("phi"), F.col("r"))))


@query("global_cf")
def global_cf(spark, sf_dir):
    base, _, pool = frame(spark, sf_dir)
    return scored(base.withColumn("phi", scorers.PcaScorer(pool).counterfactual("values")))


@query("grad_pca")
def grad_pca(spark, sf_dir):
    base, _, pool = frame(spark, sf_dir)
    return scored(base.withColumn("phi", scorers.PcaScorer(pool).gradient("values")))


@query("ae_reconstruction")
def ae_reconstruction(spark, sf_dir):
    base, _, pool = frame(spark, sf_dir)
    return scored(base.withColumn("phi", scorers.AutoEncoder(pool).attribution("values")))


@query("cond_attr")
def cond_attr(spark, sf_dir):
    base, _, pool = frame(spark, sf_dir)
    phi = attribution.conditional(pool, base)
    return scored(base.drop("phi").join(phi, "window_id"))


@query("scorer_auroc")
def scorer_auroc(spark, sf_dir):
    """Detection AUROC of each scorer: pool windows against the injected ones."""
    pool = adapters.vectors(spark, sf_dir)
    return detection(pool, adapters.injected(pool))


def detection(pool: DataFrame, bad: DataFrame) -> DataFrame:
    """AUROC of each scorer, fitted on the pool, for the windows `bad` against those of the pool."""
    both = pool.select("values", F.lit(0).alias("y")).unionByName(bad.select("values", F.lit(1).alias("y")))
    s = scorers.scored(both, {kind: scorers.make_scorer(kind, pool) for kind in scorers.SCORERS})
    return statistics.auroc(s, "y", "s", ("scorer",)).select("scorer", F.round("auroc", 4).alias("auroc"))
