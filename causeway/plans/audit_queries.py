"""The audit on graphs, inputs and windows of several steps: the grid, its references, certificates by strength, filters of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import arrays, hashing
from causeway.operators import attribution, graphs, methods, metrics, scorers, statistics
from causeway.plans.attribution_queries import EDGES, SIZE, THRESHOLD, detection, edge_list, noisy, setup, vector_graph
from causeway.plans.core import BASE, CELLS, NOISE, STATS, noise, query, u
from causeway.sources import adapters

# ---- SQL of propagation along any graph, for any number of instances


def along(name: str, graph: str, instance: str = "", steps: int = 20, instances: str = "") -> str:
    """CTEs {name}0 .. {name}{steps} of PropRank over z along `graph` (src, dst, w), with an instance column if one is named. instances: a
    table of all instances, where there may be some without an edge: their scores are those of a graph without edges."""
    i, on = (f"{instance}, ", f"and e.{instance} = d.{instance}") if instance else ("", "")
    of, same, groups = (f"i.{instance}, ", f"and g.{instance} = i.{instance}", "1, 2, 3") if instance else ("", "", "1, 2")
    every = f", (select distinct {instance} from {instances or graph}) i" if instance else ""
    out = [
        f"{name}_deg as (select {i}src, sum(w) as s from {graph} group by {i}src)", f"{name}_m as (select {'e.' + i if i else ''}e.src, e.dst, e.w / d.s as p from {graph} e join {name}_deg d on e.src = d.src {on})",
        f"{name}_z as (select {of}z.window_id, z.var, z.root, z.z / (max(z.z) over (partition by {of}z.window_id) + 1e-9) as z from z{every})", f"{name}0 as (select {i}window_id, var, z as f from {name}_z)",
    ]
    for k in range(steps):
        m_i = f"f.{instance}, " if instance else ""
        join = f"f.var = m.dst and f.{instance} = m.{instance}" if instance else "f.var = m.dst"
        out.append(
            f"{name}{k + 1} as (select {of}i.window_id, i.var, 0.5 * i.z + 0.5 * coalesce(g.f, 0) as f from {name}_z i left join (select {m_i}f.window_id, m.src, sum(f.f * m.p) as f from {name}{k} f join {name}_m m on {join} group by {groups}) g on g.window_id = i.window_id and g.src = i.var {same})"
        )
    return ", ".join(out)


def three(name: str, table: str, value: str, keys: str = "window_id") -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by {keys} order by {value} desc, var) as r from {table}) where r <= 3)"


def deleted(strength: float, instances: int, graph: str = "edges") -> str:
    """dels: the graph with its edges deleted by draws, instance by instance; asked: the instances, also those that no edge is left of."""
    return f"asked as (select unnest(range({instances}))::int as instance), dels as (select m as instance, src, dst, w from {graph}, (select unnest(range({instances}))::int as m) where {u(chr(39) + 'del' + chr(39), chr(39) + str(strength) + chr(39), 'm', 'src', 'dst')} >= {strength})"


def matrix(edges) -> np.ndarray:
    return graphs.weights(edge_list(edges), SIZE)


def audited_windows(spark, sf_dir):
    return adapters.injected(adapters.vectors(spark, sf_dir)).select("window_id", "label", "values", "roots")


def contaminated(spark, sf_dir):
    """The pool and half of the injected windows."""
    pool = adapters.vectors(spark, sf_dir)
    half = adapters.injected(pool).where(hashing.uniform("mix", F.col("window_id")) < 0.5)
    return pool.select("values").unionByName(half.select("values"))


#: Graph sources by name: each a function of (spark, folder) to an edge table.
SOURCES = {
    "clean": vector_graph,
    "contaminated": lambda spark, sf_dir: graphs.correlation_graph(contaminated(spark, sf_dir), THRESHOLD),
    "strong": lambda spark, sf_dir: vector_graph(spark, sf_dir).where("w > 0.12"),
}


def source(name: str, spark, sf_dir):
    if name not in SOURCES:
        raise ValueError(f"unknown graph source {name}")
    return SOURCES[name](spark, sf_dir)


MIXED = f"""mixc as (select row_number() over () as id, v from (select embedding as v from embeddings union all
  select list_transform(range(64), lambda i: embedding[i + 1]::double + case when i = cast(floor({u('0', 'vec_id', chr(39) + 'root' + chr(39))} * 64) as int) then 0.35::double else 0.0 end) from embeddings where {u("'mix'", 'vec_id')} < 0.5)),
mixx as (select id, unnest(v)::double as x, unnest(range(64))::int as var from mixc),
mixed as (select a.var as src, b.var as dst, abs(corr(a.x, b.x)) as w from mixx a join mixx b on a.id = b.id and a.var < b.var group by 1, 2 having abs(corr(a.x, b.x)) > {THRESHOLD})"""


@query("graph_sources", f"with {CELLS}, {EDGES}, {MIXED} select 'clean' as source, src, dst, round(w, 6) as w from edges union all select 'contaminated', src, dst, round(w, 6) from mixed union all select 'strong', src, dst, round(w, 6) from edges where w > 0.12")
def graph_sources(spark, sf_dir):
    """Graphs learnt on the clean pool, on one with anomalies in it, and the strong edges alone."""
    out = None
    for name in SOURCES:
        part = source(name, spark, sf_dir).select(F.lit(name).alias("source"), "src", "dst", F.round("w", 6).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


#: Of the audit's scorers: those that the reference runs over the grid.
GRID_SCORERS = ("pca", "iforest", "ocsvm")


@query("audit_grid")
def audit_grid(spark, sf_dir):
    """The whole grid: all graph methods on three sources (learnt on the clean pool, on one with anomalies in it, and the reference graph)
    under deletion .1 .2 .3 .5, addition .2 .5 and rewiring .2 .5, graph-free ones and all under input noise .2 .5 and slices 1 3,
    eight instances each, by scorer. Methods on one graph or none take one pass over the windows; CondAttr looks into the pool."""
    pool, windows = adapters.vectors(spark, sf_dir), audited_windows(spark, sf_dir)
    ctx = methods.fit_context(pool, rebuild=True)
    sources = {to: matrix(source(name, spark, sf_dir)) for name, to in (("clean", "clean"), ("contaminated", "contaminated"), ("strong", "true"))}
    scores = {kind: scorers.make_scorer(kind, methods.flattened(pool)).scores for kind in GRID_SCORERS}
    names = [n for n in methods.METHODS if n not in ("GraphGranger", "GRAA-v1", "GRAA-v2")]
    rows = methods.audit(windows, ctx, names, sources, methods.grid(), methods.grid(families=methods.INPUT_FAMILIES), pool=pool, by_scorer=scores)
    c = methods.cells(rows)
    return c.select("method", "scorer", "source", "family", "strength", "quadrant", "n_windows", "instances", *[F.round(x, 6).alias(x) for x in ("acr", "hit3_pert", "hit3")])


@query("audit_deletions", f"""{BASE}, {EDGES}, {deleted(0.2, 8)}, {along('b', 'edges')}, {along('p', 'dels', 'instance', instances='asked')}, {three('bt', 'b20', 'round(f, 9)')}, {three('pt', 'p20', 'round(f, 9)', 'instance, window_id')},
a as (select pt.instance, pt.window_id, count(bt.var) / 3.0 as acr, max(case when pt.var = r.root then 1.0 else 0 end) as hit from pt left join bt on bt.window_id = pt.window_id and bt.var = pt.var join roots r on r.window_id = pt.window_id group by 1, 2)
select instance, round(avg(acr), 6) as acr, round(avg(hit), 6) as hit3, count(*) as n from a group by 1""")
def audit_deletions(spark, sf_dir):
    """One slice of the grid, by instance: PropRank with a fifth of the edges deleted."""
    ctx = methods.fit_context(adapters.vectors(spark, sf_dir))
    rows = methods.audit(audited_windows(spark, sf_dir), ctx, ["PropRank"], {"clean": matrix(vector_graph(spark, sf_dir))}, [("del", 0.2, m) for m in range(8)], digits=9)
    return rows.where("family = 'del'").select("instance", F.round("acr", 6).alias("acr"), F.round("hit3", 6).alias("hit3"), "n")


@query("dual_reference", f"""{BASE}, {EDGES}, strong as (select * from edges where w > 0.12), {deleted(0.5, 4)}, {along('b', 'edges')}, {along('s', 'strong')}, {along('p', 'dels', 'instance', instances='asked')}, {three('bt', 'b20', 'round(f, 9)')}, {three('st', 's20', 'round(f, 9)')}, {three('pt', 'p20', 'round(f, 9)', 'instance, window_id')}
select pt.instance, round(count(bt.var) / 3.0 / count(distinct pt.window_id), 6) as acr_deployed, round(count(st.var) / 3.0 / count(distinct pt.window_id), 6) as acr_true
from pt left join bt on bt.window_id = pt.window_id and bt.var = pt.var left join st on st.window_id = pt.window_id and st.var = pt.var group by 1""")
def dual_reference(spark, sf_dir):
    """Stability against the ranking on the graph in use, and against that on the reference graph. Scores that are equal to nine decimals
    are ties, which go to the lower variable."""
    ctx, windows = methods.fit_context(adapters.vectors(spark, sf_dir)), audited_windows(spark, sf_dir)
    sources = {n: matrix(source(n, spark, sf_dir)) for n in ("clean", "strong")}
    changes = [("del", 0.5, m) for m in range(4)]
    parts = [methods.audit(windows, ctx, ["PropRank"], sources, changes, reference=r, digits=9).where("source = 'clean' and family = 'del'").select("instance", F.round("acr", 6).alias(name)) for r, name in ((None, "acr_deployed"), ("strong", "acr_true"))]
    return parts[0].join(parts[1], "instance")


ABLATION = f"""pr as (select src, dst, w from (select *, row_number() over (order by w, src, dst) as r, count(*) over () as n from edges) where r > floor(n * 0.4)),
rp as (select src, dst, w from (select *, row_number() over (order by {u("'prune'", 'src', 'dst')}, src, dst) as r, count(*) over () as n from edges) where r > floor(n * 0.4))"""


@query("graa_ablations", f"""{BASE}, {EDGES}, {ABLATION}, {along('a', 'pr')}, {along('b', 'edges')}, {along('c', 'rp')}, zs as (select window_id, var, root, (z + 1e-12) / sum(z + 1e-12) over (partition by window_id) as s from z),
ph as (select 'prune_only' as variant, window_id, var, f, 1.0 as g from a20 union all select 'full', window_id, var, f, (select coalesce(avg(w), 0) from pr) from a20 union all select 'fixed_gate', window_id, var, f, 0.5 from b20 union all select 'random_prune', window_id, var, f, (select coalesce(avg(w), 0) from rp) from c20),
sh as (select variant, window_id, var, g, (f + 1e-12) / sum(f + 1e-12) over (partition by variant, window_id) as f from ph), mx as (select sh.variant, sh.window_id, sh.var, zs.root, round(g * f + (1 - g) * s, 9) as phi from sh join zs on zs.window_id = sh.window_id and zs.var = sh.var),
{three('t', 'mx', 'phi', 'variant, window_id')} select variant, round(sum(case when var = root then 1.0 else 0 end) / count(distinct window_id), 6) as hit3 from t group by 1""")
def graa_ablations(spark, sf_dir):
    """GRAA v4 whole, with pruning alone, with a fixed gate alone, and with random pruning."""
    windows, a = audited_windows(spark, sf_dir), matrix(vector_graph(spark, sf_dir))
    ctx, out = methods.fit_context(adapters.vectors(spark, sf_dir)), None
    for variant in ("full", "prune_only", "fixed_gate", "random_prune"):
        fn = methods.graa(ctx.with_options(variant=variant), a)
        phi = methods.scores(windows, ctx, lambda x, fn=fn: np.round(fn(x), 9))
        row = phi.agg(F.round(F.avg(arrays.hit(F.col("phi"), F.col("roots"), 3)), 6).alias("hit3")).select(F.lit(variant).alias("variant"), "hit3")
        out = row if out is None else out.unionByName(row)
    return out


@query("dpta_fusion")
def dpta_fusion(spark, sf_dir):
    """DPTA with half and half, and with weights by concentration."""
    windows, a = audited_windows(spark, sf_dir), matrix(vector_graph(spark, sf_dir))
    ctx, out = methods.fit_context(adapters.vectors(spark, sf_dir)), None
    for fusion in ("mean", "entropy"):
        phi = methods.scores(windows, ctx, methods.dpta(ctx.with_options(fusion=fusion), a))
        row = phi.groupBy("label").agg(F.round(F.avg(arrays.hit(F.col("phi"), F.col("roots"), 3)), 6).alias("hit3")).withColumn("fusion", F.lit(fusion))
        out = row if out is None else out.unionByName(row)
    return out


# ---- windows of several steps: a vector of 64 numbers as 8 steps of 8 variables

STEPS, VARS = 8, 8
STEP_CELLS = "cells as (select vec_id as window_id, label, x, idx % 8 as var, idx // 8 as step from (select vec_id, label, unnest(embedding)::double as x, unnest(range(64))::int as idx from embeddings))"
STEP_ROOTS = f"roots as (select vec_id as window_id, label, cast(floor({u('0', 'vec_id', chr(39) + 'root' + chr(39))} * 8) as int) as root from embeddings)"
STEP_Z = """inj as (select c.window_id, c.label, c.var, c.step, c.x + case when c.var = r.root and c.step >= 4 then 0.35::double else 0.0 end as x, r.root from cells c join roots r on c.window_id = r.window_id),
z as (select i.window_id, any_value(i.label) as label, i.var, any_value(i.root) as root, avg(abs(i.x - s.med) / s.mad) as z from inj i join stats s on i.var = s.var group by i.window_id, i.var)"""
STEP_BASE = f"with {STEP_CELLS}, {STATS}, {STEP_ROOTS}, {STEP_Z}"
STEP_EDGES = "edges as (select a.var as src, b.var as dst, abs(corr(a.x, b.x)) as w from cells a join cells b on a.window_id = b.window_id and a.step = b.step and a.var < b.var group by 1, 2 having abs(corr(a.x, b.x)) > 0.01)"


def step_windows(spark, sf_dir):
    """(window_id, label, values: 8 steps of 8 variables)."""
    v = F.col("values")
    return adapters.vectors(spark, sf_dir).select("window_id", "label", F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda s: F.slice(v, s * VARS + 1, VARS)).alias("values"))


def step_injected(windows):
    """A step of 0.35 added to one hashed variable in the second half."""
    root = F.floor(hashing.uniform(0, F.col("window_id"), "root") * VARS).cast("int")
    rows = windows.withColumn("root", root)
    moved = F.transform("values", lambda step, s: F.transform(step, lambda x, i: x + F.when((s >= STEPS // 2) & (i == F.col("root")), F.lit(0.35)).otherwise(0.0)))
    return rows.withColumn("values", moved).withColumn("roots", F.array("root")).drop("root")


def step_graph(spark, sf_dir):
    return graphs.correlation_graph(methods.steps(step_windows(spark, sf_dir)), 0.01)


@query("steps_zdev", f"{STEP_BASE}, {three('t', 'z', 'z')} select label, round(sum(case when var = root then 1.0 else 0 end) / count(distinct window_id), 6) as hit3, round(avg(case when r = 1 then z end), 5) as top from t group by 1")
def steps_zdev(spark, sf_dir):
    """zDev on windows of eight steps."""
    pool = step_windows(spark, sf_dir)
    ctx = methods.fit_context(pool)
    phi = methods.scores(step_injected(pool), ctx, methods.zdev(ctx, None))
    return phi.groupBy("label").agg(F.round(F.avg(arrays.hit(F.col("phi"), F.col("roots"), 3)), 6).alias("hit3"), F.round(F.avg(F.array_max("phi")), 5).alias("top"))


@query("steps_proprank", f"{STEP_BASE}, {STEP_EDGES}, {along('b', 'edges')} select window_id, round(sum(f), 5) as total, round(max(f), 5) as top from b20 group by 1")
def steps_proprank(spark, sf_dir):
    pool = step_windows(spark, sf_dir)
    ctx = methods.fit_context(pool)
    phi = methods.scores(step_injected(pool), ctx, methods.proprank(ctx, graphs.weights(edge_list(step_graph(spark, sf_dir)), VARS)))
    return phi.select("window_id", F.round(arrays.total(F.col("phi")), 5).alias("total"), F.round(F.array_max("phi"), 5).alias("top"))


@query("steps_methods")
def steps_methods(spark, sf_dir):
    """All methods on windows of eight steps, unperturbed and under the whole grid of perturbations."""
    pool = step_windows(spark, sf_dir)
    ctx = methods.fit_context(pool, rebuild=True)
    rows = methods.audit(step_injected(pool), ctx, list(methods.METHODS), {"clean": graphs.weights(edge_list(step_graph(spark, sf_dir)), VARS)}, methods.grid(), methods.grid(families=methods.INPUT_FAMILIES), pool=pool)
    return methods.cells(rows).select("method", "source", "family", "strength", "n_windows", *[F.round(c, 6).alias(c) for c in ("acr", "hit3_pert", "hit3")])


@query("steps_scorers")
def steps_scorers(spark, sf_dir):
    """Detection AUROC of each scorer on flattened windows of eight steps."""
    pool = step_windows(spark, sf_dir)
    return detection(methods.flattened(pool), methods.flattened(step_injected(pool)))


@query("flat_windows", f"with {STEP_CELLS} select window_id, count(*) as cells, round(sum(x * (step * 8 + var)), 5) as moment from cells group by 1")
def flat_windows(spark, sf_dir):
    """A window of steps as one array, step after step."""
    flat = methods.flattened(step_windows(spark, sf_dir))
    return flat.select("window_id", F.size("values").cast("long").alias("cells"), F.round(arrays.total(F.transform("values", lambda x, i: x * i)), 5).alias("moment"))


@query("ae_gradient")
def ae_gradient(spark, sf_dir):
    """Gradient attribution of the autoencoder's score: hits at 3 by label."""
    pool = adapters.vectors(spark, sf_dir)
    phi = audited_windows(spark, sf_dir).withColumn("phi", scorers.AutoEncoder(pool).gradient("values"))
    return phi.groupBy("label").agg(F.round(F.avg(arrays.hit(F.col("phi"), F.col("roots"), 3)), 6).alias("hit3"))


# ---- certificates, consensus, controls


def noise_sql(name: str, strength: float, low: int, high: int) -> str:
    """z under noise, instances low .. high - 1, and the displacement of each."""
    return f"""{name} as (select i.window_id, i.var, i.root, n.instance, abs(i.x + s.mad * {strength} * sqrt(-2.0 * ln(1.0 - {u('n.instance', 'i.window_id', 'i.var', "'a'")})) * cos(2 * pi() * {u('n.instance', 'i.window_id', 'i.var', "'b'")}) - s.med) / s.mad as z
from inj i join stats s on i.var = s.var, (select unnest(range({low}, {high}))::int as instance) n), {name}_e as (select p.window_id, p.instance, max(abs(p.z - z.z)) as eta from {name} p join z on z.window_id = p.window_id and z.var = p.var group by 1, 2)"""


GAP = "g as (select window_id, max(case when r = 3 then z end) - max(case when r = 4 then z end) as gap from (select window_id, z, row_number() over (partition by window_id order by z desc, var) as r from z) group by 1)"


@query("certificate_strengths", f"""{BASE}, {GAP}, {noise_sql('n1', 0.05, 0, 8)}, {noise_sql('n2', 0.2, 0, 8)}, e as (select 0.05::double as strength, * from n1_e union all select 0.2, * from n2_e), ms as (select unnest([2, 4, 8])::int as m),
c as (select strength, m, e.window_id, max(gap) as gap, max(eta) as eta from e join g on g.window_id = e.window_id, ms where instance < m group by 1, 2, 3)
select strength, m, round(avg(case when gap > 2 * eta then 1.0 else 0 end), 6) as coverage, round(avg(eta), 6) as eta from c group by 1, 2""")
def certificate_strengths(spark, sf_dir):
    """Share of certified windows by the noise's strength and by the number of instances it is estimated on."""
    base, held, _ = setup(spark, sf_dir)
    rows = None
    for strength in (0.05, 0.2):
        part = noisy(base, held, 8, strength).select("window_id", "instance", F.lit(strength).alias("strength"), metrics.gap(F.col("phi0")).alias("gap"), metrics.displacement(F.col("phi"), F.col("phi0")).alias("eta"))
        rows = part if rows is None else rows.unionByName(part)
    each = rows.withColumn("m", F.explode(F.array(*map(F.lit, (2, 4, 8))))).where(F.col("instance") < F.col("m"))
    c = each.groupBy("strength", "m", "window_id").agg(F.max("gap").alias("gap"), F.max("eta").alias("eta"))
    return c.groupBy("strength", "m").agg(F.round(F.avg((F.col("gap") > 2 * F.col("eta")).cast("int")), 6).alias("coverage"), F.round(F.avg("eta"), 6).alias("eta"))


@query("fresh_instances", f"""{BASE}, {noise_sql('n1', 0.2, 0, 28)}, c as (select window_id, max(case when instance < 8 then eta end) as em, avg(eta) filter (instance >= 8) as ef, count(*) filter (instance >= 8) as n, max(eta) filter (instance >= 8) as ee from n1_e group by 1),
v as (select e.window_id, avg(case when e.eta > c.em then 1.0 else 0 end) as v from n1_e e join c on c.window_id = e.window_id where e.instance >= 8 group by 1)
select round(avg(v), 6) as violation_rate, round(avg(case when c.ee > c.em then 1.0 else 0 end), 6) as windows_violated, max(c.n) as fresh from c join v on v.window_id = c.window_id""")
def fresh_instances(spark, sf_dir):
    """How often twenty fresh instances leave the envelope of the first eight."""
    base, held, _ = setup(spark, sf_dir)
    e = noisy(base, held, 28, 0.2).select("window_id", "instance", metrics.displacement(F.col("phi"), F.col("phi0")).alias("eta"))
    fresh = F.col("instance") >= 8
    c = e.groupBy("window_id").agg(F.max(F.when(~fresh, F.col("eta"))).alias("em"), F.collect_list(F.when(fresh, F.col("eta"))).alias("new"))
    v = c.select((F.size(F.filter("new", lambda x: x > F.col("em"))) / F.size("new")).alias("v"), F.size("new").cast("long").alias("n"))
    return v.agg(F.round(F.avg("v"), 6).alias("violation_rate"), F.round(F.avg((F.col("v") > 0).cast("int")), 6).alias("windows_violated"), F.max("n").alias("fresh"))


@query("margin_ratio", f"""{BASE}, {GAP}, {NOISE}, e as (select p.window_id, p.instance, max(abs(p.z - z.z)) as eta from zp p join z on z.window_id = p.window_id and z.var = p.var group by 1, 2),
m as (select p.window_id, p.instance, min(case when t.var is not null then p.z end) - max(case when t.var is null then p.z end) as margin from zp p left join top0 t on t.window_id = p.window_id and t.var = p.var group by 1, 2),
r as (select e.window_id, 2 * quantile_cont(e.eta, 0.5) / greatest(max(g.gap), 1e-12) as ratio from e join g on g.window_id = e.window_id where e.instance < 4 group by 1),
f as (select window_id, avg(case when margin < 0 then 1.0 else 0 end) as flip from m where instance >= 4 group by 1)
select cast(case when ratio < 1 then 0 when ratio < 2 then 1 when ratio < 5 then 2 when ratio < 10 then 3 else 4 end as int) as bin, count(*) as n, round(avg(flip), 6) as flip from r join f on f.window_id = r.window_id group by 1""")
def margin_ratio(spark, sf_dir):
    """Risk that the top three change, by bins of twice the median displacement over the gap."""
    base, held, _ = setup(spark, sf_dir)
    phi, phi0 = F.col("phi"), F.col("phi0")
    rows = noisy(base, held).select("window_id", "instance", metrics.gap(phi0).alias("gap"), metrics.displacement(phi, phi0).alias("eta"), metrics.signed_margin(phi0, phi).alias("margin"))
    seen = F.col("instance") < 4
    per = rows.groupBy("window_id").agg(
        (2 * F.percentile(F.when(seen, F.col("eta")), F.lit(0.5)) / F.greatest(F.max("gap"), F.lit(1e-12))).alias("ratio"), F.avg(F.when(~seen, (F.col("margin") < 0).cast("int"))).alias("flip")
    )
    ratio = F.col("ratio")
    return per.groupBy(F.when(ratio < 1, 0).when(ratio < 2, 1).when(ratio < 5, 2).when(ratio < 10, 3).otherwise(4).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("flip"), 6).alias("flip"))


STABLE = f"""{BASE}, {noise(0.05)}, w as (select label, window_id, avg(acr) as cons, avg(1.0 - hit3) as wrong from acrs group by 1, 2), sc as (select window_id, max(z) / sum(z) as s from z group by 1),
st as (select w.label, w.window_id, w.wrong, sc.s, row_number() over (partition by w.label order by round(sc.s, 9), w.window_id) - 1 as i, count(*) over (partition by w.label) as n from w join sc on sc.window_id = w.window_id where w.cons >= 0.999),
pc as (select *, i / (n - 1.0) as pct from st where n >= 3)"""


@query("stable_filter", f"""{STABLE}, ks as (select unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2])::double as keep), o as (select wrong, row_number() over (order by round(pct, 9), window_id) as k, count(*) over () as n from pc)
select keep, count(*) as remaining, round(avg(wrong), 6) as wrong_rate from o, ks where k <= greatest(1, round_even(keep * n, 0)) group by keep""")
def stable_filter(spark, sf_dir):
    """Among windows that weak noise leaves alone: rejection by a score that is made a percentile within each fold."""
    base, held, _ = setup(spark, sf_dir)
    a = metrics.acr(base, noisy(base, held, strength=0.05), ("window_id",)).withColumn("wrong", 1 - arrays.hit(F.col("phi"), F.col("roots"), 3))
    w = a.groupBy("label", "window_id").agg(F.avg("acr").alias("cons"), F.avg("wrong").alias("wrong"))
    s = base.select("window_id", F.round(F.array_max("phi") / arrays.total(F.col("phi")), 9).alias("s"))
    fold = Window.partitionBy("label")
    stable = w.where("cons >= 0.999").join(s, "window_id").withColumn("n", F.count("*").over(fold)).where("n >= 3")
    pct = stable.withColumn("pct", F.round((F.row_number().over(fold.orderBy("s", "window_id")) - 1) / (F.col("n") - 1), 9))
    ranked = statistics.ordered(pct, "pct", "window_id").join(F.broadcast(pct.agg(F.count("*").alias("total"))))  # one row
    kept = ranked.withColumn("keep", F.explode(F.array(*map(F.lit, (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2))))).where(F.col("k") <= F.greatest(F.lit(1), F.bround(F.col("keep") * F.col("total"))))
    return kept.groupBy("keep").agg(F.count("*").alias("remaining"), F.round(F.avg("wrong"), 6).alias("wrong_rate"))


@query("consensus_hit", f"""{BASE}, {NOISE}, every as (select window_id, root, var from top0 union all select window_id, root, var from topm), c as (select window_id, root, var, count(*) as c from every group by 1, 2, 3), qs as (select unnest([0.5, 0.8])::double as q)
select q, round(avg(hit), 6) as hit, round(avg(size), 6) as size from (select q, window_id, max(case when c >= q * 9 and var = root then 1.0 else 0 end) as hit, sum(case when c >= q * 9 then 1 else 0 end) as size from c, qs group by 1, 2) group by q""")
def consensus_hit(spark, sf_dir):
    """How often the root is in the consensus of the base and eight instances, and how large that is."""
    base, held, _ = setup(spark, sf_dir)
    every, out = noisy(base, held).select("window_id", "phi").unionByName(base.select("window_id", "phi")), None
    for q in (0.5, 0.8):
        c = base.select("window_id", "roots").join(metrics.consensus(every, ("window_id",), q), "window_id", "left")
        vars_ = F.coalesce("vars", F.array().cast("array<int>"))
        row = c.agg(F.round(F.avg(F.arrays_overlap(vars_, "roots").cast("int")), 6).alias("hit"), F.round(F.avg(F.size(vars_)), 6).alias("size")).withColumn("q", F.lit(q))
        out = row if out is None else out.unionByName(row)
    return out


@query("deletion_control", f"""{BASE}, t as (select *, row_number() over (partition by window_id order by z desc, var) as r, row_number() over (partition by window_id order by {u("'control'", 'window_id', 'var')}, var) as k from z),
s as (select t.window_id, sum(z * z) as s0, sum(case when r > 3 then z * z else pow((s.mean - s.med) / s.mad, 2) end) as s1, sum(case when k > 3 then z * z else pow((s.mean - s.med) / s.mad, 2) end) as s2 from t join stats s on s.var = t.var group by 1)
select round(avg((s0 - s1) / greatest(abs(s0), 1e-9)), 6) as top3, round(avg((s0 - s2) / greatest(abs(s0), 1e-9)), 6) as random3 from s""")
def deletion_control(spark, sf_dir):
    """Score drop with the top three variables at their mean, and with three random ones."""
    base, held, _ = setup(spark, sf_dir)
    at_mean = attribution.zdev(attribution.literal(held["mean"]), held)
    random3 = arrays.topk(F.transform("phi", lambda v, i: -hashing.uniform("control", F.col("window_id"), i)), 3)
    rows = base.select("phi", arrays.topk(F.col("phi"), 3).alias("a"), random3.alias("b"), at_mean.alias("m"))

    def drop(which: str):
        left = F.transform("phi", lambda v, i: F.when(F.array_contains(which, i), F.get("m", i)).otherwise(v))
        s0, s1 = arrays.dot(F.col("phi"), F.col("phi")), arrays.dot(left, left)
        return (s0 - s1) / F.greatest(F.abs(s0), F.lit(1e-9))

    return rows.agg(F.round(F.avg(drop("a")), 6).alias("top3"), F.round(F.avg(drop("b")), 6).alias("random3"))


@query("scorer_quality")
def scorer_quality(spark, sf_dir):
    """Detection and hits of GlobalCF with a scorer that is fitted on max(50, a quarter) of the pool, against the whole pool."""
    pool, windows = adapters.vectors(spark, sf_dir), audited_windows(spark, sf_dir)
    n = pool.count()
    both, rows = pool.select("values", F.lit(0).alias("y")).unionByName(windows.select("values", F.lit(1).alias("y"))), []
    for share in (0.25, 1.0):
        drawn = statistics.ordered(pool.withColumn("u", hashing.uniform("quality", F.col("window_id"))), "u", "window_id")
        scorer = scorers.PcaScorer(drawn.where(F.col("k") <= max(50, int(n * share))))
        auroc = statistics.auroc(both.select("y", scorer.score("values").alias("s")), "y", "s").first().auroc
        hit = windows.withColumn("phi", scorer.counterfactual("values")).agg(F.avg(arrays.hit(F.col("phi"), F.col("roots"), 3))).first()[0]
        rows.append((share, auroc, hit))
    d = [(f"{a[0]}", a[1], a[2]) for a in rows] + [("difference", rows[1][1] - rows[0][1], rows[1][2] - rows[0][2])]
    return spark.createDataFrame(d, "share string, auroc double, hit3 double").select("share", F.round("auroc", 5).alias("auroc"), F.round("hit3", 6).alias("hit3"))


# ---- filters and joins of the audit's own rows


ROWS = f"""{BASE}, {EDGES}, {along('b', 'edges')}, {NOISE}, ra as (select window_id, label, avg(acr) as acr, avg(hit3) as hit_pert from acrs group by 1, 2), h0 as (select window_id, max(case when var = root then 1 else 0 end) as hit from top0 group by 1),
{three('bt', 'b20', 'round(f, 9)')}, hb as (select bt.window_id, max(case when bt.var = r.root then 1 else 0 end) as hit from bt join roots r on r.window_id = bt.window_id group by 1),
rows_ as (select ra.window_id, 'emb' || ra.label || '_m' || (ra.window_id % 3) as dataset, 'zDev' as method, 'noise' as family, ra.acr, h0.hit from ra join h0 on h0.window_id = ra.window_id
  union all select hb.window_id, 'emb' || r.label || '_m' || (hb.window_id % 3), 'PropRank', 'none', null, hb.hit from hb join roots r on r.window_id = hb.window_id
  union all select window_id, 'emb' || label || '_m' || (window_id % 3), '_meta', 'none', null, null from roots)"""


def audit_rows(spark, sf_dir):
    """Row per window and method: (window_id, dataset, method, family, acr, hit): zDev under noise, PropRank unperturbed, and a
    row of metadata, as the reference's result files have them. dataset names a trajectory and a magnitude."""
    base, held, _ = setup(spark, sf_dir)
    dataset = F.concat(F.lit("emb"), F.col("label").cast("string"), F.lit("_m"), (F.col("window_id") % 3).cast("string"))
    a = metrics.acr(base, noisy(base, held), ("window_id",)).groupBy("window_id").agg(F.avg("acr").alias("acr"))
    hit = arrays.hit(F.col("phi"), F.col("roots"), 3)
    z = base.select("window_id", dataset.alias("dataset"), F.lit("zDev").alias("method"), F.lit("noise").alias("family"), hit.alias("hit")).join(a, "window_id")
    prop = F.transform(attribution.proprank(F.col("phi"), edge_list(vector_graph(spark, sf_dir)), SIZE), lambda v: F.round(v, 9))
    p = base.withColumn("phi", prop).select("window_id", dataset.alias("dataset"), F.lit("PropRank").alias("method"), F.lit("none").alias("family"), hit.alias("hit"), F.lit(None).cast("double").alias("acr"))
    meta = base.select("window_id", dataset.alias("dataset"), F.lit("_meta").alias("method"), F.lit("none").alias("family"), F.lit(None).cast("int").alias("hit"), F.lit(None).cast("double").alias("acr"))
    return z.unionByName(p).unionByName(meta)


@query("row_filter", f"{ROWS} select dataset, count(*) as n, round(avg(acr), 6) as acr from rows_ where left(method, 1) <> '_' and family <> 'none' and acr is not null group by 1")
def row_filter(spark, sf_dir):
    """Without rows of metadata, unperturbed rows and rows without a stability."""
    r = audit_rows(spark, sf_dir).where(~F.col("method").startswith("_") & (F.col("family") != "none") & F.col("acr").isNotNull())
    return r.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg("acr"), 6).alias("acr"))


@query("derived_keys", f"{ROWS} select distinct dataset, regexp_extract(dataset, '_m([0-9]+)$', 1) as magnitude, 'emb' || regexp_extract(dataset, '([0-9]+)', 1) as trajectory from rows_")
def derived_keys(spark, sf_dir):
    """Magnitude from the suffix, and the trajectory (strict fold key) from the first digits of a data set's name."""
    d = audit_rows(spark, sf_dir).select("dataset").distinct()
    return d.select("dataset", F.regexp_extract("dataset", "_m([0-9]+)$", 1).alias("magnitude"), F.concat(F.lit("emb"), F.regexp_extract("dataset", "([0-9]+)", 1)).alias("trajectory"))


@query("review_rule", f"""{ROWS}, t as (select *, coalesce(acr > 0.6 and method = 'zDev' and dataset like '%_m0', false) as fired from rows_ where hit is not null)
select fired, count(*) as n, round(avg(1.0 - hit), 6) as wrong from t group by 1""")
def review_rule(spark, sf_dir):
    """Rows that a rule of data set, method and stability sends to review, and how wrong they are against the rest."""
    fired = F.coalesce((F.col("acr") > 0.6) & (F.col("method") == "zDev") & F.col("dataset").endswith("_m0"), F.lit(False))
    return audit_rows(spark, sf_dir).where("hit is not null").groupBy(fired.alias("fired")).agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("hit")), 6).alias("wrong"))


@query("case_finder", f"""{ROWS}, c as (select a.dataset, a.window_id, a.acr, row_number() over (partition by a.dataset order by a.window_id) as r from rows_ a join rows_ b on b.window_id = a.window_id and b.method = 'PropRank' where a.method = 'zDev' and round(a.acr, 9) >= 0.5 and a.hit = 0 and b.hit = 1)
select dataset, window_id, round(acr, 6) as acr from c where r = 1""")
def case_finder(spark, sf_dir):
    """Of each data set the first window that one method gets wrong, if steadily, and the other right."""
    rows = audit_rows(spark, sf_dir)
    right = rows.where("method = 'PropRank' and hit = 1").select("window_id")
    cases = rows.where("method = 'zDev' and round(acr, 9) >= 0.5 and hit = 0").join(right, "window_id", "left_semi")
    return cases.groupBy("dataset").agg(F.min_by(F.struct("window_id", "acr"), "window_id").alias("c")).select("dataset", "c.window_id", F.round("c.acr", 6).alias("acr"))


@query("method_pairs", f"""{ROWS}, t as (select dataset, max(a) as zdev, max(b) as proprank from (select dataset, avg(case when method = 'zDev' then hit end) as a, avg(case when method = 'PropRank' then hit end) as b from rows_ where left(method, 1) <> '_' and hit is not null group by 1) group by 1)
select dataset, round(zdev, 6) as zdev, round(proprank, 6) as proprank, round(zdev - proprank, 6) as difference from t""")
def method_pairs(spark, sf_dir):
    """Hits by data set, a column per method, and their paired difference."""
    rows = audit_rows(spark, sf_dir).where(~F.col("method").startswith("_") & F.col("hit").isNotNull())
    t = rows.groupBy("dataset").pivot("method", ["zDev", "PropRank"]).agg(F.avg("hit"))
    return t.select("dataset", F.round("zDev", 6).alias("zdev"), F.round("PropRank", 6).alias("proprank"), F.round(F.col("zDev") - F.col("PropRank"), 6).alias("difference"))


@query("method_join", f"""{ROWS}, j as (select a.dataset, a.hit as a, b.hit as b, a.acr from rows_ a join rows_ b on a.window_id = b.window_id and a.dataset = b.dataset where a.method = 'zDev' and b.method = 'PropRank')
select dataset, count(*) as n, round(avg(case when acr > 0.6 then a else b end), 6) as routed, round(avg(greatest(a, b)), 6) as oracle from j group by 1""")
def method_join(spark, sf_dir):
    """The rows of two methods side by side; a router takes one where it is stable, else the other; an oracle the better."""
    rows = audit_rows(spark, sf_dir)
    keys = ["window_id", "dataset"]
    j = rows.where("method = 'zDev'").select(*keys, F.col("hit").alias("a"), "acr").join(rows.where("method = 'PropRank'").select(*keys, F.col("hit").alias("b")), keys)
    routed = F.when(F.col("acr") > 0.6, F.col("a")).otherwise(F.col("b"))
    return j.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg(routed), 6).alias("routed"), F.round(F.avg(F.greatest("a", "b")), 6).alias("oracle"))


LABEL_EDGES = "ledges as (select a.label as instance, a.var as src, b.var as dst, abs(corr(a.x, b.x)) as w from cells a join cells b on a.window_id = b.window_id and a.var < b.var group by 1, 2, 3 having abs(corr(a.x, b.x)) > 0.3)"


@query("graph_transfer", f"""{BASE}, {LABEL_EDGES}, {along('b', 'ledges', 'instance')}, {three('bt', 'b20', 'round(f, 9)', 'instance, window_id')}
select cast(bt.instance as varchar) as graph_from, r.label, bt.instance = r.label as own, count(distinct bt.window_id) as n, round(sum(case when bt.var = r.root then 1.0 else 0 end) / count(distinct bt.window_id), 6) as hit3
from bt join roots r on r.window_id = bt.window_id group by 1, 2, 3""")
def graph_transfer(spark, sf_dir):
    """Each label's graph on the windows of every other label, and on its own: PropRank's hits at 3."""
    pool, windows = adapters.vectors(spark, sf_dir), audited_windows(spark, sf_dir)
    ctx = methods.fit_context(pool)
    found: dict[str, list] = {}
    for r in graphs.correlation_graphs(pool, ("label",), 0.3).collect():
        found.setdefault(str(r.label), []).append((r.src, r.dst, r.w))
    sources = {v: graphs.weights(edges, SIZE) for v, edges in sorted(found.items())}
    rows = methods.audit(windows, ctx, ["PropRank"], sources, [], group="label")
    return rows.select(F.col("source").alias("graph_from"), "label", (F.col("source") == F.col("label").cast("string")).alias("own"), "n", F.round("base_hit3", 6).alias("hit3"))


@query("first_of_service", "select o_orderpriority as service, o_orderkey as unit from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as r from orders where o_orderstatus = 'F') where r = 1 order by 1 limit 6")
def first_of_service(spark, sf_dir):
    """The first unit of each service with one fault, six services at most: a report of that size is the feature."""
    o = adapters.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.groupBy(F.col("o_orderpriority").alias("service")).agg(F.min("o_orderkey").alias("unit")).orderBy("service").limit(6)


@query("unit_guard", "select label as unit, count(*) as n from embeddings group by 1 having sum(case when len(list_filter(embedding, lambda x: x is null or isnan(x))) > 0 or vec_id % 97 = 5 then 1 else 0 end) = 0")
def unit_guard(spark, sf_dir):
    """Units without any NaN; every 97th window is given one here."""
    v = adapters.table(spark, sf_dir, "embeddings")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) | (F.col("vec_id") % 97 == 5)
    return v.groupBy(F.col("label").alias("unit")).agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad")).where(~F.col("bad")).select("unit", "n")


@query("adjacency", f"with {CELLS}, {EDGES} select src, count(*) as out_degree, sum(dst) as dsts from edges where w > 0 group by 1")
def adjacency(spark, sf_dir):
    """Edge list to matrix and back, row by row."""
    a = matrix(vector_graph(spark, sf_dir))
    back = spark.createDataFrame([(s, d) for s, d, _ in methods.edges_of(a)], "src int, dst int")
    return back.groupBy("src").agg(F.count("*").alias("out_degree"), F.sum("dst").alias("dsts"))


@query("topological_order", f"with {CELLS}, {EDGES} select v as node, v as place from (select unnest(range(64))::int as v)")
def topological_order(spark, sf_dir):
    """Kahn's order, smallest free node first: with edges from lower to higher nodes, that of the numbers."""
    order = graphs.topological_order([e[:2] for e in edge_list(vector_graph(spark, sf_dir))], range(SIZE))
    return spark.createDataFrame(list(zip(order, range(SIZE), strict=True)), "node int, place int")


def with_noise(scale: float):
    return F.transform("values", lambda x, i: x + F.lit(scale) * hashing.normal("g", F.col("window_id"), i))


@query("global_noise_grid")
def global_noise_grid(spark, sf_dir):
    """Noise at 5 and 10 percent of all cells' deviation, one draw: stability of zDev."""
    base, held, _ = setup(spark, sf_dir)
    sd = base.select(F.explode("values").alias("x")).agg(F.stddev_pop("x")).first()[0]
    out = None
    for q in (0.05, 0.1):
        rows = base.withColumnRenamed("phi", "phi0").withColumn("values", with_noise(q * sd)).withColumn("phi", attribution.zdev(F.col("values"), held))
        row = metrics.acr(base, rows, ("window_id",)).agg(F.round(F.avg("acr"), 6).alias("acr")).withColumn("q", F.lit(q))
        out = row if out is None else out.unionByName(row)
    return out
