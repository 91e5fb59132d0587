"""Queries on series: windows, islands, samples, splits, graphs over time, perturbations, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import arrays, hashing
from causeway.operators import discovery, graphs, methods, moments, windows
from causeway.plans.attribution_queries import EDGES, edge_list, vector_graph
from causeway.plans.core import CELLS, SERIES, query, u
from causeway.sources import adapters, simulators


def labelled(spark, sf_dir):
    """(unit, t, flag): hours in which the first variable is above twice its unit's mean."""
    s = adapters.event_series(spark, sf_dir)
    first = s.where("var = 0")
    means = first.groupBy("unit").agg(F.avg("x").alias("m"))
    return first.join(F.broadcast(means), "unit").select("unit", "t", (F.col("x") > 2 * F.col("m")).alias("flag"))


LABELS = "lab as (select s.unit, s.t, s.x > 2 * m.m as flag from series s join (select unit, avg(x) as m from series where var = 0 group by unit) m on m.unit = s.unit where s.var = 0)"
SEGMENTS = "seg as (select unit, min(t) as start, max(t) + 1 as stop from (select unit, t, flag, row_number() over (partition by unit order by t) - row_number() over (partition by unit, flag order by t) as g from lab) where flag group by unit, g)"


@query("observations", f"with {SERIES} select unit, var, count(*) as n, round(sum(x), 4) as total, round(max(x), 4) as peak from series group by 1, 2")
def observations(spark, sf_dir):
    return adapters.event_series(spark, sf_dir).groupBy("unit", "var").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"), F.round(F.max("x"), 4).alias("peak"))


@query("sliding_windows", f"""with {SERIES}, w as (select unit, var, t + 1 as t_end, avg(x) over w as m, max(x) over w as h, count(*) over w as n from series window w as (partition by unit, var order by t rows between 15 preceding and current row))
select unit, var, t_end, round(m, 7) as mean, round(h, 5) as high from w where n = 16""")
def sliding_windows(spark, sf_dir):
    w = windows.sliding(adapters.event_series(spark, sf_dir), 16)
    return w.select("unit", "var", "t_end", F.round(arrays.mean(F.col("values")), 7).alias("mean"), F.round(F.array_max("values"), 5).alias("high"))


@query("window_summary", f"""with {SERIES}, w as (select a.unit, a.var, a.t + 1 as t_end, regr_slope(b.x, b.t) as slope, avg(b.x) as mean, var_pop(b.x) as var_, count(*) as n
  from series a join series b on b.unit = a.unit and b.var = a.var and b.t between a.t - 7 and a.t group by 1, 2, 3)
select unit, var, t_end, round(mean, 7) as mean, round(slope, 5) as slope, round(var_, 8) as variance from w where n = 8""")
def window_summary(spark, sf_dir):
    v = F.col("values")
    n = F.size(v)
    mean = arrays.mean(v)
    w = windows.sliding(adapters.event_series(spark, sf_dir), 8).withColumn("m", mean)
    centred = F.transform("values", lambda x, i: (x - F.col("m")) * (i - (n - 1) / 2))
    spread = F.transform("values", lambda x: (x - F.col("m")) * (x - F.col("m")))
    ticks = n * (n * n - 1) / 12
    return w.select("unit", "var", "t_end", F.round("m", 7).alias("mean"), F.round(arrays.total(centred) / ticks, 5).alias("slope"), F.round(arrays.total(spread) / n, 8).alias("variance"))


@query("episode_windows", f"""with {SERIES}, {LABELS}, {SEGMENTS}, ep as (select unit, start as t_start, 48 as length from seg)
select unit, t_start, unnest(range(t_start + 16, t_start + 48, 20)) as t_end from ep""")
def episode_windows(spark, sf_dir):
    seg = windows.islands(labelled(spark, sf_dir), "flag")
    return windows.episode_ends(seg.select("unit", F.col("start").alias("t_start"), F.lit(48).cast("long").alias("length")), 16, 20).drop("length")


@query("pool_windows", f"""with {SERIES}, {LABELS}, ok as (select unit, t, sum(case when flag then 0 else 1 end) over (partition by unit order by t rows between 3 preceding and current row) as s from lab),
e as (select unit, t + 1 as t_end, row_number() over (partition by unit order by t) as n from ok where s = 4) select unit, t_end from e where (n - 1) % 7 = 0""")
def pool_windows(spark, sf_dir):
    safe = labelled(spark, sf_dir).select("unit", "t", (~F.col("flag")).alias("safe"))
    return windows.pool_ends(safe, 4, 7)


@query("label_segments", f"with {SERIES}, {LABELS}, {SEGMENTS} select unit, start, stop from seg")
def label_segments(spark, sf_dir):
    return windows.islands(labelled(spark, sf_dir), "flag").select("unit", "start", "stop")


@query("segment_sampling", f"""with {SERIES}, b as (select unit, min(t) as start, max(t) + 1 as stop from series group by unit),
n as (select *, greatest(0, floor((stop - start - 30) / 30.0) + 1) as n_win from b), k as (select *, least(n_win, 10) as take from n),
s as (select *, case when n_win > take then greatest(1, floor(n_win / greatest(take, 1))) else 1 end as step from k where take > 0)
select unit, cast(n_win as int) as n_win, cast(step as int) as step, cast(start + i * step * 30 as bigint) as at from (select *, unnest(range(cast(take as bigint))) as i from s)""")
def segment_sampling(spark, sf_dir):
    b = adapters.event_series(spark, sf_dir).groupBy("unit").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop"))
    return windows.segment_ends(b, 30, 30, 10).select("unit", "n_win", "step", F.col("at").cast("long").alias("at"))


@query("even_pool_ends", f"""with {SERIES}, b as (select unit, min(t) as a, max(t) as z from series group by unit) select unit, cast(floor(a + (z - a) * i / 11.0) as bigint) as t_end from (select *, unnest(range(1, 11)) as i from b)""")
def even_pool_ends(spark, sf_dir):
    b = adapters.event_series(spark, sf_dir).groupBy("unit").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    return b.select("unit", F.explode(windows.even_ends(F.col("a"), F.col("z"), 10)).alias("t_end"))


@query("even_sample", f"""with {SERIES}, r as (select unit, t, row_number() over (partition by unit order by t) - 1 as i, count(*) over (partition by unit) as n from series where var = 0),
k as (select unnest(range(30)) as k) select distinct r.unit, r.t from r, k where r.n <= 30 or r.i = floor(k.k * (r.n - 1) / 29.0)""")
def even_sample(spark, sf_dir):
    return windows.evenly(adapters.event_series(spark, sf_dir).where("var = 0").select("unit", "t"), 30, ("unit",), ("t",))


@query("random_pool_starts", f"""with {SERIES}, r as (select unit, t, row_number() over (partition by unit order by {u("'pool'", 'unit', 't')}, t) as r from series where var = 0) select unit, t from r where r <= 20""")
def random_pool_starts(spark, sf_dir):
    rows = adapters.event_series(spark, sf_dir).where("var = 0").select("unit", "t").withColumn("u", hashing.uniform("pool", F.col("unit"), F.col("t")))
    from pyspark.sql import Window

    w = Window.partitionBy("unit").orderBy("u", "t")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 20").select("unit", "t")


@query("episode_points", f"""with {SERIES}, {LABELS}, {SEGMENTS}, ep as (select unit, start - 12 as a, stop + 36 as b from seg)
select ep.unit, ep.a as start, ep.b as stop, count(*) as n, round(sum(s.x), 3) as total from ep join series s on s.unit = ep.unit and s.t >= ep.a and s.t < ep.b group by 1, 2, 3""")
def episode_points(spark, sf_dir):
    """The observations in each episode and the hours around it; the episodes overlap."""
    seg = windows.islands(labelled(spark, sf_dir), "flag").select("unit", (F.col("start") - 12).alias("start"), (F.col("stop") + 36).alias("stop"))
    met = windows.interval_join(adapters.event_series(spark, sf_dir), seg, ("unit",))
    return met.groupBy("unit", "start", "stop").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total"))


@query("onset_split", f"""with {SERIES}, o as (select unit, min(case when t >= 100.5 then t end) as onset from series group by unit)
select s.unit, max(o.onset) as onset, count(*) filter (s.t < o.onset) as before, count(*) filter (s.t >= o.onset) as after from series s join o on o.unit = s.unit group by 1""")
def onset_split(spark, sf_dir):
    s = adapters.event_series(spark, sf_dir)
    o = windows.onset(s, F.lit(100.5))
    return s.join(F.broadcast(o), "unit").groupBy("unit").agg(F.max("onset").alias("onset"), F.count_if(F.col("t") < F.col("onset")).alias("before"), F.count_if(F.col("t") >= F.col("onset")).alias("after"))


@query("lag_features", f"""with {SERIES}, l as (select *, lag(x) over (partition by unit, var order by t) as p from series) select unit, var, count(p) as n, round(sum(x * p), 3) as cross from l group by 1, 2""")
def lag_features(spark, sf_dir):
    s = windows.lagged(adapters.event_series(spark, sf_dir))
    return s.groupBy("unit", "var").agg(F.count("lag1").alias("n"), F.round(F.sum(F.col("x") * F.col("lag1")), 3).alias("cross"))


@query("prefix_zscore", f"""with {SERIES}, st as (select unit, var, avg(x) as m, stddev_pop(x) + 1e-8 as s from series where t < 360 group by 1, 2)
select s.unit, s.var, round(sum(greatest(least((s.x - st.m) / st.s, 8), -8)), 3) as total from series s join st on st.unit = s.unit and st.var = s.var group by 1, 2""")
def prefix_zscore(spark, sf_dir):
    s = adapters.event_series(spark, sf_dir)
    st = s.where("t < 360").groupBy("unit", "var").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + 1e-8).alias("s"))
    z = F.coalesce(F.nanvl((F.col("x") - F.col("m")) / F.col("s"), F.lit(0.0)), F.lit(0.0))
    return s.join(F.broadcast(st), ["unit", "var"]).groupBy("unit", "var").agg(F.round(F.sum(F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))), 3).alias("total"))


@query("constant_filter", f"""with {SERIES}, ok as (select unit, var, stddev_pop(x) as s, count(*) as n from series where t < 360 group by 1, 2)
select unit, count(*) as vars, min(n) as pool from ok where s > 1e-9 group by unit having min(n) >= 50""")
def constant_filter(spark, sf_dir):
    ok = adapters.event_series(spark, sf_dir).where("t < 360").groupBy("unit", "var").agg(F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    return ok.where("s > 1e-9").groupBy("unit").agg(F.count("*").alias("vars"), F.min("n").alias("pool")).where("pool >= 50")


@query("tumbling_roots", f"""with {SERIES}, mk as (select unit, t, var, case when x > 100 then 1 else 0 end as mark, t // 24 as w from series),
bv as (select unit, w, var, sum(mark) as m from mk group by 1, 2, 3), st as (select unit, w, sum(a) as a, count(*) as n from (select unit, w, t, max(mark) as a from mk group by 1, 2, 3) group by 1, 2),
r as (select unit, w, string_agg(cast(var as varchar), ',' order by var) as roots from bv where m >= 3 group by 1, 2)
select st.unit, cast(st.w as bigint) as w, r.roots from st join r on r.unit = st.unit and r.w = st.w where st.n = 24 and st.a / 24.0 >= 0.3""")
def tumbling_roots(spark, sf_dir):
    s = adapters.event_series(spark, sf_dir).withColumn("mark", (F.col("x") > 100).cast("int"))
    w = windows.tumbling(s, 24, 0.3, 3)
    return w.select("unit", "w", F.array_join(F.transform("roots", lambda v: v.cast("string")), ",").alias("roots"))


@query("temporal_split", f"""with {SERIES}, r as (select unit, row_number() over (partition by unit order by t) as i, count(*) over (partition by unit) as n from series where var = 0)
select unit, case when i <= floor(n * 0.7::double) then 'train' when i <= floor(n * 0.7::double) + 5 then 'purged' else 'test' end as part, count(*) as n_rows from r group by 1, 2""")
def temporal_split(spark, sf_dir):
    s = windows.temporal_split(adapters.event_series(spark, sf_dir).where("var = 0"), 0.7, 5, ("unit",), "t")
    return s.groupBy("unit", "part").agg(F.count("*").alias("n_rows"))


@query("knee", f"""with {SERIES}, c as (select var, t // 168 as w, avg(x) as y from series group by 1, 2), b as (select var, w, lead(y) over o - 2 * y + lag(y) over o as bend from c window o as (partition by var order by w))
select var, cast(arg_min(w, (bend, w)) as bigint) as knee from b where bend is not null group by 1""")
def knee(spark, sf_dir):
    c = adapters.event_series(spark, sf_dir).groupBy("var", F.floor(F.col("t") / 168).cast("long").alias("w")).agg(F.avg("x").alias("y"))
    return windows.knee(c, "w", "y", ("var",))


@query("input_slice", f"""with {CELLS}, s as (select window_id, var, cast(floor({u("'slice'", 'window_id')} * 7) as int) - 3 as k, x from cells)
select window_id, max(k) as shift, round(sum(x * ((var + k + 64) % 64)), 5) as moment from s group by 1""")
def input_slice(spark, sf_dir):
    """Circular shifts by -3 .. 3."""
    v = adapters.vectors(spark, sf_dir).withColumn("shift", F.floor(hashing.uniform("slice", F.col("window_id")) * 7).cast("int") - 3)
    moved = v.withColumn("values", arrays.rolled(F.col("values"), F.col("shift")))
    return moved.select("window_id", "shift", F.round(arrays.total(F.transform("values", lambda x, i: x * i)), 5).alias("moment"))


def crc32_sql(text: str) -> str:
    """CRC-32 in SQL: a byte at a time, eight shifts each."""
    return f"list_reduce(list_concat([4294967295::ubigint], [ascii(c)::ubigint for c in string_split({text}, '')]), lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)::ubigint[]), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end)) "


@query("perturbation_seeds", f"""with g as (select family, strength, m from (select unnest(['del', 'add', 'rew']) as family), (select unnest([0.1, 0.2, 0.5])::double as strength), (select unnest(range(8))::int as m))
select family, strength, m, cast(xor({crc32_sql("concat_ws('|', '0', 'iforest', 'PropRank', 'true', family, cast(strength as varchar), cast(m as varchar))")}, 4294967295::ubigint) as bigint) as seed from g""")
def perturbation_seeds(spark, sf_dir):
    """crc32 seeds of a configuration grid."""
    grid = spark.createDataFrame([("del",), ("add",), ("rew",)], "family string").withColumn("strength", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.5)))))
    grid = grid.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return grid.withColumn("seed", hashing.seed("0", "iforest", "PropRank", "true", F.col("family"), F.col("strength"), F.col("m")))


@query("corr_graph", f"with {CELLS}, {EDGES} select src, dst, round(w, 6) as w from edges")
def corr_graph(spark, sf_dir):
    return vector_graph(spark, sf_dir).select("src", "dst", F.round("w", 6).alias("w"))


@query("lag_corr_graph", f"""with {SERIES}, l as (select unnest(range(0, 3)) as lag), r as (select a.unit, a.var as src, b.var as dst, l.lag, abs(corr(a.x, b.x)) as r from series a, l, series b
where b.unit = a.unit and b.t = a.t + l.lag and a.var <> b.var and (l.lag > 0 or a.var < b.var) group by 1, 2, 3, 4)
select unit, src, dst, round(max(r), 6) as w, cast(arg_max(lag, (r, -lag)) as int) as lag from r group by 1, 2, 3 having max(r) > 0.05""")
def lag_corr_graph(spark, sf_dir):
    return graphs.lagged_correlation_graph(adapters.event_series(spark, sf_dir), 0.05, 2).select("unit", "src", "dst", F.round("w", 6).alias("w"), "lag")


@query("graph_features", f"""with {CELLS}, {EDGES}, d as (select n.node, coalesce(i.c, 0) as i, coalesce(o.c, 0) as o from (select unnest(range(64)) as node) n left join (select dst, count(*) as c from edges group by 1) i on i.dst = n.node left join (select src, count(*) as c from edges group by 1) o on o.src = n.node),
t as (select sum(i) as e from d)
select count(*) as g_n_nodes, cast(max(t.e) as double) as g_n_edges, round(max(t.e) / (64.0 * 63), 6) as g_density, round(-sum(case when i > 0 then i / t.e * ln(i / t.e) else 0 end), 6) as g_indeg_entropy,
round(-sum(case when o > 0 then o / t.e * ln(o / t.e) else 0 end), 6) as g_outdeg_entropy, cast(max(i) as double) as g_indeg_max, cast(max(o) as double) as g_outdeg_max, round(avg(i), 6) as g_indeg_mean, round(stddev_pop(i), 6) as g_indeg_std,
round(avg(case when i = 0 then 1.0 else 0 end), 6) as g_sink_frac, round(avg(case when o = 0 then 1.0 else 0 end), 6) as g_source_frac from d, t""")
def graph_features(spark, sf_dir):
    nodes = spark.range(64).select(F.col("id").alias("node"))
    f = graphs.features(vector_graph(spark, sf_dir), nodes)
    keep = ("g_n_nodes", "g_n_edges", "g_indeg_max", "g_outdeg_max")
    return f.select(*[F.col(c) if c in keep else F.round(c, 6).alias(c) for c in f.columns])


@query("edge_prf", f"""with {CELLS}, {EDGES}, tr as (select src, dst from edges where w > 0.12), es as (select src, dst from edges where {u("'est'", 'src', 'dst')} < 0.7),
c as (select (select count(*) from es) as ne, (select count(*) from tr) as nt, (select count(*) from es join tr using (src, dst)) as h)
select round(case when nt = 0 then 1.0 else h / nt::double end, 6) as recall, round(case when nt = 0 or ne = 0 then 1.0 else h / ne::double end, 6) as precision, round(case when nt = 0 then 1.0 else 2.0 * h / (ne + nt) end, 6) as f1 from c""")
def edge_prf(spark, sf_dir):
    e = vector_graph(spark, sf_dir)
    p = graphs.precision_recall(e.where(hashing.uniform("est", F.col("src"), F.col("dst")) < 0.7), e.where("w > 0.12"))
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


@query("edge_prune", f"with {CELLS}, {EDGES} select src, dst from (select *, row_number() over (order by w, src, dst) as r, count(*) over () as n from edges) where r > floor(n * 0.3)")
def edge_prune(spark, sf_dir):
    return graphs.prune(vector_graph(spark, sf_dir), 0.3).select("src", "dst")


@query("graph_closure", f"""with recursive {CELLS}, {EDGES}, c as (select src as node, dst as descendant from edges union select c.node, e.dst from c join edges e on e.src = c.descendant)
select distinct node, descendant from c""")
def graph_closure(spark, sf_dir):
    return graphs.closure(vector_graph(spark, sf_dir))


@query("perturb_del", f"with {CELLS}, {EDGES} select src, dst from edges where {u("'del'", 'src', 'dst')} >= 0.3")
def perturb_del(spark, sf_dir):
    return graphs.delete_edges(vector_graph(spark, sf_dir), 0.3, "del").select("src", "dst")


@query("perturb_add", f"""with {CELLS}, {EDGES}, n as (select unnest(range(64))::int as v), ab as (select a.v as src, b.v as dst from n a join n b on a.v < b.v where not exists (select 1 from edges e where e.src = a.v and e.dst = b.v)),
r as (select src, dst, row_number() over (order by {u("'add'", 'src', 'dst')}, src, dst) as r, count(*) over () as n from ab)
select src, dst from edges union all select src, dst from r where r <= round_even(n * 0.05, 0)""")
def perturb_add(spark, sf_dir):
    order = spark.range(64).select(F.col("id").cast("int").alias("node"), F.col("id").cast("int").alias("pos"))
    return graphs.add_edges(vector_graph(spark, sf_dir), order, order, 0.05, "add")


@query("perturb_rew")
def perturb_rew(spark, sf_dir):
    """Three tenths of the edges are taken out, the topological order of the rest is found, and each goes back as it was or
    reversed. Edges are first directed by hash, so that some have to turn. A test holds it against plain Python."""
    turned = hashing.uniform("turn", F.col("src"), F.col("dst")) < 0.5
    edges = vector_graph(spark, sf_dir).select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), "w")
    after = methods.perturbed(graphs.weights(edge_list(edges), 64), "rew", 0.3, "rew")
    return spark.createDataFrame([(s, d) for s, d, _ in methods.edges_of(after)], "src int, dst int")


def influences(z, edges, size):
    """(src, dst, influence) of every edge: 1 - ACR after deleting that edge alone."""
    from causeway.operators import attribution

    acr = attribution.graph_overlaps(z, edges, [(s, d, 0.0) for s, d, _ in edges], [edges], size)
    return [(s, d, 1 - a) for (s, d, _), a in zip(edges, acr, strict=True)]


@query("edge_influence")
def edge_influence(spark, sf_dir):
    """1 - ACR after deleting one edge, for every edge; no rows where the graph has no edges."""
    from causeway.plans.attribution_queries import SIZE, setup

    base, _, _ = setup(spark, sf_dir)
    rows = influences(base.select("phi"), edge_list(vector_graph(spark, sf_dir)), SIZE)
    return spark.createDataFrame([(s, d, round(v, 6)) for s, d, v in rows], "src int, dst int, influence double")


@query("scm_units")
def scm_units(spark, sf_dir):
    """Episodes, roots and propagation of simulated units."""
    return simulators.scm_episodes(simulators.scm_units(spark, 4))


@query("scm_series")
def scm_series(spark, sf_dir):
    s = simulators.scm_series(spark, 4, steps=2000)
    return s.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.stddev_pop("x"), 3).alias("spread"))


@query("pcmci_graph")
def pcmci_graph(spark, sf_dir):
    """Links among the five event types, hour by hour, of each unit, with those that stay. A test holds it against a search on plain arrays."""
    found = discovery.links(adapters.event_series(spark, sf_dir), max_lag=3)
    return found.select("unit", "src", "dst", "lag", F.round("w", 6).alias("w"), F.round("p", 6).alias("p"), "kept")


def national_series(spark, sf_dir):
    """(unit 0, t, var, x): the order value of each of the 25 nations, by day; days without an order are absent."""
    return adapters.order_series(spark, sf_dir).withColumn("unit", F.lit(0))


@query("pcmci_orders")
def pcmci_orders(spark, sf_dir):
    """Links among the daily orders of 25 nations, with those that stay; a pair's steps are the days on which both have orders."""
    found = discovery.links(national_series(spark, sf_dir), max_lag=2)
    return found.select("src", "dst", "lag", F.round("w", 6).alias("w"), F.round("p", 6).alias("p"), "kept")


@query("lagged_moments", """with o as (select date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as t, c_nationkey as var, sum(o_totalprice) as x from orders join customer on o_custkey = c_custkey group by 1, 2)
select a.var as i, b.var as j, cast(l.lag as int) as lag, count(*) as n, nullif(round(corr(a.x, b.x), 5), 'nan'::double) as r from o a, (select unnest(range(0, 4)) as lag) l, o b where b.t = a.t + l.lag group by 1, 2, 3""")
def lagged_moments(spark, sf_dir):
    """Correlations of all pairs of the 25 daily series at lags 0 to 3."""
    r = moments.lagged_correlations(national_series(spark, sf_dir), 3)
    return r.select("i", "j", "lag", "n", F.round("r", 5).alias("r"))
