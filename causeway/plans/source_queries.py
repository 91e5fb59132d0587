"""Sources, sinks, simulators and injectors: what is written in the form that a source reads, and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import hashing
from causeway.operators import discovery, graphs, runner
from causeway.plans.attribution_queries import EDGES, vector_graph
from causeway.plans.core import CELLS, SERIES, query, u
from causeway.plans.series_queries import LABELS, SEGMENTS, labelled
from causeway.sources import adapters, files, plants, scratch, simulators

# Services' metrics that stand for the five variables of the event series.
NAMES = ("svc0_cpu", "svc0_mem", "svc1_cpu", "svc1_load", "svc2_cpu")


@query("fault_folder", f"""with {SERIES} select 'svc' || unit || '_cpu_1' as unit, count(*) as n, count(distinct var) as names, round(sum(x), 3) as total, sum(case when t >= 360 then 1 else 0 end) as after,
case unit when 0 then 'svc0_cpu,svc0_mem' when 1 then 'svc1_cpu,svc1_load' when 2 then 'svc2_cpu' else '' end as roots from series group by unit""")
def fault_folder(spark, sf_dir):
    """The event series as folders of a service's metrics with an onset beside them, read back as units with service roots."""
    s = adapters.event_series(spark, sf_dir)
    wide = s.groupBy("unit", "t").pivot("var", list(range(len(NAMES)))).agg(F.max("x")).cache()
    root = scratch.fresh_dir(spark, "faults")
    for unit in [r.unit for r in wide.select("unit").distinct().orderBy("unit").collect()]:
        part = wide.where(F.col("unit") == unit).select(F.col("t").alias("time"), *[F.col(str(k)).alias(n) for k, n in enumerate(NAMES)])
        part.write.option("header", True).csv(f"{root}/svc{unit}_cpu/1/data.csv")
        spark.createDataFrame([("360",)], "value string").coalesce(1).write.text(f"{root}/svc{unit}_cpu/1/inject_time.txt")
    observations, onsets = files.fault_units(spark, root)
    roots = files.service_roots(observations).select("unit", F.array_join("roots", ",").alias("roots"))
    whole = observations.join(onsets, "unit").groupBy("unit").agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.round(F.sum("x"), 3).alias("total"), F.sum((F.col("time") >= F.col("onset")).cast("int")).alias("after")
    )
    return whole.join(roots, "unit", "left").select("unit", "n", "names", "total", "after", F.coalesce("roots", F.lit("")).alias("roots"))


@query("interval_labels", f"with {SERIES}, {LABELS}, {SEGMENTS}, m as (select unit, unnest(range(start, stop)) as t from seg where start >= 0) select unit, var, count(*) as n, sum(t) as total from m, (select unnest([0, 2])::int as var) group by 1, 2")
def interval_labels(spark, sf_dir):
    """Label segments as lines start-end:dims (inclusive, dims from 1), expanded again to marks."""
    seg = labelled_segments(spark, sf_dir).where("start >= 0")
    lines = seg.select("unit", F.format_string("%d-%d:1,3", F.col("start"), F.col("stop") - 1).alias("value"))
    root = scratch.fresh_dir(spark, "intervals")
    lines.write.partitionBy("unit").text(root)
    marks = files.interval_marks(spark, f"{root}/*", r"/unit=(\d+)/")
    return marks.groupBy(F.col("unit").cast("int").alias("unit"), "var").agg(F.count("*").alias("n"), F.sum("t").alias("total"))


def labelled_segments(spark, sf_dir):
    from causeway.operators import windows

    return windows.islands(labelled(spark, sf_dir), "flag")


COLUMNS = ("p", "q", "r", "s", "u")


@query("labelled_table", f"with {SERIES} select (['p', 'q', 'r', 's', 'u'])[var + 1] as name, count(*) as n, cast(sum(case when t % 50 = 7 then 1 else 0 end) as bigint) as attacks, round(sum(x), 3) as total, count(*) - 1 as last_row from series group by var")
def labelled_table(spark, sf_dir):
    """A table with a junk line before its header and a label of -1 under attack: all hours of all units, one after another."""
    s = adapters.event_series(spark, sf_dir).groupBy("unit", "t").pivot("var", list(range(len(COLUMNS)))).agg(F.max("x"))
    label = F.when(F.col("t") % 50 == 7, -1).otherwise(1)
    at = F.col("unit").cast("long") * 10**9 + F.col("t")
    body = s.select(at.alias("at"), F.concat_ws(",", "t", F.lit("d"), F.lit("h"), *[F.col(str(v)).cast("string") for v in range(len(COLUMNS))], label.cast("string")).alias("value"))
    header = 'Row,Date,Time,"p","q","r","s","u",Attack LABLE (1:No Attack -1:Attack)'
    head = spark.createDataFrame([(-(10**15), "junk"), (-(10**15) + 1, header)], "at long, value string")
    path = scratch.fresh_dir(spark, "labelled")
    head.unionByName(body).repartitionByRange(4, "at").sortWithinPartitions("at").select("value").write.text(path)
    rows = files.labelled_csv(spark, path)
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("attack").cast("int")).alias("attacks"), F.round(F.sum("x"), 3).alias("total"), F.max("row").alias("last_row"))


@query("aligned_parts", "select count(*) as n, count(o_custkey) as with_customer, count(o_totalprice) as with_price from (select o_orderkey, o_custkey, null as o_totalprice from orders union all select o_orderkey, null, o_totalprice from orders)")
def aligned_parts(spark, sf_dir):
    """Parts with other columns, aligned by name; what one lacks is null."""
    o = adapters.table(spark, sf_dir, "orders")
    both = files.aligned([o.select("o_orderkey", "o_custkey"), o.select("o_totalprice", "o_orderkey")])
    return both.agg(F.count("*").alias("n"), F.count("o_custkey").alias("with_customer"), F.count("o_totalprice").alias("with_price"))


@query("systematic_sample", f"with {SERIES}, r as (select unit, var, row_number() over (order by unit, t, var) - 1 as i, count(*) over () as n from series) select unit, var, count(*) as kept, cast(sum(i) as bigint) as total from r where i % greatest(1, n // 1000) = 0 group by 1, 2")
def systematic_sample(spark, sf_dir):
    """Every max(1, n // 1000)-th row of the whole long table, in its order by unit, hour and variable."""
    s = adapters.event_series(spark, sf_dir)
    units = s.groupBy("unit").agg(F.min("t").alias("a"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a unit
    rows = s.join(units.select("unit", "a", before.alias("base")), "unit")
    rows = rows.select("unit", "var", (F.col("base") + (F.col("t") - F.col("a")) * len(COLUMNS) + F.col("var")).alias("i"))
    return files.sampled(rows, "i", 1000).groupBy("unit", "var").agg(F.count("*").alias("kept"), F.sum("i").alias("total"))


@query("plant_batches", """with r as (select unnest(range(30001, 30001 + 6 * 3001))::bigint as g), b as (select (g - 30001) // 3001 as k, (g - 30001) % 3001 as t from r)
select case k when 0 then 'idv1_b0' when 1 then 'idv1_b1' when 2 then 'idv4_b0' when 3 then 'idv4_b1' when 4 then 'idv11_b0' else 'idv11_b1' end as unit, count(*) as n, 160 + 10 * k as onset, case when k < 2 then '3' else '18' end as roots from b group by k""")
def plant_batches(spark, sf_dir):
    """One long table cut into a normal part and six fault batches with onsets and known roots."""
    t = F.col("id")
    k, at = F.floor((t - plants.CHEMICAL_NORMAL) / plants.CHEMICAL_BATCH), F.pmod(t - plants.CHEMICAL_NORMAL, F.lit(plants.CHEMICAL_BATCH))
    flag = (t >= plants.CHEMICAL_NORMAL) & (at >= 160 + 10 * k)
    rows = spark.range(plants.CHEMICAL_NORMAL + 6 * plants.CHEMICAL_BATCH).select(t.alias("t"), F.array(t.cast("double")).alias("values"), flag.cast("int").alias("y"))
    _, units = plants.fault_batches(rows)
    return units.groupBy("unit").agg(F.count("*").alias("n"), F.max("onset").alias("onset"), F.max(F.array_join(F.transform("roots", lambda r: r.cast("string")), ",")).alias("roots"))


PLANT = f"""pl as (select t::bigint as t, v::int as var, {u("'plant'", 't', 'v')} as x from (select unnest(range(6000)) as t), (select unnest(range(8)) as v)),
pm as (select var, avg(x) as m, stddev_pop(x) + 1e-8 as s from pl where t < 3000 group by 1), px as (select t, pl.var, (x - m) / s as x from pl join pm on pm.var = pl.var),
ev as (select e, 3300 + 1200 * e as t0, (['drift', 'stuck', 'var'])[e + 1] as kind, unnest(case when e = 2 then [1, 6] else [(7 * e) % 8] end)::int as var from (select unnest(range(3)) as e))"""


@query("plant_injected", f"""with {PLANT}, i as (select ev.e, ev.kind, px.var, px.t - ev.t0 as d, px.x, h.x as x0 from ev join px on px.var = ev.var and px.t >= ev.t0 and px.t < ev.t0 + 200 join px h on h.var = ev.var and h.t = ev.t0)
select cast(e as int) as event, kind, var, count(*) as n, round(sum(case kind when 'drift' then 3.0 * (1 - exp(-d / 50.0)) when 'stuck' then x0 - x else 1.5 end), 4) as moved from i group by 1, 2, 3""")
def plant_injected(spark, sf_dir):
    """A plant's series, scored by its first half, with sensor faults: what each event adds in all. Noise is the constant 1."""
    cells = spark.range(6000).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("var"))
    series = plants.prefix_scored(cells.withColumn("x", hashing.uniform("plant", F.col("t"), F.col("var"))), 3000)
    plan = plants.injection_plan(spark, 6000, 8, events=3)
    out = plants.injected_plant(series, plan, 200, 3.0, F.lit(1.0)).where("event is not null")
    return out.join(F.broadcast(plan.select("event", "kind")), "event").groupBy("event", "kind", "var").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") - F.col("before")), 4).alias("moved"))


@query("inferred_roots", f"""with {SERIES}, {LABELS}, {SEGMENTS}, sd as (select unit, var, avg(x) as m, stddev_pop(x) + 1e-8 as s from series group by 1, 2), zs as (select s.unit, s.t, s.var, (s.x - sd.m) / sd.s as x from series s join sd on sd.unit = s.unit and sd.var = s.var),
w as (select seg.unit, seg.start, zs.var, avg(abs(zs.x)) as z from seg join zs on zs.unit = seg.unit and zs.t >= seg.start and zs.t < least(seg.stop, seg.start + 12) group by 1, 2, 3)
select unit, start, cast(arg_max(var, (z, -var)) as int) as root from w group by 1, 2""")
def inferred_roots(spark, sf_dir):
    """Of every labelled segment the variable that deviates most in its first window."""
    s = adapters.event_series(spark, sf_dir)
    stats = s.groupBy("unit", "var").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + 1e-8).alias("s"))
    z = s.join(F.broadcast(stats), ["unit", "var"]).select("unit", "t", "var", ((F.col("x") - F.col("m")) / F.col("s")).alias("x"))
    return plants.inferred_roots(z, labelled_segments(spark, sf_dir), 12)


@query("expert_graph")
def expert_graph(spark, sf_dir):
    """The experts' edges between the water plant's variables, by number."""
    return plants.expert_graph(spark)


@query("json_records", "select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by 1")
def json_records(spark, sf_dir):
    """Records written as JSON and read again."""
    o = adapters.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    path = scratch.fresh_dir(spark, "records")
    files.write_json(o, path)
    return files.json_records(spark, path, "o_orderstatus string, n long, mean double")


@query("edge_store", f"with {CELLS}, {EDGES} select src, dst, round(w, 6) as w from edges")
def edge_store(spark, sf_dir):
    """A graph that is computed when it is missed and read from then on; the second call must not compute."""
    path = scratch.fresh_dir(spark, "edges")
    scratch.stored(spark, path, lambda: vector_graph(spark, sf_dir))

    def never():
        raise AssertionError("the graph was there")

    return scratch.stored(spark, path, never).select("src", "dst", F.round("w", 6).alias("w"))


@query("resumed_write", f"with {SERIES} select unit, count(*) as n, round(sum(x), 3) as total from series group by 1")
def resumed_write(spark, sf_dir):
    """A job that stopped after two units and goes on: each unit is there once."""
    s, path = adapters.event_series(spark, sf_dir), scratch.fresh_dir(spark, "units")
    files.write_missing(s.where("unit < 2"), path, ["unit"])
    files.write_missing(s, path, ["unit"])
    return files.StagedTable(spark, path, ["unit"]).read().groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total"))


@query("run_log")
def run_log(spark, sf_dir):
    """Queries run by name, one of which fails; the log has a row each, and the failure stops nothing."""
    def bad(spark, sf_dir):
        raise ValueError("meant")

    path = scratch.fresh_dir(spark, "log")
    queries = {"one": lambda s, d: s.range(10), "bad": bad, "two": lambda s, d: s.range(20)}
    for name, status, seconds in runner.run(spark, sf_dir, queries, timeout=600):
        files.log_run(spark, path, name, status, seconds)
    return spark.read.schema("name string, status string, seconds double").json(path).select("name", F.split("status", ":")[0].alias("status"), (F.col("seconds") < 600).alias("in_time"))


INJECTED = """ep as (select unit, (['step', 'ramp', 'spike', 'drift'])[unit + 1] as kind from (select distinct unit from series)),
inj as (select s.unit, s.var, ep.kind, s.x, s.t - 300 as d from series s join ep on ep.unit = s.unit where s.t >= 300 and s.t < 400)"""


@query("injected_series", f"""with {SERIES}, {INJECTED} select unit, kind, count(*) as n, round(sum(case kind when 'step' then 4.0 when 'ramp' then 4.0 * d / 100 when 'spike' then case when d < 5 then 12.0 else 0.0 end else 4.0 * (d / 100.0) * (d / 100.0) end), 4) as added from inj group by 1, 2""")
def injected_series(spark, sf_dir):
    """Additive anomalies, a kind per unit: what they add in all."""
    kinds = F.element_at(F.array(*map(F.lit, simulators.KINDS)), F.col("unit") + 1)
    s = adapters.event_series(spark, sf_dir).withColumn("kind", kinds)
    moved = simulators.injected(F.col("kind"), F.col("x"), F.col("t") - 300, F.lit(100), 2.0, F.lit(2.0), F.lit(0.0))
    rows = s.withColumn("added", moved - F.col("x")).where("t >= 300 and t < 400")
    return rows.groupBy("unit", "kind").agg(F.count("*").alias("n"), F.round(F.sum("added"), 4).alias("added"))


@query("relational_series")
def relational_series(spark, sf_dir):
    """Episodes in which the edges into one variable act 2.5 times as strongly; that variable is the root."""
    s = simulators.relational_series(spark, 3)
    return s.groupBy("unit", "root").agg(F.count("*").alias("n"), F.round(F.stddev_pop(F.when(F.col("inside"), F.col("x"))) / F.stddev_pop(F.when(~F.col("inside"), F.col("x"))), 3).alias("ratio"))


@query("tanh_series")
def tanh_series(spark, sf_dir):
    """A saturating system along its graph."""
    s = simulators.scm_series(spark, 3, steps=2000, kind="tanh")
    return s.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.max(F.abs("x")), 3).alias("peak"))


@query("simulated_graph_sources")
def simulated_graph_sources(spark, sf_dir):
    """Of simulated units the true graph, that discovered on the clean series, and that discovered with episodes in it; recall and
    precision of the latter two."""
    units, nodes = 2, 6
    true = simulators.true_edges(spark, units, nodes)
    clean = simulators.scm_series(spark, units, nodes=nodes, steps=2000)
    moved = simulators.injected(F.lit("step"), F.col("x"), F.col("t") - 1200, F.lit(400), 3.0, F.lit(1.0), F.lit(0.0))
    bad = clean.withColumn("x", F.when(F.col("var") == F.col("unit"), moved).otherwise(F.col("x")))
    out = None
    for name, series in (("clean", clean), ("contaminated", bad)):
        found = discovery.pcmci(series, max_lag=2).cache()
        for unit in range(units):
            row = graphs.precision_recall(found.where(F.col("unit") == unit), true.where(F.col("unit") == unit)).select(F.lit(name).alias("source"), F.lit(unit).alias("unit"), F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"))
            out = row if out is None else out.unionByName(row)
    return out
