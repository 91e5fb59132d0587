"""Predictors, robust variants and streams: checked by rows and by tests, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import arrays, hashing
from causeway.operators import attribution, graphs, methods, metrics, predict, repair, selection, statistics
from causeway.plans.attribution_queries import SIZE, audited, edge_list, setup, vector_graph
from causeway.plans.core import BASE, NOISE, SERIES, query
from causeway.sources import adapters, scratch
from causeway.streaming import series as streams


def window_features(spark, sf_dir):
    """Per window: attribution, deviation, score and consistency features, and whether the root is in the top three."""
    base, _, _ = setup(spark, sf_dir)
    share = F.sort_array(arrays.normalized(F.col("phi")), asc=False)
    rows = base.select("window_id", "label", arrays.hit(F.col("phi"), F.col("roots"), 3).alias("y"), share.alias("p"), arrays.dot(F.col("phi"), F.col("phi")).alias("score"))
    q = selection.quantiles(rows, "score", {"q50": 0.5, "q90": 0.9, "q99": 0.99}).join(rows.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd")))  # one row each
    cons = metrics.consistency(audited(spark, sf_dir), ("window_id",))
    both = rows.join(F.broadcast(q)).join(cons, "window_id")
    return both.select(
        F.col("window_id").alias("key"), F.col("label").alias("grp"), F.col("y").cast("double").alias("label"), F.element_at("p", 1).alias("a_top1_share"), arrays.total(F.slice("p", 1, 3)).alias("a_top3_share"),
        arrays.entropy(F.col("p")).alias("a_attr_entropy"), (F.element_at("p", 1) - F.element_at("p", 2)).alias("a_top_gap"), (F.element_at("p", 1) / F.element_at("p", 2)).alias("a_top_ratio"),
        ((F.col("score") - F.col("q90")) / (F.col("q90") + 1e-9)).alias("s_score_margin_rel"), ((F.col("score") - F.col("m")) / (F.col("sd") + 1e-9)).alias("s_score_z"), (F.col("score") > F.col("q99")).cast("double").alias("s_score_exceed99"),
        F.col("cons").alias("c_cons_topk3"),
    )


@query("window_features", f"""{BASE}, {NOISE}, s as (select window_id, max(label) as grp, sum(z * z) as score from z group by 1), q as (select quantile_cont(score, 0.9) as q90, quantile_cont(score, 0.99) as q99, avg(score) as m, stddev_pop(score) as sd from s),
c as (select window_id, avg(acr) as cons from acrs group by 1)
select s.window_id as key, grp, round((score - q90) / (q90 + 1e-9), 6) as s_score_margin_rel, round((score - m) / (sd + 1e-9), 6) as s_score_z, (score > q99)::int::double as s_score_exceed99, round(c.cons, 6) as c_cons_topk3 from s join c on c.window_id = s.window_id, q""")
def window_features_query(spark, sf_dir):
    f = window_features(spark, sf_dir)
    return f.select("key", "grp", F.round("s_score_margin_rel", 6).alias("s_score_margin_rel"), F.round("s_score_z", 6).alias("s_score_z"), "s_score_exceed99", F.round("c_cons_topk3", 6).alias("c_cons_topk3"))


def fitted(spark, sf_dir, kind):
    rows = window_features(spark, sf_dir).cache()  # folds need their groups' sizes first
    columns = [c for c in rows.columns if c not in ("key", "grp", "label")]
    rows, columns = predict.with_missing_flags(rows, columns)
    return predict.out_of_fold(predict.grouped_folds(rows, "grp", 3), columns, kind, 3)


@query("reliability_gbt")
def reliability_gbt(spark, sf_dir):
    return statistics.auroc(fitted(spark, sf_dir, "gbt"), "label", "p", ("fold",))


@query("reliability_lr")
def reliability_lr(spark, sf_dir):
    return statistics.auroc(fitted(spark, sf_dir, "lr"), "label", "p", ("fold",))


@query("reliability_rf")
def reliability_rf(spark, sf_dir):
    return statistics.auroc(fitted(spark, sf_dir, "rf"), "label", "p", ("fold",))


@query("reliability_mlp")
def reliability_mlp(spark, sf_dir):
    return statistics.auroc(fitted(spark, sf_dir, "mlp"), "label", "p", ("fold",))


@query("feature_ablation")
def feature_ablation(spark, sf_dir):
    """AUROC with only some groups of features."""
    rows = predict.gathered(predict.grouped_folds(window_features(spark, sf_dir).cache(), "grp", 2))
    out = None
    for groups in ("a", "s", "asc"):
        columns = predict.selected(rows.columns, groups)
        row = statistics.auroc(predict.out_of_fold(rows, columns, "lr", 2), "label", "p").select(F.lit(groups).alias("features"), "auroc")
        out = row if out is None else out.unionByName(row)
    return out


@query("grouped_folds", "select label, cast(case when (r // 3) % 2 = 0 then r % 3 else 2 - r % 3 end as int) as fold from (select label, row_number() over (order by count(*) desc, label) - 1 as r from embeddings group by label)")
def grouped_folds(spark, sf_dir):
    v = adapters.table(spark, sf_dir, "embeddings").select("label")
    return predict.grouped_folds(v, "label", 3).distinct()


def graa_v3(rows, edges, size, instances=6, fallback=0.5):
    """rows (phi: deviations) with v3, GRAA v3: PropRank on the graph repaired over all edges, mixed with the deviation by the
    repaired graph's mean consistency; the deviation alone where that is under `fallback`."""
    z = rows.select("phi").cache()
    fixed, _ = repair.repaired(z, edges, size, instances)
    gate = repair.mean_consistency(z, fixed, repair.perturbed(fixed, instances, 0.15, size, 42), size)
    if gate < fallback:
        return rows.withColumn("v3", arrays.normalized(F.col("phi")))
    prop = rows.withColumn("_prop", attribution.proprank(F.col("phi"), fixed, size))
    return prop.withColumn("v3", attribution.mixed(F.lit(gate), F.col("_prop"), F.col("phi"))).drop("_prop")


@query("graa_variants")
def graa_variants(spark, sf_dir):
    """Hit at 3 of GRAA v1, v2 and v3 by label: gated DPTA, gated PropRank, and the repaired graph with one scalar gate."""
    base, _, _ = setup(spark, sf_dir)
    first = edge_list(vector_graph(spark, sf_dir))
    ctx, a = methods.fit_context(adapters.vectors(spark, sf_dir)), graphs.weights(first, SIZE)
    windows = base.select("window_id", "label", "values", "roots")
    gated = methods.audit(windows, ctx, ["GRAA-v1", "GRAA-v2"], {"clean": a}, [], group="label").groupBy("label").pivot("method", ["GRAA-v1", "GRAA-v2"]).agg(F.max("base_hit3"))
    v3 = graa_v3(base, first, SIZE).groupBy("label").agg(F.round(F.avg(arrays.hit(F.col("v3"), F.col("roots"), 3)), 6).alias("v3"))
    return gated.select("label", F.round("GRAA-v1", 6).alias("v1"), F.round("GRAA-v2", 6).alias("v2")).join(v3, "label")


def greedy_flips(z, edges, size, budget=2):
    """(budget, kind, src, dst, acr): each round the one change among all deletions and all additions (of weight 1, in either
    direction) that moves most top-three sets away from those of the first graph. Ties go to deletions, then in row-major order."""
    current, steps = {e[:2]: e[2] for e in edges}, []
    for n in range(1, budget + 1):
        gone = [(s, d, 0.0) for s, d in sorted(current)]
        new = [(s, d, 1.0) for s in range(size) for d in range(size) if s != d and (s, d) not in current]
        changes = gone + new
        acr = attribution.graph_overlaps(z, [(*k, w) for k, w in current.items()], changes, [edges], size)
        worst = min(range(len(changes)), key=lambda c: (acr[c], c))
        s, d, w = changes[worst]
        if w:
            current[s, d] = w
        else:
            del current[s, d]
        steps.append((n, "add" if w else "del", s, d, acr[worst]))
    return steps


@query("adversarial_flip")
def adversarial_flip(spark, sf_dir):
    """Greedy: the deletion or addition that moves most top-three sets, twice. All candidates of a round are scored in one job."""
    base, _, _ = setup(spark, sf_dir)
    steps = greedy_flips(base.select("phi").cache(), edge_list(vector_graph(spark, sf_dir)), SIZE)
    return spark.createDataFrame([(*s[:4], round(s[4], 6)) for s in steps], "budget int, kind string, src int, dst int, acr double")


@query("granger_attribution")
def granger_attribution(spark, sf_dir):
    """GraphGranger on hourly event series: 24-step windows of five variables."""
    s = adapters.event_series(spark, sf_dir)
    steps = s.groupBy("unit", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("var", "x"))), lambda c: c["x"]).alias("v"))
    w = steps.groupBy("unit", F.floor(F.col("t") / 24).alias("w")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda c: c["v"]).alias("values"))
    w = w.select((F.col("unit") * 1000 + F.col("w")).cast("long").alias("window_id"), "values").where(F.size("values") == 24)
    phi = attribution.granger(w, w, [(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0)])
    return phi.select("window_id", F.transform("phi", lambda v: F.round(v, 4)).alias("phi"))


def stream_of(spark, sf_dir):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    s = streams.event_stream(spark, sf_dir, "events.parquet", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(spark, stream):
    folder = scratch.fresh_dir(spark, "stream")
    return streams.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")


@query("stream_hourly", """select event_type, start, count(*) as n, round(sum(value), 4) as total from (select event_type, value, date_trunc('hour', ts)::timestamp as start from events) group by 1, 2 having start + interval 1 hour <= (select max(ts) from events)""")
def stream_hourly(spark, sf_dir):
    """Append mode gives the windows that the watermark has passed: those that end by the last event. What is still open then is
    given by a later run that goes on from the same checkpoint."""
    return finished(spark, streams.tumbling_sums(stream_of(spark, sf_dir), "1 hour", "0 seconds")).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("stream_sessions", """with g as (select user_id, ts::timestamp as ts, case when ts - lag(ts) over w < interval 12 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
select user_id, min(ts) as start, max(ts) + interval 12 hours as "end", count(*) as n from s group by user_id, k having max(ts) + interval 12 hours <= (select max(ts) from events)""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has passed, likewise."""
    s = finished(spark, streams.sessions(stream_of(spark, sf_dir), "12 hours", "0 seconds"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")



@query("stream_attribution", f"""with {SERIES}, med as (select var, quantile_cont(x, 0.5) as med from series group by 1), st as (select s.var, any_value(m.med) as med, quantile_cont(abs(s.x - m.med), 0.5) * 1.4826 + 1e-9 as mad from series s join med m on m.var = s.var group by 1),
n as (select unit, t // 24 as w, count(*) as n from ev group by 1, 2), g as (select unit, w, n, unnest(range(w * 24, w * 24 + 24)) as t from n where (w + 1) * 24 * 3600000 + 1704067200000 < (select epoch_ms(max(ts)) from events) - 25 * 3600000)
select g.unit, g.w + 473352 // 24 as w, k.var, any_value(g.n) as n, round(avg(abs(coalesce(s.x, 0.0) - st.med) / st.mad), 4) as phi from g cross join kinds k join st on st.var = k.var left join sums s on s.unit = g.unit and s.t = g.t and s.event_type = k.event_type group by 1, 2, 3""")
def stream_attribution(spark, sf_dir):
    """zDev of daily windows of each unit from a stream that comes week by week, with rows up to a day late: what the batch gives
    for all windows that the watermark, 25 hours back, has passed at the end."""
    base = 1704067200000 // 3600000
    series = adapters.event_series(spark, sf_dir)
    stats = attribution.stat_arrays(statistics.pool_stats(series))
    kinds = [r.event_type for r in adapters.table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    events = adapters.table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    hour = F.floor(F.unix_micros(ts) / F.lit(3_600_000_000)).cast("long")
    var = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).cast("int") - 1
    week = F.floor((hour - base + hashing.uniform("late", F.col("event_id")) * 24) / 168)
    rows = events.select((F.col("user_id") % 4).cast("int").alias("unit"), ts.alias("ts"), hour.alias("hour"), var.alias("var"), "value", week.alias("week"))
    folder = scratch.fresh_dir(spark, "stream")
    found = None
    for r in rows.select("week").distinct().orderBy("week").collect():
        # A week is one micro-batch, however many files it has: within it rows are as late as a week, and the watermark may move only after it.
        rows.where(F.col("week") == r.week).drop("week").write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema("unit int, ts timestamp, hour long, var int, value double").parquet(f"{folder}/in")
        found = streams.run_available(streams.attributed_windows(source, stats["med"], stats["mad"], 24, "25 hours"), f"{folder}/out", f"{folder}/checkpoint")
    return found.select("unit", "w", F.posexplode("phi").alias("var", "phi"), "n").select("unit", "w", "var", "n", F.round("phi", 4).alias("phi"))
