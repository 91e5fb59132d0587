"""Queries on labelled scores: order values against their priority, document labels against text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import hashing
from causeway.operators import selection, statistics, windows
from causeway.plans.core import query, u
from causeway.sources import adapters

#: Binary labels with a score in [0, 1]: document quality against a hashed blend with the text's length.
PREDS = f"preds as (select l.doc_id, l.quality as y, d.source, d.lang, round(0.5 * {u("'p'", 'l.doc_id')} + 0.5 * (0.6 * l.quality + 0.2 * least(d.n_chars, 5000) / 5000.0::double), 4) as p from labels l join documents d on d.doc_id = l.doc_id)"


def preds(spark, sf_dir):
    labels = adapters.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    p = 0.5 * hashing.uniform("p", F.col("doc_id")) + 0.5 * (0.6 * F.col("y") + 0.2 * F.least("n_chars", F.lit(5000)) / 5000.0)
    return labels.join(docs, "doc_id").select("doc_id", "y", "source", "lang", F.round(p, 4).alias("p"))


def rounded(df, digits=6, keep=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


AUROC = "select {g} round(sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0), 6) as auroc, cast(sum(p) as bigint) as np, cast(sum(n) as bigint) as nn from (select {g} p_, sum(y) as p, sum(1 - y) as n, coalesce(sum(sum(1 - y)) over ({w} order by p_ rows between unbounded preceding and 1 preceding), 0) as below from (select {g} p as p_, y from preds) group by {g} p_) {t}"


@query("auroc", f"with {PREDS} " + AUROC.format(g="", w="", t=""))
def auroc(spark, sf_dir):
    return rounded(statistics.auroc(preds(spark, sf_dir), "y", "p"))


@query("auroc_by_language", f"with {PREDS} " + AUROC.format(g="lang,", w="partition by lang", t="group by lang"))
def auroc_by_language(spark, sf_dir):
    return rounded(statistics.auroc(preds(spark, sf_dir), "y", "p", ("lang",)))


@query("average_precision", f"""with {PREDS}, c as (select p, sum(y)::double as s, count(*) as n from preds group by p), k as (select s, sum(s) over w / sum(n) over w as pr from c window w as (order by p desc rows between unbounded preceding and current row))
select round(sum(s * pr) / sum(s), 6) as average_precision from k""")
def average_precision(spark, sf_dir):
    return rounded(statistics.average_precision(preds(spark, sf_dir), "y", "p"))


@query("ece_brier", f"""with {PREDS}, b as (select least(floor(p * 10), 9) as b, count(*) as n, avg(p) as p, avg(y) as y, sum(pow(p - y, 2)) as q, sum(y) as s from preds group by 1)
select round(sum(abs(p - y) * n) / sum(n), 6) as ece, round(sum(q) / sum(n), 6) as brier, round(1 - sum(q) / sum(n) / (sum(s) / sum(n) * (1 - sum(s) / sum(n))), 6) as skill from b""")
def ece_brier(spark, sf_dir):
    return rounded(statistics.ece_brier(preds(spark, sf_dir), "y", "p"))


@query("calibration_bins", f"with {PREDS} select cast(least(floor(p * 10), 9) as int) as bin, count(*) as n, round(avg(p), 6) as p, round(avg(y), 6) as y from preds group by 1")
def calibration_bins(spark, sf_dir):
    return rounded(statistics.calibration(preds(spark, sf_dir), "y", "p"))


@query("coverage_curve", f"""with {PREDS}, r as (select y, row_number() over (order by p desc, doc_id) as k, count(*) over () as n, avg(y) over (order by p desc, doc_id rows between unbounded preceding and current row) as a from preds),
s as (select unnest([0.1, 0.25, 0.5, 0.75, 1.0])::double as share) select s.share, r.k, round(r.a, 6) as accuracy from r, s where r.k = greatest(1, round_even(s.share * r.n, 0))""")
def coverage_curve(spark, sf_dir):
    return rounded(windows.coverage_curve(preds(spark, sf_dir), "y", "p", "doc_id", (0.1, 0.25, 0.5, 0.75, 1.0)), keep=("share",))


@query("selector_routing", f"""with {PREDS}, s as (select lang, y, p, {u("'a'", 'doc_id')} < 0.6 as a, {u("'b'", 'doc_id')} < 0.5 as b from preds)
select lang, round(avg(a::int), 6) as method_a, round(avg(b::int), 6) as method_b, round(avg(case when p > 0.5 then b::int else a::int end), 6) as routed, round(avg(greatest(a::int, b::int)), 6) as oracle from s group by lang""")
def selector_routing(spark, sf_dir):
    s = preds(spark, sf_dir).withColumns({k: (hashing.uniform(k, F.col("doc_id")) < t).cast("int") for k, t in (("a", 0.6), ("b", 0.5))})
    routed = F.when(F.col("p") > 0.5, F.col("b")).otherwise(F.col("a"))
    return rounded(s.groupBy("lang").agg(F.avg("a").alias("method_a"), F.avg("b").alias("method_b"), F.avg(routed).alias("routed"), F.avg(F.greatest("a", "b")).alias("oracle")))


@query("conformal_threshold", f"""with {PREDS}, t as (select quantile_cont(p, 0.7) as tau from preds where {u("'cal'", 'doc_id')} < 0.5)
select round(max(tau), 6) as tau, count(*) as selected, round(avg(1 - y), 6) as risk from preds, t where {u("'cal'", 'doc_id')} >= 0.5 and p >= tau""")
def conformal_threshold(spark, sf_dir):
    p = preds(spark, sf_dir).withColumn("u", hashing.uniform("cal", F.col("doc_id")))
    tau = selection.quantiles(p.where("u < 0.5"), "p", {"tau": 0.7})
    kept = p.where("u >= 0.5").join(F.broadcast(tau)).where("p >= tau")
    return rounded(kept.agg(F.max("tau").alias("tau"), F.count("*").alias("selected"), F.avg(1 - F.col("y")).alias("risk")))


@query("certificate_cascade", f"""with {PREDS}, s as (select y, p, {u("'cert'", 'doc_id')} < 0.2 as c from preds), t as (select unnest([0.4, 0.5, 0.6])::double as tau)
select tau, round(avg((c or p >= tau)::int), 6) as coverage, round(avg(case when c or p >= tau then y end), 6) as accuracy from s, t group by tau""")
def certificate_cascade(spark, sf_dir):
    s = preds(spark, sf_dir).withColumn("c", hashing.uniform("cert", F.col("doc_id")) < 0.2).withColumn("tau", F.explode(F.array(*map(F.lit, (0.4, 0.5, 0.6)))))
    on = F.col("c") | (F.col("p") >= F.col("tau"))
    return rounded(s.groupBy("tau").agg(F.avg(on.cast("int")).alias("coverage"), F.avg(F.when(on, F.col("y"))).alias("accuracy")), keep=("tau",))


@query("fold_percentiles", f"""with {PREDS}, r as (select doc_id, lang, row_number() over (partition by lang order by p, doc_id) - 1 as i, count(*) over (partition by lang) as n from preds) select doc_id, round(i / (n - 1.0), 6) as pct from r where n > 1""")
def fold_percentiles(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("lang")
    r = preds(spark, sf_dir).withColumn("pct", F.percent_rank().over(w.orderBy("p", "doc_id"))).withColumn("n", F.count("*").over(w))
    return rounded(r.where("n > 1").select("doc_id", "pct"))


@query("fold_guard", f"with {PREDS} select source, count(*) as n from preds group by source having count(distinct y) = 2 and count(*) >= 10")
def fold_guard(spark, sf_dir):
    return preds(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("y").alias("c")).where("c = 2 and n >= 10").drop("c")


@query("wilson", f"""with {PREDS}, c as (select lang, sum(y)::double as k, count(*)::double as n from preds group by lang)
select lang, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) as low, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) as high from c""")
def wilson(spark, sf_dir):
    c = preds(spark, sf_dir).groupBy("lang").agg(F.sum("y").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return rounded(c.select("lang", low.alias("low"), high.alias("high")))


@query("holm", f"""with {PREDS}, s as (select source, min({u("'h'", 'doc_id')}) as p from preds group by source), r as (select *, row_number() over (order by p, source) - 1 as i, count(*) over () as m from s)
select source, round(p, 8) as p, round(least(1.0, max((m - i) * p) over (order by p, source rows between unbounded preceding and current row)), 8) as adjusted from r""")
def holm(spark, sf_dir):
    s = preds(spark, sf_dir).groupBy("source").agg(F.min(hashing.uniform("h", F.col("doc_id"))).alias("p"))
    return rounded(statistics.holm(s, "p", "source"), 8)


@query("cliffs_delta", f"""with {PREDS}, c as (select p, sum(y) as a, sum(1 - y) as b from preds group by p), k as (select *, coalesce(sum(b) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from c)
select round((2.0 * sum(a * below) + sum(a * b)) / (sum(a) * sum(b)) - 1, 6) as delta from k""")
def cliffs_delta(spark, sf_dir):
    return rounded(statistics.cliffs_delta(preds(spark, sf_dir), "y", "p"))


@query("spearman", f"""with {PREDS}, d as (select preds.p, d.n_chars as c from preds join documents d on d.doc_id = preds.doc_id), r as (select rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as a, rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0 as b from d)
select round(corr(a, b), 6) as rho from r""")
def spearman(spark, sf_dir):
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rounded(statistics.spearman(preds(spark, sf_dir).join(d, "doc_id").select("p", "n_chars"), "p", "n_chars"))


@query("scaling_fit", "select round(regr_slope(o_totalprice, o_custkey), 8) as slope, round(regr_intercept(o_totalprice, o_custkey), 4) as intercept, round(regr_r2(o_totalprice, o_custkey), 8) as r2, round(corr(o_totalprice, o_custkey), 8) as pearson from orders")
def scaling_fit(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    y, x = F.col("o_totalprice"), F.col("o_custkey")
    return o.agg(F.round(F.regr_slope(y, x), 8).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"), F.round(F.corr(y, x), 8).alias("pearson"))


POISSON = "case when {u} < 0.367879441 then 0 when {u} < 0.735758882 then 1 when {u} < 0.919698603 then 2 when {u} < 0.981011843 then 3 when {u} < 0.996340153 then 4 when {u} < 0.999405815 then 5 else 6 end"


def spread(seed: str, row: str, round_: str = "round_") -> str:
    """SQL of a row's draw in a round: see statistics.resampled."""
    part = lambda k: f"('0x' || substr(md5('{seed}|{k}|' || cast({round_} as varchar)), 1, 7))::bigint"
    h = f"('0x' || substr(md5('{seed}|' || cast({row} as varchar)), 1, 8))::bigint"
    return f"((({h} % 2147483647) * ({part('a')} + 1) + {part('b')}) % 2147483647 / 2147483647.0::double)"


@query("bootstrap_ci", f"""with {PREDS}, b as (select unnest(range(200)) as round_), m as (select b.round_, sum(w * y)::double / sum(w) as m from (select b.round_, y, {POISSON.format(u=spread('0', 'doc_id', 'b.round_'))} as w from preds, b) b group by 1)
select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""")
def bootstrap_ci(spark, sf_dir):
    return rounded(statistics.bootstrap_ci(preds(spark, sf_dir), "y", "doc_id", 200))


@query("cluster_bootstrap", f"""with {PREDS}, c as (select source, sum(y)::double as s, count(*) as n from preds group by source), b as (select unnest(range(200)) as round_),
m as (select b.round_, sum(w * s) / sum(w * n) as m from (select b.round_, s, n, {POISSON.format(u=u("'c'", 'b.round_', 'source'))} as w from c, b) b group by 1)
select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""")
def cluster_bootstrap(spark, sf_dir):
    c = preds(spark, sf_dir).groupBy("source").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    draws = c.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("w", statistics.poisson_weight(hashing.uniform("c", F.col("round"), F.col("source"))))
    m = draws.groupBy("round").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    return rounded(m.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")))


DIFF = f"diff as (select doc_id, round(p - {u("'q'", 'doc_id')}, 6) as d from preds)"


@query("paired_permutation", f"""with {PREDS}, {DIFF}, b as (select unnest(range(1, 501)) as round_), m as (select round_, avg(case when {spread('0', 'doc_id')} < 0.5 then -d else d end) as m from diff, b group by 1), o as (select avg(d) as o from diff)
select round(max(o), 8) as observed, round(count(*) filter (abs(m) >= abs(o) - 1e-12) / 500.0, 6) as p_value from m, o""")
def paired_permutation(spark, sf_dir):
    d = preds(spark, sf_dir).select("doc_id", F.round(F.col("p") - hashing.uniform("q", F.col("doc_id")), 6).alias("d"))
    return rounded(statistics.paired_permutation(d, "d", "doc_id", 500), 8)


@query("wilcoxon", f"""with {PREDS}, {DIFF}, r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from diff where d <> 0)
select round(sum(case when d > 0 then r else 0 end), 4) as w, count(*) as n from r""")
def wilcoxon(spark, sf_dir):
    d = preds(spark, sf_dir).select(F.round(F.col("p") - hashing.uniform("q", F.col("doc_id")), 6).alias("d"))
    return statistics.wilcoxon(d, "d").select(F.round("w", 4).alias("w"), "n")


@query("wilcoxon_p_value")
def wilcoxon_p_value(spark, sf_dir):
    d = preds(spark, sf_dir).select(F.round(F.col("p") - hashing.uniform("q", F.col("doc_id")), 6).alias("d"))
    return statistics.wilcoxon(d, "d")


@query("signed_rank_exact")
def signed_rank_exact(spark, sf_dir):
    """The signed-rank test of the sources' mean differences: few, so its p value is exact. A test enumerates all signs."""
    d = preds(spark, sf_dir).withColumn("d", F.col("p") - hashing.uniform("q", F.col("doc_id")))
    means = d.groupBy("source").agg(F.round(F.avg("d"), 6).alias("d"))
    return statistics.wilcoxon(means, "d").select(F.round("w", 4).alias("w"), "n", F.round("p_value", 9).alias("p_value"))


@query("hypergeometric_tail")
def hypergeometric_tail(spark, sf_dir):
    c = preds(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("drawn"), F.sum("y").alias("seen"))
    whole = preds(spark, sf_dir).agg(F.count("*").alias("population"), F.sum("y").alias("marked"))
    return statistics.hypergeometric_tail(c.join(F.broadcast(whole)), "population", "marked", "drawn", "seen")


@query("trimmed_mean", """with r as (select o_orderpriority, o_totalprice as x, row_number() over (partition by o_orderpriority order by o_totalprice) as r, count(*) over (partition by o_orderpriority) as n from orders)
select o_orderpriority, round(avg(x), 4) as trimmed from r where r > greatest(1, n // 10) and r <= n - greatest(1, n // 10) group by 1""")
def trimmed_mean(spark, sf_dir):
    """By rank, so no group is gathered."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority")
    o = adapters.table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    r = o.withColumn("r", F.row_number().over(w.orderBy("o_totalprice"))).withColumn("n", F.count("*").over(w))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    return r.where((F.col("r") > cut) & (F.col("r") <= F.col("n") - cut)).groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("trimmed"))


@query("grouping_breakdown", "select o_orderstatus, o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as spread, round(quantile_cont(o_totalprice, 0.9), 4) as q90 from orders group by grouping sets ((), (o_orderstatus), (o_orderpriority))")
def grouping_breakdown(spark, sf_dir):
    """Over all rows, by status and by priority. The quantile is selected by counting, so no task holds a group."""
    o = adapters.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    none = F.lit(None).cast("string")
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), a.alias("a"), b.alias("b")) for k, (a, b) in enumerate(((none, none), (F.col("o_orderstatus"), none), (none, F.col("o_orderpriority"))))]))
    rows = o.select(sets.alias("s"), F.col("o_totalprice").alias("x")).select("s.of", "s.a", "s.b", "x")
    sums = rows.groupBy("of", "a", "b").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("spread"))
    q90 = selection.quantiles(rows, "x", {"q90": 0.9}, ("of", "a", "b")).select(F.col("of").alias("o2"), F.col("a").alias("a2"), F.col("b").alias("b2"), "q90")
    both = sums.join(q90, [F.col("of") == F.col("o2"), F.col("a").eqNullSafe(F.col("a2")), F.col("b").eqNullSafe(F.col("b2"))])
    return both.select(F.col("a").alias("o_orderstatus"), F.col("b").alias("o_orderpriority"), "n", "mean", "spread", F.round("q90", 4).alias("q90"))


@query("weighted_mean", "select l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as weighted from lineitem group by 1")
def weighted_mean(spark, sf_dir):
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return adapters.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(q * x) / F.sum(q), 4).alias("weighted"))


@query("most_common", "select o_orderstatus, o_orderpriority, n from (select o_orderstatus, o_orderpriority, count(*) as n, row_number() over (partition by o_orderstatus order by count(*) desc, o_orderpriority) as r from orders group by 1, 2) where r <= 3")
def most_common(spark, sf_dir):
    from pyspark.sql import Window

    c = adapters.table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("n"), "o_orderpriority")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("method_pivot", "select o_orderstatus, max(case when o_orderpriority = '1-URGENT' then o_totalprice end) as urgent, max(case when o_orderpriority = '5-LOW' then o_totalprice end) as low from orders group by 1")
def method_pivot(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.max("o_totalprice"))
    return p.select("o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("gram_matrix", "with c as (select unnest(embedding)::double as x, unnest(range(len(embedding)))::int as var, vec_id from embeddings) select a.var as i, b.var as j, round(sum(a.x * b.x), 4) as s from c a join c b on a.vec_id = b.vec_id group by 1, 2")
def gram_matrix(spark, sf_dir):
    from causeway.operators.moments import gram

    g = gram(adapters.vectors(spark, sf_dir))[1:, 1:]
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(g) for j, v in enumerate(row)], "i int, j int, s double").withColumn("s", F.round("s", 4))


@query("edge_list_join", "select l_suppkey, count(distinct l_partkey) as parts, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey group by 1")
def edge_list_join(spark, sf_dir):
    s = adapters.table(spark, sf_dir, "supplier").select("s_suppkey")
    return adapters.table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"))


@query("order_series", "select n_regionkey as unit, count(*) as n_cells, round(sum(x), 2) as total from (select c_nationkey, o_orderdate::date as d, sum(o_totalprice) as x from orders join customer on c_custkey = o_custkey group by 1, 2) join nation on n_nationkey = c_nationkey group by 1")
def order_series(spark, sf_dir):
    return adapters.order_series(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n_cells"), F.round(F.sum("x"), 2).alias("total"))

