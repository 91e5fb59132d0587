"""Validity, stability, quadrants, certificates. Columns hold arrays phi and roots; instances are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import arrays


def hits(df: DataFrame, phi: str = "phi", roots: str = "roots", ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return df.withColumns({f"hit{k}": arrays.hit(F.col(phi), F.col(roots), k) for k in ks})


def with_base(base: DataFrame, perturbed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return perturbed if "phi0" in perturbed.columns else perturbed.join(base.select(*keys, F.col("phi").alias("phi0")), list(keys))


def acr(base: DataFrame, perturbed: DataFrame, keys: tuple[str, ...], k: int = 3) -> DataFrame:
    """Per window and instance the share of the top k that stays. base is matched by keys; rows that carry phi0 need no match."""
    both = with_base(base, perturbed, keys)
    return both.withColumn("acr", arrays.overlap(F.col("phi"), F.col("phi0"), k))


def cells(acrs: DataFrame, group: tuple[str, ...], instance: str = "instance") -> DataFrame:
    """Mean over windows, then over instances."""
    per = acrs.groupBy(*group, instance).agg(F.avg("acr").alias("acr"), F.avg("hit3").alias("hit3_pert"), F.count("*").alias("n"))
    return per.groupBy(*group).agg(F.avg("acr").alias("acr"), F.avg("hit3_pert").alias("hit3_pert"), F.max("n").alias("n_windows"))


def quadrant(acr_: Column, hit_: Column, stable: float = 0.8, right: float = 0.4) -> Column:
    """SW, SR, UR or UW. Stable is strictly above its threshold, right is at or above."""
    return F.when(acr_ > stable, F.when(hit_ < right, "SW").otherwise("SR")).otherwise(F.when(hit_ >= right, "UR").otherwise("UW"))


def quadrant_shares(df: DataFrame, acr_: str, hit_: str, *sets: tuple[str, ...]) -> DataFrame:
    """Shares of the four quadrants by several groupings in one pass; each row names its grouping in `by`."""
    dims = sorted({c for s in sets for c in s})
    marked = df.withColumn("q", quadrant(F.col(acr_), F.col(hit_)))
    shares = [F.avg((F.col("q") == k).cast("int")).alias(k.lower()) for k in ("SW", "SR", "UR", "UW")]
    grouped = marked.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims])
    return grouped.agg(F.count("*").alias("n"), *shares)


def threshold_grid(df: DataFrame, acr_: str, hit_: str, stables: list[float], rights: list[float]) -> DataFrame:
    """Stable-but-wrong share at every pair of thresholds."""
    grid = df.select(acr_, hit_, F.explode(F.array(*map(F.lit, stables))).alias("stable")).select("*", F.explode(F.array(*map(F.lit, rights))).alias("right"))
    return grid.groupBy("stable", "right").agg(F.avg(((F.col(acr_) > F.col("stable")) & (F.col(hit_) < F.col("right"))).cast("int")).alias("sw"))


def ac_at_k(phi: Column, roots: Column, k: int) -> Column:
    return F.size(F.array_intersect(arrays.topk(phi, k), roots)) / F.least(F.lit(k), F.size(roots))


def precision3(phi: Column, roots: Column) -> Column:
    return F.size(F.array_intersect(arrays.topk(phi, 3), roots)) / F.lit(3)


def gap(phi: Column) -> Column:
    """Third minus fourth largest."""
    s = F.sort_array(phi, asc=False)
    return F.element_at(s, 3) - F.element_at(s, 4)


def displacement(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def certificates(base: DataFrame, perturbed: DataFrame, keys: tuple[str, ...], train: int) -> DataFrame:
    """Per window: gap, largest and quantile displacements of the first `train` instances, flips among the rest, and whether the
    gap exceeds twice the displacement."""
    both = with_base(base, perturbed, keys)
    rows = both.select(
        *keys, "instance", gap(F.col("phi0")).alias("gap"), displacement(F.col("phi"), F.col("phi0")).alias("eta"),
        (F.size(F.array_except(arrays.topk(F.col("phi0"), 3), arrays.topk(F.col("phi"), 3))) > 0).cast("int").alias("flip"),
    )
    seen = F.col("instance") < train
    out = rows.groupBy(*keys).agg(
        F.max("gap").alias("gap"), F.max(F.when(seen, F.col("eta"))).alias("eta_max"), F.percentile(F.when(seen, F.col("eta")), F.lit(0.5)).alias("eta50"),
        F.percentile(F.when(seen, F.col("eta")), F.lit(0.75)).alias("eta75"), F.avg(F.when(~seen, F.col("flip"))).alias("flip_eval"), F.max(F.when(~seen, F.col("eta"))).alias("eta_eval"),
    )
    return out.select(
        *keys, "gap", "eta_max", "flip_eval", "eta50", "eta75", (F.col("eta_eval") > F.col("eta_max")).cast("int").alias("violated"),
        *[(F.col("gap") > 2 * F.col(e)).cast("int").alias(n) for e, n in (("eta_max", "cert_worst"), ("eta50", "cert_emp50"), ("eta75", "cert_emp75"))],
    )


def signed_margin(phi0: Column, phi: Column) -> Column:
    """Least score of the base's top three minus the largest score outside, under the perturbed scores."""

    def margin(top: Column) -> Column:
        inside = F.array_min(F.transform(top, lambda i: F.get(phi, i)))
        outside = F.array_max(F.transform(phi, lambda v, i: F.when(~F.array_contains(top, i), v)))
        return inside - outside

    return arrays.let(arrays.topk(phi0, 3), margin)


def consensus(all_phi: DataFrame, keys: tuple[str, ...], share: float) -> DataFrame:
    """Variables that are in the top three of at least `share` of the instances (the base counts as one)."""
    n = all_phi.groupBy(*keys).agg(F.count("*").alias("n"))
    seen = all_phi.select(*keys, F.explode(arrays.topk(F.col("phi"), 3)).alias("var")).groupBy(*keys, "var").agg(F.count("*").alias("c"))
    return seen.join(n, list(keys)).where(F.col("c") >= share * F.col("n")).groupBy(*keys).agg(F.array_sort(F.collect_list("var")).alias("vars"))


def disagreement(df: DataFrame, keys: tuple[str, ...], method: str = "method") -> DataFrame:
    """Mean 1 - overlap of the top three over the pairs of methods; methods are few, so pairs are made inside the group."""
    per = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(method, arrays.topk(F.col("phi"), 3).alias("top")))).alias("m"))
    pairs = per.select(*keys, F.posexplode("m").alias("i", "a"), "m").select(*keys, "i", "a", F.posexplode("m").alias("j", "b")).where("i < j")
    return pairs.groupBy(*keys).agg(F.avg(1 - F.size(F.array_intersect("a.top", "b.top")) / F.lit(3)).alias("disagreement"))


def consistency(acrs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The gate: mean overlap per window over its perturbations."""
    return acrs.groupBy(*keys).agg(F.avg("acr").alias("cons"))


def prefix_means(acrs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Mean overlap over the first m instances for several m, in one pass."""
    return acrs.agg(*[F.avg(F.when(F.col("instance") < m, F.col("acr"))).alias(f"acr_m{m}") for m in sizes])


def widened_roots(roots: DataFrame, edges: DataFrame, z: DataFrame, least: float = 3.0) -> DataFrame:
    """Roots and those of their graph children whose deviation exceeds `least`."""
    flat = roots.select("window_id", F.explode("roots").alias("src"))
    children = flat.join(edges.select("src", "dst"), "src").join(z.where(F.col("z") > least).select("window_id", F.col("var").alias("dst")), ["window_id", "dst"])
    every = flat.select("window_id", F.col("src").alias("v")).unionByName(children.select("window_id", F.col("dst").alias("v")))
    return every.groupBy("window_id").agg(F.array_sort(F.collect_set("v")).alias("wide"))


def best_of(df: DataFrame, keys: tuple[str, ...], by: Column) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_r = 1").drop("_r")
