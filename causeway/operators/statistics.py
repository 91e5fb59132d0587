"""Statistics and inference on DataFrames."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import hashing
from causeway.operators import selection


#: One over the rank error of quantile sketches, as a share of the rows. A sketch of up to half as many rows is exact.
ACCURACY = 100_000


def median(c: str | Column) -> Column:
    """The interpolated median of up to ACCURACY / 2 values, from a sketch that is exact so far: the mean of the values just below and
    above the middle rank. Larger groups take `selection.quantiles`."""
    around = [F.lit(0.5 - 1 / ACCURACY), F.lit(0.5 + 1 / ACCURACY)]
    both = F.percentile_approx(c, F.array(*around), F.lit(ACCURACY))
    return (F.get(both, F.lit(0)) + F.get(both, F.lit(1))) / 2


def pool_stats(cells: DataFrame, group: tuple[str, ...] = ("var",)) -> DataFrame:
    """med, mad (1.4826 times the median deviation, + 1e-9), mean, std (population, + 1e-9) of x by group, the medians exact.

    A sketch is exact for groups of up to ACCURACY / 2 values; if any group is larger, ranks are selected by counting.
    """
    first, few = selection.settled(cells.groupBy(*group).agg(F.count("x").alias("n"), median("x").alias("med"), F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-9).alias("std")))
    small = (first.agg(F.max("n")).first()[0] or 0) <= ACCURACY // 2
    if not small:
        exact = selection.quantiles(cells, "x", {"med": 0.5}, group)
        first, few = selection.settled(first.drop("med").join(exact, list(group)))
    known = first.select(*group, "med")
    spread = cells.join(F.broadcast(known) if few else known, list(group)).withColumn("_away", F.abs(F.col("x") - F.col("med")))
    mad = spread.groupBy(*group).agg(median("_away").alias("mad")) if small else selection.quantiles(spread, "_away", {"mad": 0.5}, group)
    return first.join(mad.select(*group, (F.col("mad") * 1.4826 + 1e-9).alias("mad")), list(group)).select(*group, "med", "mad", "mean", "std")


def running(counts: DataFrame, value: str, sums: dict[str, str], groups: tuple[str, ...] = (), down: bool = False, parts: int = 64) -> DataFrame:
    """counts (a row per group and number `value`) with, for each column c of sums, the sum of c over the rows before, in the
    order of value; sums maps c to the new column's name.

    Values are cut at approximate quantiles into parts, each of which is ordered on its own; the totals of the parts before are
    added to it. So no task orders all values, and the result is exact wherever the cuts fall.
    """
    cuts = sorted(set(counts.approxQuantile(value, [k / parts for k in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    held = counts.withColumn("_part", -part if down else part)
    order = F.desc(value) if down else F.asc(value)
    totals = held.groupBy(*groups, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    totals = totals.select(*groups, "_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = held.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums]).join(F.broadcast(totals) if not groups else totals, [*groups, "_part"])
    return rows.withColumns({to: F.col(f"_{c}") + F.col(f"_in_{c}") for c, to in sums.items()}).drop("_part", *[f"_{c}" for c in sums], *[f"_in_{c}" for c in sums])


def midranks(df: DataFrame, value: str, groups: tuple[str, ...] = (), out: str = "r") -> DataFrame:
    """Average ranks of ties. The distinct values with their counts are ranked, not the rows; within groups, which are many and
    small, by a plain window, else part by part."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    if groups:
        w = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    else:
        counts = running(counts, value, {"_n": "_b"})
    return df.join(counts.select(*groups, value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(out)), [*groups, value])


def ordered(df: DataFrame, value: str, key: str, down: bool = False, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with its row number k from 1 in the order of value, ties by key, and the sums of columns up to there as {c}_so_far.
    Only rows of one value are ordered in one task."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = running(counts, value, {"_n": "_before", **{f"_s_{c}": f"_before_{c}" for c in sums}}, down=down).drop("_n", *[f"_s_{c}" for c in sums])
    tie = Window.partitionBy(value).orderBy(key)
    here = tie.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.join(before, value).withColumn("k", F.col("_before") + F.row_number().over(tie))
    rows = rows.withColumns({f"{c}_so_far": F.col(f"_before_{c}") + F.sum(c).over(here) for c in sums})
    return rows.drop("_before", *[f"_before_{c}" for c in sums])


def auroc(df: DataFrame, label: str, score: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Mann-Whitney with half credit for ties; null where a class is missing."""
    counts = df.groupBy(*groups, F.col(score).alias("_s")).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_n"))
    part = running(counts, "_s", {"_n": "_b"}, groups)
    won = part.groupBy(*groups).agg(F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2)).alias("u"), F.sum("_p").alias("np"), F.sum("_n").alias("nn"))
    return won.select(*groups, (F.col("u") / F.nullif(F.col("np") * F.col("nn"), F.lit(0))).alias("auroc"), "np", "nn")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times the gain in recall over falling distinct scores."""
    counts = df.groupBy(F.col(score).alias("_s")).agg(F.sum(label).cast("double").alias("_p"), F.count("*").alias("_c"))
    curve = running(counts, "_s", {"_p": "_bp", "_c": "_bc"}, down=True)
    precision = (F.col("_bp") + F.col("_p")) / (F.col("_bc") + F.col("_c"))
    return curve.agg((F.sum(F.col("_p") * precision) / F.nullif(F.sum("_p"), F.lit(0.0))).alias("average_precision"))


def calibration(df: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """Rows per bin of equal width: n, mean probability, mean label."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("p"), F.avg(label).alias("y"))


def ece_brier(df: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    square = F.pow(F.col(prob) - F.col(label), 2)
    per_bin = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("p"), F.avg(label).alias("y"), F.sum(square).alias("q"), F.sum(label).alias("s"))
    whole = per_bin.agg(
        (F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / F.sum("n")).alias("ece"), (F.sum("q") / F.sum("n")).alias("brier"), (F.sum("s") / F.sum("n")).alias("base")
    )
    return whole.select("ece", "brier", (1 - F.col("brier") / F.nullif(F.col("base") * (1 - F.col("base")), F.lit(0.0))).alias("skill"))


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjusted p values, monotone and at most 1."""
    w = Window.orderBy(p, key)
    m = df.agg(F.count("*").alias("m"))
    rows = df.join(F.broadcast(m)).withColumn("_i", F.row_number().over(w) - 1)  # one row
    step = rows.withColumn("_s", (F.col("m") - F.col("_i")) * F.col(p))
    return step.withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_i", "_s", "m")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def cliffs_delta(df: DataFrame, side: str, value: str) -> DataFrame:
    """P(a > b) - P(a < b) for side 1 against side 0, from counts by value."""
    counts = df.groupBy(value).agg(F.sum(side).alias("a"), F.sum(1 - F.col(side)).alias("b"))
    rows = running(counts, value, {"b": "below"})
    whole = rows.agg(F.sum(F.col("a") * F.col("below")).alias("more"), F.sum(F.col("a") * F.col("b")).alias("tie"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return whole.select(((2 * F.col("more") + F.col("tie")) / (F.col("na") * F.col("nb")) - 1).alias("delta"))


def spearman(df: DataFrame, a: str, b: str, groups: tuple[str, ...] = ()) -> DataFrame:
    ranked = midranks(midranks(df, a, groups, "ra"), b, groups, "rb")
    return ranked.groupBy(*groups).agg(F.corr("ra", "rb").alias("rho"))


#: Of the modular hash that spreads one hashed number of a row over all rounds: a prime under 2 ** 31.
PRIME = 2147483647


def resampled(df: DataFrame, value: str, key: str, rounds: int, kind: str, seed: int | str = 0, group: str | None = None) -> DataFrame:
    """(group, round, s, w): weighted sums of value and sums of weights over all rows, round by round.

    kind: poisson (hashed Poisson(1) weights, a bootstrap) or sign (hashed signs; round 0 keeps all). A row's hash h is taken
    once; its draw in round r is (h * a_r + b_r) mod PRIME. Rows stay where they are: a partition adds up all rounds in one
    matrix product and hands on a row per round (and group).
    """
    a = np.array([int(hashlib.md5(f"{seed}|a|{r}".encode()).hexdigest()[:7], 16) + 1 for r in range(rounds)], dtype=np.int64)
    b = np.array([int(hashlib.md5(f"{seed}|b|{r}".encode()).hexdigest()[:7], 16) for r in range(rounds)], dtype=np.int64)
    bounds = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(6)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                u = ((part["h"].to_numpy(np.int64)[:, None] % PRIME) * a + b) % PRIME / PRIME
                if kind == "poisson":
                    w = np.searchsorted(np.round(bounds, 9), u, "right").astype(float)
                else:
                    w = np.where(u < 0.5, -1.0, 1.0)
                    w[:, 0] = 1.0
                v = part["v"].to_numpy(float)
                groups = part["g"].to_numpy()
                for g in pd.unique(groups):
                    rows = groups == g
                    total[g] = total.get(g, 0) + np.stack([w[rows].T @ v[rows], w[rows].sum(0), np.full(rounds, float(rows.sum()))])
        for g, sums in total.items():
            yield pd.DataFrame({"g": g, "round": np.arange(rounds), "s": sums[0], "w": sums[1], "n": sums[2]})

    h = F.conv(F.substring(F.md5(hashing.key(seed, F.col(key))), 1, 8), 16, 10).cast("long")
    rows = df.select(h.alias("h"), F.col(value).cast("double").alias("v"), (F.col(group).cast("string") if group else F.lit("")).alias("g"))
    sums = rows.mapInPandas(run, "g string, round int, s double, w double, n double")
    out = sums.groupBy("g", "round").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def bootstrap_ci(df: DataFrame, value: str, key: str, rounds: int, seed: int | str = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean over `rounds` Poisson resamples."""
    means = resampled(df, value, key, rounds, "poisson", seed).select((F.col("s") / F.nullif(F.col("w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def batch_means(df: DataFrame, value: str, key: str, rounds: int, sizes: tuple[int, ...], seed: int | str = 0) -> DataFrame:
    """(size, round, m): the mean of a batch of the `size` rows with the least draws of a round, ties by key. A partition keeps
    its least draws of each round; only those are shuffled and ranked."""
    a = np.array([int(hashlib.md5(f"{seed}|a|{r}".encode()).hexdigest()[:7], 16) + 1 for r in range(rounds)], dtype=np.int64)
    b = np.array([int(hashlib.md5(f"{seed}|b|{r}".encode()).hexdigest()[:7], 16) for r in range(rounds)], dtype=np.int64)
    most = max(sizes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                x = ((part["h"].to_numpy(np.int64)[:, None] % PRIME) * a + b) % PRIME
                new = [(x[:, r], part["key"].to_numpy(), part["v"].to_numpy(float)) for r in range(rounds)]
                both = new if held is None else [tuple(np.concatenate(p) for p in zip(h, n, strict=True)) for h, n in zip(held, new, strict=True)]
                orders = [np.lexsort((k, u))[:most] for u, k, _ in both]
                held = [tuple(c[o] for c in cols) for cols, o in zip(both, orders, strict=True)]
        for r, (u, k, v) in enumerate(held or []):
            yield pd.DataFrame({"round": r, "u": u, "key": k, "v": v})

    h = F.conv(F.substring(F.md5(hashing.key(seed, F.col(key))), 1, 8), 16, 10).cast("long")
    rows = df.select(h.alias("h"), F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("v"))
    best = rows.mapInPandas(run, "round int, u long, key long, v double")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("round").orderBy("u", "key"))).where(F.col("r") <= most)
    each = best.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("r") <= F.col("size"))
    return each.groupBy("size", "round").agg(F.avg("v").alias("m"))


def poisson_weight(u: Column, most: int = 6) -> Column:
    """Quantile of a Poisson(1) variable, by its fixed distribution function."""
    out, total, term = F.lit(most), 0.0, math.exp(-1)
    steps = []
    for k in range(most):
        total += term
        steps.append((k, total))
        term /= k + 1
    for k, bound in reversed(steps):
        out = F.when(u < F.lit(round(bound, 9)), F.lit(k)).otherwise(out)
    return out


def paired_permutation(df: DataFrame, difference: str, key: str, rounds: int, seed: int | str = 0) -> DataFrame:
    """Two-sided sign-flip test of a mean difference: share of rounds at least as far from 0, hashed signs. Round 0 keeps all
    signs: the observed mean."""
    means = resampled(df, difference, key, rounds + 1, "sign", seed).select("round", (F.col("s") / F.col("n")).alias("m"))
    return means.agg(
        F.max(F.when(F.col("round") == 0, F.col("m"))).alias("observed"), F.collect_list(F.when(F.col("round") > 0, F.abs("m"))).alias("a")
    ).select("observed", (F.size(F.filter("a", lambda x: x >= F.abs(F.col("observed")) - 1e-12)) / F.lit(rounds)).alias("p_value"))


#: Differences up to which the signed-rank test is exact, as is the custom.
EXACT = 50


def signed_rank_p(doubled: list[int], positive: int) -> float:
    """Two-sided exact p of the signed-rank test, ties included. doubled: twice the ranks of the absolute differences, which makes
    them whole; positive: their sum over the positive differences. The number of sign patterns with each sum is built up rank by
    rank."""
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1.0
    for r in doubled:
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    whole = 2.0 ** len(doubled)
    return float(min(1.0, 2 * min(ways[: positive + 1].sum(), ways[positive:].sum()) / whole))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """Signed-rank statistic w of the positive differences, their number n without zeros, z by the normal approximation (ties
    corrected) and the two-sided p value: exact up to EXACT differences, from z beyond."""
    rows = df.where(F.col(difference) != 0).select(F.col(difference).alias("d"), F.abs(difference).alias("a"))
    ties = rows.groupBy("a").agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie"))
    ranked = midranks(rows, "a")
    sums = ranked.agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w"), F.count("*").alias("n"))
    sums = sums.join(F.broadcast(ties))  # one row each
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    told = sums.select("w", "n", ((F.col("w") - n * (n + 1) / 4) / sd).alias("z"))
    few = ranked.limit(EXACT + 1).select("d", "r").collect()
    if 0 < len(few) <= EXACT:
        exact = signed_rank_p([round(2 * r.r) for r in few], sum(round(2 * r.r) for r in few if r.d > 0))
        return told.withColumn("p_value", F.lit(exact))
    return told.withColumn("p_value", two_sided(F.col("z")))


def two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))

    return tail(z)


def hypergeometric_tail(df: DataFrame, population: str, marked: str, drawn: str, seen: str) -> DataFrame:
    """P(X >= seen), by log factorials in Arrow batches."""

    @F.pandas_udf("double")
    def tail(big: pd.Series, k: pd.Series, n: pd.Series, x: pd.Series) -> pd.Series:
        def choose(a: int, b: int) -> float:
            return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

        def one(N: int, K: int, m: int, s: int) -> float:
            return min(1.0, sum(math.exp(choose(K, i) + choose(N - K, m - i) - choose(N, m)) for i in range(max(s, m - N + K, 0), min(K, m) + 1)))

        return pd.Series([one(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(big, k, n, x, strict=True)], dtype=float)

    return df.withColumn("p_value", tail(population, marked, drawn, seen))
