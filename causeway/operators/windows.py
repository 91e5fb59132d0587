"""Windows over series: extraction, islands, splits, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators import statistics


def sliding(series: DataFrame, width: int, keys: tuple[str, ...] = ("unit", "var"), t: str = "t", x: str = "x") -> DataFrame:
    """All full windows by their right end (exclusive), as frames: no range join. values is ordered by t."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-(width - 1), 0)
    rows = series.select(*keys, (F.col(t) + 1).alias("t_end"), F.collect_list(x).over(w).alias("values"))
    return rows.where(F.size("values") == width)


def episode_ends(episodes: DataFrame, width: int, stride: int) -> DataFrame:
    """Right ends of the windows inside episodes (t_start, length): t_start + width, then every stride, before the end."""
    last = F.col("t_start") + F.col("length") - 1
    first = F.col("t_start") + width
    ends = F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return episodes.withColumn("t_end", F.explode(ends))


def pool_ends(safe: DataFrame, width: int, stride: int, keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """Right ends of windows that are safe throughout, every stride-th of them."""
    w = Window.partitionBy(*keys).orderBy("t")
    full = safe.withColumn("ok", F.sum(F.col("safe").cast("int")).over(w.rowsBetween(-(width - 1), 0)))
    ends = full.where(F.col("ok") == width).select(*keys, (F.col("t") + 1).alias("t_end"))
    order = Window.partitionBy(*keys).orderBy("t_end")
    return ends.withColumn("n", F.row_number().over(order)).where((F.col("n") - 1) % stride == 0).drop("n")


def even_ends(first: Column, last: Column, count: int) -> Column:
    """count + 2 evenly spaced positions without the outer two, as integers."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.floor(first + (last - first) * i / F.lit(count + 1)).cast("long"))


def islands(labels: DataFrame, flag: str, keys: tuple[str, ...] = ("unit",), t: str = "t") -> DataFrame:
    """Half-open segments [start, stop) of consecutive rows where flag holds."""
    whole = Window.partitionBy(*keys).orderBy(t)
    part = Window.partitionBy(*keys, flag).orderBy(t)
    rows = labels.withColumn("g", F.row_number().over(whole) - F.row_number().over(part)).where(F.col(flag))
    return rows.groupBy(*keys, "g").agg(F.min(t).alias("start"), (F.max(t) + 1).alias("stop")).drop("g")


def segment_ends(segments: DataFrame, width: int, stride: int, cap: int) -> DataFrame:
    """At most `cap` windows a segment, spread by a larger step where there would be more: starts of the windows."""
    n = F.greatest(F.lit(0), F.floor((F.col("stop") - F.col("start") - width) / stride) + 1).cast("int")
    rows = segments.withColumn("n_win", n).withColumn("take", F.least("n_win", F.lit(cap)))
    step = F.when(F.col("n_win") > F.col("take"), F.greatest(F.lit(1), F.floor(F.col("n_win") / F.greatest("take", F.lit(1))).cast("int"))).otherwise(F.lit(1))
    rows = rows.withColumn("step", step).where("take > 0")
    return rows.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.col("take") - 1), lambda i: F.col("start") + i * F.col("step") * stride)))


def lagged(series: DataFrame, k: int = 1, keys: tuple[str, ...] = ("unit", "var")) -> DataFrame:
    return series.withColumn(f"lag{k}", F.lag("x", k).over(Window.partitionBy(*keys).orderBy("t")))


def onset(series: DataFrame, since: Column, keys: tuple[str, ...] = ("unit",)) -> DataFrame:
    """First t at or after a time: an as-of lookup as one conditional aggregate."""
    return series.groupBy(*keys).agg(F.min(F.when(F.col("t") >= since, F.col("t"))).alias("onset"))


def evenly(rows: DataFrame, count: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """At most `count` rows a group, at floor(i * (n - 1) / (count - 1)) of its order."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(count - 1)).cast("int"))
    return numbered.where((F.col("_n") <= count) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def knee(curve: DataFrame, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """The x at which the second difference of y is least; groups of less than three points have none."""
    w = Window.partitionBy(*keys).orderBy(x)
    bend = F.lead(y).over(w) - 2 * F.col(y) + F.lag(y).over(w)
    rows = curve.withColumn("bend", bend).where("bend is not null")
    return rows.groupBy(*keys).agg(F.min_by(x, F.struct("bend", x)).alias("knee"))


def running_accuracy(rows: DataFrame, label: str, prob: str, key: str) -> DataFrame:
    """Rows by falling probability with the mean label so far and the share covered."""
    n = rows.agg(F.count("*").alias("n"))
    out = statistics.ordered(rows, prob, key, down=True, sums=(label,)).join(F.broadcast(n))  # one row
    return out.withColumn("accuracy", F.col(f"{label}_so_far") / F.col("k")).withColumn("coverage", F.col("k") / F.col("n")).drop("n", f"{label}_so_far")


def coverage_curve(rows: DataFrame, label: str, prob: str, key: str, shares: tuple[float, ...]) -> DataFrame:
    """Mean label of the k = max(1, round(c * n)) most probable rows for each share c."""
    ranked = running_accuracy(rows, label, prob, key)
    n = rows.agg(F.count("*").alias("n"))
    wanted = n.select("n", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    wanted = wanted.withColumn("k", F.greatest(F.lit(1), F.bround(F.col("share") * F.col("n")).cast("int"))).drop("n")
    return ranked.join(F.broadcast(wanted), "k").select("share", "k", "accuracy")


def temporal_split(rows: DataFrame, share: float, gap: int, keys: tuple[str, ...], order: str) -> DataFrame:
    """train: the first `share` of each series; purged: the next `gap` rows; test: the rest."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    cut = F.floor(n * share)
    return rows.withColumn("part", F.when(i <= cut, "train").when(i <= cut + gap, "purged").otherwise("test"))


def tumbling(labels: DataFrame, width: int, least: float, marked: int) -> DataFrame:
    """Windows of `width` steps of (unit, t, var, mark): kept if the share of steps with a mark is `least` at least and some
    variable has `marked` marks; those variables are the roots."""
    rows = labels.withColumn("w", F.floor(F.col("t") / width).cast("long"))
    by_var = rows.groupBy("unit", "w", "var").agg(F.sum("mark").alias("m"))
    steps = rows.groupBy("unit", "w", "t").agg(F.max("mark").alias("any")).groupBy("unit", "w").agg(F.sum("any").alias("a"), F.count("*").alias("n"))
    roots = by_var.where(F.col("m") >= marked).groupBy("unit", "w").agg(F.array_sort(F.collect_list("var")).alias("roots"))
    return steps.where((F.col("n") == width) & (F.col("a") / width >= least)).join(roots, ["unit", "w"]).select("unit", "w", "roots")


#: Rows of one bucket of an interval join that one task takes; a bucket with more is split.
BUCKET_ROWS = 65_536


def interval_join(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...], t: str = "t", start: str = "start", stop: str = "stop", width: int = 16, rows: int = BUCKET_ROWS) -> DataFrame:
    """Every point with every interval of its keys that it lies in (start <= t < stop), however intervals overlap.

    An interval goes to the buckets of its own level: the least width times a power of two that is as long as it, so it meets two
    buckets at most. A point goes to its bucket of each level that there is. Both meet in an equi-join on (keys, level, bucket).
    Buckets of more than `rows` points are split by a hash of the point, and the intervals of such a bucket are copied to its parts,
    so neither a crowded time nor a long interval is one task's. Null keys, times and ends, and empty intervals join nothing.
    """
    length = F.col(stop) - F.col(start)
    level = F.when(length <= width, 0).otherwise(F.ceil(F.log2(length / F.lit(float(width))) - 1e-9)).cast("int")
    held = intervals.where(length > 0).withColumn("_level", level)
    # a level may come out one too low by rounding: the interval then meets three buckets, which is as right
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_level")).cast("long")
    held = held.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(stop) - 1) / size))))
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())  # at most one for each doubling of time
    if not levels:
        levels = [0]
    every = F.explode(F.array(*[F.struct(F.lit(v).alias("l"), F.floor(F.col(t) / F.lit(width * 2**v)).alias("b")) for v in levels]))
    dealt = points.where(F.col(t).isNotNull()).withColumn("_at", every).withColumns({"_level": F.col("_at.l"), "_bucket": F.col("_at.b")}).drop("_at")
    place = [*keys, "_level", "_bucket"]
    crowded = dealt.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("_parts")).where("_parts > 1")
    # Only crowded buckets have a row here: at most one for so many points.
    dealt = dealt.join(crowded, place, "left").withColumn("_part", F.pmod(F.xxhash64(t, *points.columns), F.coalesce("_parts", F.lit(1)).cast("long"))).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))
    held = held.join(crowded, place, "left").withColumn("_part", copies).drop("_parts")
    met = dealt.join(held, [*place, "_part"]).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(stop)))
    return met.drop("_level", "_bucket", "_part")
