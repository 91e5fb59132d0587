"""Exact order statistics of groups of any size: ranks are bracketed and counted, and only what a bracket holds is ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.sources import scratch

#: Distinct values of a group that one task may order.
LIMIT = 1_000_000
#: One over the rank error of the sketches that set brackets; brackets reach twice as far on either side.
SKETCH = 10_000
#: Cells that a bracket is cut into when it still holds too much.
CELLS = 64
#: Groups that are few: their brackets pass the driver and are broadcast.
FEW = 10_000


def settled(df: DataFrame) -> tuple[DataFrame, bool]:
    """df computed once, and whether its rows are few. Few rows are held by the driver, others by a table in the shared folder."""
    spark, held = df.sparkSession, df.persist()
    try:
        if held.count() <= FEW:
            return spark.createDataFrame(held.collect(), df.schema), True
        path = scratch.fresh_dir(spark, "selection")
        held.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), False
    finally:
        held.unpersist()


def within(data: DataFrame, brackets: DataFrame, few: bool, keys: list[str]) -> DataFrame:
    """data with the columns of its group's brackets; null groups are a group."""
    right = brackets.select(*[F.col(k).alias(f"{k}r") for k in keys], *[c for c in brackets.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys]
    right = F.broadcast(right) if few else right
    return data.join(right, on).drop(*[f"{k}r" for k in keys])


def quantiles(rows: DataFrame, value: str | Column, at: dict[str, float], groups: tuple[str, ...] = (), limit: int = LIMIT) -> DataFrame:
    """A row per group with the interpolated quantiles of `value`: a column for each name of `at`, which gives its share (0 to 1).

    The same numbers as an exact percentile, ties and all, at any size of a group. Groups of more than `limit` distinct values are
    bracketed by a sketch, the values below and inside are counted, and brackets are cut further until they hold no more than
    `limit` distinct ones; those are ordered by a window. A bracket that missed its rank is set back to the whole group, so the
    sketch's error costs time and not exactness. Passes are shared by all groups and ranks. Nulls are left out; a group without
    values has no row; without groups there is always one row.
    """
    names, shares = list(at), list(at.values())
    keys = [f"_g{i}" for i in range(max(1, len(groups)))]
    x = F.col(value) if isinstance(value, str) else value
    named = [F.col(g) for g in groups] or [F.lit(0)]
    data = rows.select(*[g.alias(k) for g, k in zip(named, keys, strict=True)], x.cast("double").alias("_x")).where("_x is not null")
    head = data.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.approx_count_distinct("_x").alias("distinct"))
    head, few = settled(head)
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)]))
    whole = head.withColumn("_w", which).select(*keys, "n", F.col("_w.i").alias("i"), "lo", "hi", "distinct", F.col("_w.p").alias("p"))
    whole = whole.withColumns({"k": F.floor(F.col("p") * (F.col("n") - 1)).cast("long"), "below": F.lit(0).cast("long"), "inside": F.col("n")})
    left, done = whole, None
    first = True
    while not (large := left.where((F.col("distinct") > limit) & (F.col("lo") < F.col("hi")))).isEmpty():
        small = left.where((F.col("distinct") <= limit) | (F.col("lo") >= F.col("hi")))
        done = small if done is None else done.unionByName(small)
        left, few_left = settled(sketched(data, large, few, keys, shares) if first else cut(data, large, few, keys))
        few, first = few and few_left, False
    open_ = left if done is None else done.unionByName(left)
    counts = within(data, open_, few, keys).where("_x between lo and hi").groupBy(*keys, "i", "_x").agg(F.count("*").alias("c"), *[F.max(c).alias(c) for c in ("n", "p", "k", "below")])
    so_far = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("_x"))
    place = F.col("k") - F.col("below")
    ranked = counts.withColumn("upto", so_far)
    found = ranked.groupBy(*keys, "i").agg(
        F.min(F.when(F.col("upto") > place, F.col("_x"))).alias("a"), F.min(F.when(F.col("upto") > F.least(place + 1, F.col("n") - 1 - F.col("below")), F.col("_x"))).alias("b"),
        F.max(F.col("p") * (F.col("n") - 1) - F.col("k")).alias("part"),
    )
    result = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, result)).alias(name) for i, name in enumerate(names)])
    if not groups:
        return wide.agg(*[F.max(name).alias(name) for name in names])
    return wide.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], *names)


BRACKET = ("n", "i", "lo", "hi", "distinct", "p", "k", "below", "inside")


def sketched(data: DataFrame, large: DataFrame, few: bool, keys: list[str], shares: list[float]) -> DataFrame:
    """Brackets of the groups in `large` from one sketch a group, with exact counts: two passes over those groups."""
    reach = 2 / SKETCH
    marks = [v for p in shares for v in (max(0.0, p - reach), min(1.0, p + reach))]
    groups = large.select(*keys).distinct()
    mine = within(data, groups, few, keys)
    sketch, few_sketch = settled(mine.groupBy(*keys).agg(F.percentile_approx("_x", F.array(*map(F.lit, marks)), F.lit(SKETCH)).alias("q")))
    ends = sketch.select(*keys, *[F.get("q", F.lit(2 * i)).alias(f"lo{i}") for i in range(len(shares))], *[F.get("q", F.lit(2 * i + 1)).alias(f"hi{i}") for i in range(len(shares))])
    held = within(data, ends, few_sketch, keys)
    inside = [F.col("_x").between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(len(shares))]
    counted = held.groupBy(*keys).agg(
        *[F.count_if(F.col("_x") < F.col(f"lo{i}")).alias(f"below{i}") for i in range(len(shares))], *[F.count_if(c).alias(f"inside{i}") for i, c in enumerate(inside)],
        *[F.approx_count_distinct(F.when(c, F.col("_x"))).alias(f"distinct{i}") for i, c in enumerate(inside)], *[F.max(c).alias(c) for c in ends.columns if c not in keys],
    )
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"{c}{i}").alias(f"{c}2") for c in ("lo", "hi", "below", "inside", "distinct")]) for i in range(len(shares))]))
    new = counted.withColumn("_p", parts).select(*[F.col(k).alias(f"{k}r") for k in keys], F.col("_p.i").alias("j"), *[F.col(f"_p.{c}2") for c in ("lo", "hi", "below", "inside", "distinct")])
    both = large.join(new, [*[F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys], F.col("i") == F.col("j")])
    right = (F.col("below2") <= F.col("k")) & (F.col("below2") + F.col("inside2") >= F.least(F.col("k") + 2, F.col("n")))
    moved = [F.when(right, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi", "below", "inside", "distinct")]
    return both.select(*keys, "n", "i", "p", "k", *moved).select(*keys, *BRACKET)


def cut(data: DataFrame, large: DataFrame, few: bool, keys: list[str]) -> DataFrame:
    """The brackets in `large` cut at CELLS quantiles of what they hold. A value at a cut is a cell of its own, so a bracket
    shrinks to a 32nd or so whatever ties there are."""
    held = within(data, large, few, keys).where("_x between lo and hi")
    marks = F.percentile_approx("_x", F.array(*[F.lit(v / CELLS) for v in range(1, CELLS)]), F.lit(SKETCH)).alias("cuts")
    cuts, few_cuts = settled(held.groupBy(*keys, "i").agg(marks))
    both = within(held, cuts.withColumnRenamed("i", "j"), few_cuts, keys).where("i = j")
    cell = 2 * F.size(F.filter("cuts", lambda c: c < F.col("_x"))) + F.array_contains("cuts", F.col("_x")).cast("int")
    cells = both.groupBy(*keys, "i", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("_x").alias("lo2"), F.max("_x").alias("hi2"), F.approx_count_distinct("_x").alias("d2"))
    order = Window.partitionBy(*keys, "i").orderBy("cell")
    before = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).withColumnRenamed("i", "j")
    known = within(cells, large, few, keys).where("i = j")
    place = F.col("k") - F.col("below")
    wanted = (F.col("before") <= F.least(place + 1, F.col("inside") - 1)) & (F.col("before") + F.col("c") > place)
    new = known.where(wanted).groupBy(*keys, "i").agg(
        *[F.max(c).alias(c) for c in ("n", "p", "k")], F.min("lo2").alias("lo"), F.max("hi2").alias("hi"), F.max(F.col("below")).alias("b0"), F.min("before").alias("b1"), F.sum("c").alias("inside"), F.sum("d2").alias("distinct"),
    )
    return new.withColumn("below", F.col("b0") + F.col("b1")).select(*keys, *BRACKET)
