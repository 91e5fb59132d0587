"""Column expressions over score arrays: one array per window, position = variable."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def topk(phi: Column, k: int) -> Column:
    """Indexes of the k largest entries; ties go to the lower index."""
    keyed = F.transform(phi, lambda v, i: F.struct((-v).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["i"])


def ranking(phi: Column) -> Column:
    keyed = F.transform(phi, lambda v, i: F.struct((-v).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def midranks(phi: Column) -> Column:
    """Ranks of the entries from 1, the least first; ties get the mean of theirs."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for a in s:
            _, at, n = np.unique(a, return_inverse=True, return_counts=True)
            out.append((np.cumsum(n) - (n - 1) / 2)[at])
        return pd.Series(out, dtype=object)

    return run(phi)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row: within a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(phi: Column) -> Column:
    """Shares (abs + 1e-12) / sum."""
    p = F.transform(phi, lambda v: F.abs(v) + F.lit(1e-12))
    return let(total(p), lambda t: F.transform(p, lambda v: v / t))


def overlap(a: Column, b: Column, k: int) -> Column:
    return F.size(F.array_intersect(topk(a, k), topk(b, k))) / F.lit(k)


def hit(phi: Column, roots: Column, k: int) -> Column:
    return F.arrays_overlap(topk(phi, k), roots).cast("int")


def entropy(p: Column) -> Column:
    """Natural entropy over the positive entries of shares."""
    return -total(F.transform(F.filter(p, lambda v: v > 0), lambda v: v * F.log(v)))


def rolled(a: Column, shift: Column) -> Column:
    """Circular shift to the right."""
    n = F.size(a)
    k = F.pmod(shift, n)
    return F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k))


def rbo(a: Column, b: Column, p: float = 0.9) -> Column:
    """Truncated rank-biased overlap of two rankings, divided by its largest value."""
    steps = F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b)))
    part = F.transform(
        steps, lambda d: F.pow(F.lit(p), d - 1) * F.size(F.array_intersect(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d))) / d
    )
    return total(part) / total(F.transform(steps, lambda d: F.pow(F.lit(p), d - 1)))


def trimmed_mean(a: Column) -> Column:
    """Mean without the max(1, n // 10) least and largest values; null where that leaves none."""
    n = F.size(a)
    cut = F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
    left = n - 2 * cut
    return F.when(left > 0, mean(F.slice(F.array_sort(a), cut + 1, F.greatest(left, F.lit(0)))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
