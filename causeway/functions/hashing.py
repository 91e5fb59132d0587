"""Counter-based randomness: a draw is a function of its key, so it is the same on any executor and at any retry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def uniform(*parts: Column | str | int) -> Column:
    """[0, 1): the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(key(*parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts: Column | str | int) -> Column:
    """Standard normal by Box and Muller on two draws."""
    u, v = uniform(*parts, "a"), uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def normals(*parts: Column | str | int, size: int) -> Column:
    """normal(*parts, i) for i from 0 to size - 1, as one array. Within a lambda a draw is evaluated expression by expression, which
    costs some ten times the digests that it is made of; here they are taken on Arrow batches."""
    ends = [f"|{i}|{draw}".encode() for draw in "ab" for i in range(size)]

    @F.pandas_udf("array<double>")
    def run(keys: pd.Series) -> pd.Series:
        md5, out = hashlib.md5, []
        for start in keys:
            start = start.encode()
            first = b"".join([md5(start + e).digest()[:4] for e in ends])
            u, v = np.frombuffer(first, ">u4").reshape(2, size) / 4294967296.0
            out.append(np.sqrt(-2.0 * np.log(1.0 - u)) * np.cos(2 * math.pi * v))
        return pd.Series(out, dtype=object)

    return run(key(*parts))


def seed(*parts: Column | str | int) -> Column:
    """crc32 of the joined parts."""
    return F.crc32(key(*parts))
