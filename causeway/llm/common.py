"""What the corpus operators share: table access, the shared work folder, Arrow batching and connected classes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator here: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Rows from which a key is a hot one, if it also has this share of all rows.
HOT_ROWS, HOT_KEYS = 512, 4096
#: Places of the bitmap that keeps rows out of a shuffle.
BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch: with 10,000 texts in each, buffers of the executors and of Python workers add up to more
    than what a task makes of them. The session's setting is only ever lowered, and no result depends on it."""
    now = int(spark.conf.get(ARROW_ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def trim() -> None:
    """Give back what Arrow and the C library hold and don't use: a Python worker lives on through all stages of a job, and what
    one of them needed at its peak would stay with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into fewer rows, without a copy. Spark bounds a batch by bytes; this bounds what is made of it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. One is set here only in local mode, where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        named = "file:///tmp/causeway-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Tables:
    """The tables of one run of an operator, in a folder of their own under the shared one.

    A table cuts the lineage and outlives any executor. `keep` removes all but those that the result still reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, fresh_dir(spark, label)
        self.names: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        name = f"{name}-{len(self.names)}"
        self.names.append(name)
        before = self.spark.conf.get(ARROW_ROWS)
        small_batches(self.spark)
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(ARROW_ROWS, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep(self, *kept: str) -> None:
        """Remove the tables whose names are not given (a name stands for all tables that were written under it)."""
        left = []
        for name in self.names:
            if name.rsplit("-", 1)[0] in kept:
                left.append(name)
            else:
                remove(self.spark, f"{self.root}/{name}")
        self.names = left


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(large: DataFrame, small: DataFrame, key: list[str], how: str = "inner", count: str = "n") -> DataFrame:
    """large joined with small, which has a row per key and in `count` the number of rows that large has of it, or more.

    Keys of many rows go by broadcast: by their counts at most HOT_KEYS of them reach a HOT_KEYS-th of all rows. The others
    are shuffled, and none has more than that share. So no task gets all rows of one key. how: inner or left.
    """
    total, most = small.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    floor = max(HOT_ROWS, -(-total // HOT_KEYS))
    if most < floor:  # no key is hot: nothing to broadcast, and half the plan
        return large.join(small, key, how)
    hot = small.where(F.col(count) >= floor)
    near = large.join(F.broadcast(hot), key)
    rest = large.join(F.broadcast(hot.select(*key)), key, "left_anti").join(small.where(F.col(count) < floor), key, how)
    return near.unionByName(rest)


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose long `key` may be among `keys` (one column of longs), and those whose key surely isn't.

    A bitmap of BITS hashed places is broadcast as words of 64: BITS / 64 rows of two longs, however many keys there are. With
    more keys than places most rows pass for maybe, and what follows does its exact work on more of them.
    """
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    taken = keys.select(F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(BITS)).alias("place"))
    words = taken.groupBy(F.shiftright("place", 6).alias("bitmap word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bitmap bits"))
    tested = rows.withColumn("bitmap word", F.shiftright(place, 6)).join(F.broadcast(words), "bitmap word", "left")
    bit = F.getbit(F.coalesce("bitmap bits", F.lit(0).cast("long")), (place % 64).cast("int")) == 1
    names = [F.col(f"`{c}`") for c in rows.columns]
    return tested.where(bit).select(*names), tested.where(~bit).select(*names)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Python strings of a column, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def to_batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from a stream sorted by keys. A table may hold several groups; no group is split.

    Memory is one batch and the group that is open at its end, so a caller bounds its groups.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cut = last_start(t, keys)
        if held and same_key(held[-1], t, keys):
            if cut == 0:
                held.append(t)
                continue
        if cut > 0 or held:
            done = [*held, t.slice(0, cut)] if held or cut else []
            done = [x for x in done if x.num_rows]
            if done:
                yield pa.concat_tables(done).combine_chunks()
        held = [t.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()
    held.clear()
    trim()


def last_start(t: pa.Table, keys: list[str]) -> int:
    return int(starts(t, keys)[-1])


def starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins, in a table sorted by keys without nulls in them."""
    n = t.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def same_key(a: pa.Table, b: pa.Table, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def classes(edges: DataFrame, tables: Tables, label: str) -> DataFrame:
    """Connected classes of undirected edges (a, b) of any one orderable type: rows (id, class), class the least id in it.

    A round hooks every node to its least lesser neighbour, jumps to the roots of the forest that this gives, and contracts
    the edges to those roots; rounds go on until no edge is left, and each hooks at least the greatest node of every class that
    is left. All of it is joins and pre-aggregated groups; what a round leaves is a table in the shared folder, so the plan
    stays short and a lost executor costs one round. A root or hub with many rows is counted first and goes by broadcast. No
    list of neighbours is ever gathered. Ids without an edge get no row. Self loops and repeated edges are harmless.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = tables.write(links, f"{label}-links")
    found = None
    while links.take(1):
        tree = tables.write(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("class")), f"{label}-tree")
        moving = True
        while moving:
            fans = tree.groupBy("class").agg(F.count("*").alias("n"))
            up = tree.select(F.col("id").alias("class"), F.col("class").alias("up")).join(fans, "class")
            step = join_counted(tree, up, ["class"], "left").select("id", F.coalesce("up", "class").alias("class"), F.col("up").isNotNull().alias("moved"))
            step = tables.write(step, f"{label}-jump")
            moving = bool(step.where("moved").take(1))
            tree = step.select("id", "class")
        ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        roots = tables.write(tree.join(ends, "id"), f"{label}-roots")
        left = join_counted(links, roots.select(F.col("id").alias("a"), F.col("class").alias("ra"), "n"), ["a"]).drop("n")
        left = join_counted(left, roots.select(F.col("id").alias("b"), F.col("class").alias("rb"), "n"), ["b"], "left")
        left = left.select("ra", F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
        links = tables.write(left.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), f"{label}-links")
        if found is None:
            found = tree
        else:
            moved = tree.select(F.col("id").alias("class"), F.col("class").alias("to"))
            found = found.join(moved, "class", "left").select("id", F.coalesce("to", "class").alias("class")).unionByName(tree)
    if found is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("class"))
    found = tables.write(found.distinct(), f"{label}-found")
    return found.unionByName(found.select(F.col("class").alias("id"), "class").distinct())


def block_pairs(members: DataFrame, group: str, member: str, count: str, size: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """members with columns i <= j: each row once for every pair of blocks of its group that it has a part in, and own, its block.

    A group of up to `size` rows, and of up to `most` in its column `weight`, is one block, paired with itself. In a larger one
    every pair of blocks meets in a row group of its own, so no task holds more than two blocks; block i = j is the pair of a
    block with itself.
    """
    blocks = F.greatest(F.ceil(F.col(count) / F.lit(size)).cast("int"), F.lit(1))
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.col(weight) / F.lit(most)).cast("int"))
    own = F.pmod(F.xxhash64(member), blocks.cast("long")).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
