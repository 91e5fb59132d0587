"""Product codes of integer vectors, with nearest entries found by segment-mean lower bounds.

Vectors are cut into parts; each part has a codebook that is learnt over all vectors by rounds of assignment and floored means.
An entry's distance to a part is bounded from below by block means and residual norms, coarse blocks first: what a bound rules
out is never compared, and what is left gets its exact integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, join_counted, slices, small_batches

#: Production parameters: parts of a vector, entries of a codebook, rounds, and what a component is multiplied by.
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components from here on (after scaling) take no part: what they cost can't be a long.
WIDE = float(1 << 62)
#: A float bound may be off by rounding; an entry is ruled out only if its bound is this much above the best known distance.
SLACK = 1e-9
LONG = (1 << 63) - 1

SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.string())])


def block_starts(width: int) -> list[np.ndarray]:
    """Where blocks start, coarse to fine: the whole part, its halves, their halves, while a block has two components at least."""
    out, size = [np.array([0])], width
    while size >= 4:
        size = -(-size // 2)
        out.append(np.arange(0, width, size))
    return out


class Blocks:
    """Sums and residual norms of the blocks of integer rows, at each level."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]):
        self.sums, self.rests = [], []
        square = x * x
        for starts in levels:
            size = np.diff(np.append(starts, x.shape[1]))
            total = np.add.reduceat(x, starts, axis=1)
            # size * sum of squares - square of the sum, in whole numbers, so nothing cancels
            apart = size * np.add.reduceat(square, starts, axis=1) - total * total
            self.sums.append(total)
            self.rests.append(np.sqrt(apart / size))


class Codebook:
    """The entries of one part, (k, width) integers. `nearest` gives each row's nearest entry, ties to the lower index."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        self.width = len(entries[0])
        #: With components below this all integers of the bounds and distances stay below 2 ** 63.
        self.safe = (1 << 30) // self.width
        self.plain = all(abs(v) < self.safe for e in entries for v in e)
        self.compared = self.pairs = 0
        if self.plain:
            self.levels = block_starts(self.width)
            self.sizes = [np.diff(np.append(s, self.width)).astype(np.float64) for s in self.levels]
            self.rows = np.array(entries, np.int64)
            self.blocks = Blocks(self.rows, self.levels)

    def bound(self, level: int, sums: np.ndarray, rests: np.ndarray, entry_sums: np.ndarray, entry_rests: np.ndarray) -> np.ndarray:
        """Of rows and entries given by their blocks: a block adds its size times the squared difference of means, and the squared
        difference of the residual norms, which is the least that the residuals can be apart."""
        means = (sums - entry_sums).astype(np.float64)
        # The norms are rounded: their difference is drawn to 0 by more than that.
        apart = np.abs(rests - entry_rests) - 1e-12 * (rests + entry_rests)
        return (means * means / self.sizes[level] + np.maximum(apart, 0) ** 2).sum(-1) * (1 - SLACK)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.plain or (np.abs(x) >= self.safe).any():
            return self.plainly(x)
        blocks = Blocks(x, self.levels)
        low = self.bound(0, blocks.sums[0][:, None], blocks.rests[0][:, None], self.blocks.sums[0][None], self.blocks.rests[0][None])
        guess = x - self.rows[low.argmin(1)]
        known = (guess * guess).sum(1)
        row, entry = np.nonzero(low <= known[:, None])
        for k in range(1, len(self.levels)):
            low = self.bound(k, blocks.sums[k][row], blocks.rests[k][row], self.blocks.sums[k][entry], self.blocks.rests[k][entry])
            left = low <= known[row]
            row, entry = row[left], entry[left]
        self.pairs += len(x) * len(self.rows)
        self.compared += len(row)
        apart = x[row] - self.rows[entry]
        distance = (apart * apart).sum(1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(distance, starts)
        best = np.flatnonzero(distance == least[row])[::-1]
        out = np.empty(len(x), np.int64)
        out[row[best]] = entry[best]  # of equal distances the first entry is written last
        return out, least

    def plainly(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All distances as Python integers, for components whose squares a machine word can't hold."""
        out, least = [], []
        for v in x.tolist():
            all_ = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in self.entries]
            least.append(min(all_))
            out.append(all_.index(least[-1]))
        return np.array(out, np.int64), np.array(least, object)


def books_of(entries: list[list[list[int]]]) -> list[Codebook]:
    return [Codebook(part) for part in entries]


def whole_components(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(values * SCALE).astype(np.int64)


def codable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is not null and holds only finite components, as doubles."""
    v = F.col("v")
    label = F.col(f"`{label_column}`").alias("label")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), label, F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def learn(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> list[list[list[int]]]:
    """The codebooks, as lists of Python integers: parts x entries x components. What the driver gets is of their size."""
    first = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").toArrow().column(0).combine_chunks()
    width = dim // parts
    start = whole_components(first, dim).reshape(-1, parts, width).swapaxes(0, 1).tolist()
    books: list[list[list[int]]] = start
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            mine = books_of(held.value)
            counts = np.zeros((parts, len(mine[0].entries)), np.int64)
            totals = np.zeros((parts, len(mine[0].entries), width), np.int64)
            huge: dict[tuple[int, int, int], int] = {}
            for batch in slices(batches, 1000):
                x = whole_components(batch.column(0), dim).reshape(-1, parts, width)
                for p, book in enumerate(mine):
                    own = np.ascontiguousarray(x[:, p])
                    at = book.nearest(own)[0]
                    counts[p] += np.bincount(at, minlength=counts.shape[1])
                    if (np.abs(own) >= book.safe).any():
                        for entry, v in zip(at.tolist(), own.tolist(), strict=True):
                            for k, c in enumerate(v):
                                huge[p, entry, k] = huge.get((p, entry, k), 0) + c
                        continue
                    order = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                    totals[p, at[order][starts]] += np.add.reduceat(own[order], starts, axis=0)
            for p in range(parts):
                used = np.flatnonzero(counts[p])
                if len(used):
                    entry, place = np.repeat(used, width), np.tile(np.arange(width), len(used))
                    said = [str(t + huge.get((p, e, k), 0)) for t, e, k in zip(totals[p, entry, place].tolist(), entry.tolist(), place.tolist(), strict=True)]
                    columns = [np.full(len(entry), p, np.int32), entry.astype(np.int32), place.astype(np.int32), counts[p, entry], said]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=SUMS)

        added = rows.select("v").mapInArrow(sums, "part int, entry int, place int, n long, total string")
        added = added.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = [[list(e) for e in part] for part in books]
        for r in added.collect():
            books[r.part][r.entry][r.place] = int(r.total) // r.n
        held.destroy()
    return books


def usual_length(rows: DataFrame, parts: int) -> int | None:
    """The length, a multiple of the parts, that most vectors have; the lesser of two that are as frequent."""
    found = rows.groupBy(F.size("v").alias("dim")).count().where(f"dim > 0 and dim % {parts} = 0").orderBy(F.desc("count"), "dim").first()
    return found and found.dim


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error) of every vector, and the codebooks (parts x entries x components).

    A component x is floor(256 * x). Codebooks start as the parts of the vectors with the least ids (null ids can't be among
    them; of rows with one id the lesser vector comes first, and repeated rows count as often as they come) and are moved
    `rounds` times to the floored means of what is nearest to them. code: two hex digits a part; error: the squared distances
    of the parts to their entries, summed.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors of another length than most (of the
    lengths that can be cut into equal parts), and those with a component of 2 ** 62 or more after scaling, have no code and no
    error (null), and no say in the codebooks; an error of 2 ** 63 or more is null. With fewer vectors than entries a codebook is
    as small as that. Ids may be null or repeated. An empty table gives no rows and no codebooks. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = codable(vectors, id_column, vector_column, label_column)
    dim = usual_length(rows, parts)
    none = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if dim is None:
        return none, []
    fits = (F.size("v") == dim) & ~F.exists("v", lambda x: F.abs(x) * SCALE >= WIDE)
    taken = rows.where(fits)
    if taken.where("vec_id is not null").isEmpty():
        return none, []
    books = learn(taken, dim, parts, entries, rounds)
    held = spark.sparkContext.broadcast(books)
    width = dim // parts

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = books_of(held.value)
        hexed = np.array([f"{k:02x}" for k in range(max(entries, 1))])
        for batch in slices(batches, 1000):
            has = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            codes: list[str | None] = [None] * batch.num_rows
            errors: list[int | None] = [None] * batch.num_rows
            if has.any():
                x = whole_components(batch.column(2).drop_null(), dim).reshape(-1, parts, width)
                at, apart = zip(*(book.nearest(np.ascontiguousarray(x[:, p])) for p, book in enumerate(mine)), strict=True)
                said = hexed[np.stack(at, 1)].tolist()
                cost = [sum(c) for c in zip(*(a.tolist() for a in apart), strict=True)]
                for i, code, c in zip(np.flatnonzero(has).tolist(), said, cost, strict=True):
                    codes[i], errors[i] = "".join(code), c if c <= LONG else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    kind = dict(rows.dtypes)["label"]
    shown = rows.select("vec_id", "label", F.when(fits, F.col("v")).alias("v"))
    return shown.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"), books


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all entries' components, in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()


def query(vectors: DataFrame) -> DataFrame:
    """A row per kept vector; label_error is the error summed over the rows of its label (null labels are one)."""
    tables = Tables(vectors.sparkSession, "vectorcodes")
    coded, books = compress(vectors)
    coded = tables.write(coded.withColumns({"label key": F.coalesce(F.col("label").cast("string"), F.lit("")), "no label": F.col("label").isNull()}), "coded")
    key = ["label key", "no label"]
    sums = coded.groupBy(*key).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_counted(coded, tables.write(sums, "labels"), key)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")


def oracle() -> str:
    """The same in SQL for vectors of one length with whole ids: a row per component and entry, so for small tables."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""
d{k} as (select vec_id, p, e, sum((x - c) * (x - c)) as d from comps join book{k} using (p, i) group by all),
near{k} as (select vec_id, p, arg_min(e, d * {ENTRIES} + e) as e, min(d) as d from d{k} group by all)""")
        if k < ROUNDS:
            rounds.append(f"""
moved{k} as (select p, e, i, sum(x) as s, count(*) as n from near{k} join comps using (vec_id, p) group by all),
book{k + 1} as (
  select p, e, i, cast(coalesce((s - (((s % n) + n) % n)) // n, c) as bigint) as c from book{k} left join moved{k} using (p, e, i)
)""")
    return f"""
with kept as (
  select vec_id, label, len(embedding) // {PARTS} as w, embedding as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
flat as (select vec_id, w, unnest(v) as x, generate_subscripts(v, 1) - 1 as j from kept),
comps as (select vec_id, j // w as p, j % w as i, cast(floor({SCALE} * cast(x as double)) as bigint) as x from flat),
least as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < {ENTRIES}),
book0 as (select p, e, i, x as c from comps join least using (vec_id)),{",".join(rounds)},
coded as (
  select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near{ROUNDS} group by vec_id
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(c as varchar), ',' order by p, e, i)) from book{ROUNDS}) as codebooks_sha256, label
from coded join kept using (vec_id)
"""
