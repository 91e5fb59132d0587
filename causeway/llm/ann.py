"""Approximate nearest neighbours by additive quantisation.

Full-dimensional codebooks are learnt on residuals; a beam search picks one word of each, the norm of what they add up to is
stored, and how far the vector is from that sum. A task takes a block of queries through the index's files and scores codes by
table lookups. A code whose score, plus the most that its distance to its vector can add, is below the k-th best so far is passed
over; the vectors of the others are ranked exactly at once. So no vector that belongs in the answer is lost, whatever the rows
are like; codes that fit badly cost exact products and not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, join_counted, parted

#: Production parameters: vectors the codebooks are learnt on, codebooks, words in each, width of the beam.
SAMPLE = 16_384
BOOKS = 32
WORDS = 256
BEAM = 4
#: Pairs whose exact scores are added up at once; from this share of a chunk's pairs on a product of matrices rules some out first.
PAIRS = 1 << 16
DENSE = 1 / 16
#: Queries in a block at most, and codes that are scored at once.
QUERY_BLOCK = 1024
CHUNK = 2048
#: Parts of the index that a block of queries goes through in tasks of their own: one for so many codes, and so many at most.
#: With the bound, what the tasks hand on is a fixed number of shortlists of each query however large the index is.
PART_CODES = 1 << 22
PARTS = 64


def learn(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dim), each by k-means on what the ones before leave over."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32)
    out = np.zeros((books, words, sample.shape[1]), np.float32)
    for b in range(books):
        k = min(words, len(rest))
        centres = rest[rng.permutation(len(rest))[:k]].copy()
        for _ in range(rounds):
            near = nearest(rest, centres)
            counts = np.bincount(near, minlength=k)
            full = counts > 0
            sums = np.add.reduceat(rest[np.argsort(near, kind="stable")], np.cumsum(counts[full]) - counts[full])
            centres[full] = sums / counts[full, None]
        out[b, :k] = centres
        rest = rest - centres[nearest(rest, centres)]
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def apart(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Distances of vectors to the sums of their codes' words, in double precision and rounded up to floats. What can't be told
    (components that floats can't hold) is infinite."""
    rest = x.astype(np.float64)
    with np.errstate(all="ignore"):
        for b, book in enumerate(books):
            rest -= book[codes[:, b]]
        far = np.sqrt((rest**2).sum(1))
        far = (far * (1 + 1e-6) + 1e-36).astype(np.float32)
    return np.where(np.isfinite(far), far, np.inf).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and the norms of the sums they stand for, by beam search over the codebooks in turn."""
    x = x.astype(np.float32)
    n, dim = x.shape
    codes = np.zeros((n, 1, len(books)), np.uint8)
    rest = x[:, None, :]
    rows = np.arange(n)[:, None]
    for b, book in enumerate(books):
        width = rest.shape[1]
        cost = (rest.reshape(-1, dim) @ (-2 * book.T)).reshape(n, width, len(book))
        cost += (book**2).sum(1)
        cost += (rest**2).sum(2)[:, :, None]
        flat = cost.reshape(n, -1)
        if b == len(books) - 1:
            best = flat.argmin(1)[:, None]
        else:
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        at, word = best // len(book), best % len(book)
        codes = codes[rows, at]
        codes[:, :, b] = word
        rest = rest[rows, at] - book[word]
    return codes[:, 0], np.linalg.norm(x - rest[:, 0], axis=1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) without the rows that take no part: null, empty, zero, or with a null or non-finite component. A vector of
    floats stays one; any other is of doubles."""
    v = F.col("v")
    kind = "array<float>" if dict(vectors.dtypes)[vector_column] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast(kind).alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull())


def usual_length(rows: DataFrame) -> int | None:
    """The length that most vectors have, the lesser of two that are as frequent."""
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    return lengths and lengths.dim


def codebooks(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Learnt on the rows with the least hashes of their ids: a bounded sample, the same at every run."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column(0)
    x = got.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)
    held = (np.abs(x) < 1e15).all(1)  # squares of others may be more than a float holds
    return learn(x[held]) if held.any() else np.zeros((1, 1, x.shape[1]), np.float32)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def one_vector_each(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows (vec_id, v) with one row for each id: that of the least vector, component by component.

    Ids are counted first, and only rows whose id comes more than once are brought together, by an aggregate that keeps one
    vector of an id in every task; so neither unique ids nor millions of copies of one row travel.
    """
    again = tables.write(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return rows
    maybe, once = parted(rows, F.col("vec_id"), again)
    return once.unionByName(maybe.groupBy("vec_id").agg(F.min("v").alias("v")))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec_id, ids, v): equal vectors are one row, named by their least id. rows has one row for each id.

    Of their ids the `keep` least stay, in order: a search for less than `keep` neighbours, with ties to the lesser id, can
    return no other, so this is exact however many copies there are. The limit is applied before the shuffle, so copies don't
    gather in one task.
    """
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= keep)
    grouped = least.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return grouped.select(F.get("ids", F.lit(0)).alias("vec_id"), "ids", "v")


def index(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, ids, v) with code, norm (of the code's sum) and rest (the vector's distance to it)."""
    held = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = rows_of(part.column(2))
                codes, norms = encode(x, held.value)
                told = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array(apart(x, codes, held.value))]
                yield pa.RecordBatch.from_arrays([*part.columns, *told], names=["vec_id", "ids", "v", "code", "norm", "rest"])

    kind = dict(vectors.dtypes)["v"]
    return vectors.select("vec_id", "ids", "v").mapInArrow(run, f"vec_id long, ids array<long>, v {kind}, code binary, norm float, rest float")


class Shortlists:
    """The best codes so far of each query of a block. measure: inner (products) or l2 (distances, negated)."""

    def __init__(self, queries: np.ndarray, books: np.ndarray, size: int, measure: str):
        self.size, self.measure = size, measure
        # A table entry per codebook, word and query: a code's score is the sum of its words' rows.
        self.tables = np.ascontiguousarray(books @ queries.astype(np.float32).T)
        self.longest = float(np.linalg.norm(queries, axis=1).max())
        self.about = np.zeros((len(queries), 0), np.float32)
        self.ids = np.zeros((len(queries), 0), np.int64)

    def scores(self, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        out = self.tables[0][codes[:, 0]]
        for b in range(1, codes.shape[1]):
            out += self.tables[b][codes[:, b]]
        if self.measure == "l2":
            out = 2 * out - (norms**2)[:, None]  # the query's own norm is the same for all codes
        return out.T

    def add(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        """Score codes; of inner products none can be more than the product of the norms, so a chunk of short vectors may be
        passed over whole."""
        if self.measure == "inner" and self.about.shape[1] >= self.size and self.longest * norms.max() < self.about.min():
            return
        about = np.concatenate([self.about, self.scores(codes, norms)], axis=1)
        every = np.concatenate([self.ids, np.broadcast_to(ids, (len(about), len(ids)))], axis=1)
        if about.shape[1] > self.size:
            best = np.argpartition(-about, self.size - 1, axis=1)[:, : self.size]
            about, every = np.take_along_axis(about, best, 1), np.take_along_axis(every, best, 1)
        self.about, self.ids = about, every


class Nearest(Shortlists):
    """The `size` nearest vectors so far of each query of a block, by the measure itself and then the lesser id."""

    def __init__(self, queries: np.ndarray, books: np.ndarray, size: int, measure: str):
        with np.errstate(all="ignore"):
            super().__init__(queries, books, size, measure)
            self.queries = queries.astype(np.float64)
            self.lengths = np.linalg.norm(self.queries, axis=1)
            # The most that floats can be off in a score: each word's product, and the sum of them.
            words = float(np.linalg.norm(books.astype(np.float64), axis=2).max(1).sum())
            self.off = (books.shape[2] + len(books) + 8) * 2.0**-23 * self.lengths * words + 1e-36
            if measure == "l2":
                self.off = 2 * self.off + 2.0**-20 * (words + self.lengths) ** 2
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(len(queries), -np.inf)

    def within(self, about: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the scores of a chunk's vectors are at least and at most, by the scores of their codes."""
        rests = rests.astype(np.float64)[None]
        if self.measure == "inner":
            margin = self.lengths[:, None] * rests + self.off[:, None]
            return about - margin, about + margin
        square = (self.lengths**2)[:, None] - about
        near = np.sqrt(np.maximum(square - self.off[:, None], 0)) - rests
        return -((np.sqrt(np.maximum(square + self.off[:, None], 0)) + rests) ** 2), -(np.maximum(near, 0) ** 2)

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same bounds by a product of matrices, which is off by the order of its sums alone."""
        lengths = np.linalg.norm(x, axis=1)[None]
        about, off = self.queries @ x.T, x.shape[1] * 2.0**-50 * self.lengths[:, None] * lengths
        if self.measure == "l2":
            about = 2 * about - (self.lengths**2)[:, None] - lengths**2
            off = x.shape[1] * 2.0**-49 * (self.lengths[:, None] + lengths) ** 2
        return about - off, about + off

    def may_enter(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Mask of the pairs that aren't surely below the size-th best, of those so far or of this chunk."""
        floor = self.worst
        if low.shape[1] >= self.size and np.isneginf(floor).any():
            kth = np.partition(np.where(np.isnan(low), -np.inf, low), low.shape[1] - self.size, axis=1)[:, low.shape[1] - self.size]
            floor = np.fmax(floor, kth)
        return ~(high < floor[:, None])

    def check(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, rests: np.ndarray, x: np.ndarray) -> None:
        """Take a chunk of the index: ids, codes with norms and rests, and the vectors themselves."""
        with np.errstate(all="ignore"):
            if self.measure == "inner" and self.longest * (1 + 1e-6) * (float(norms.max()) * (1 + 1e-6) + float(rests.max())) < self.worst.min():
                return
            keep = self.may_enter(*self.within(self.scores(codes, norms), rests))
            x = x.astype(np.float64)
            if keep.mean() > DENSE:
                keep &= self.may_enter(*self.products(x))
            row, at = np.nonzero(keep)
            for low in range(0, len(row), PAIRS):
                r, c = row[low : low + PAIRS], at[low : low + PAIRS]
                q, v = self.queries[r], x[c]
                s = np.zeros(len(r))
                for term in np.ascontiguousarray((q * v if self.measure == "inner" else (q - v) * (v - q)).T):
                    s += term  # in the order of `exactly`, so that ties are the same
                self.enter(r, ids[c], s)

    def enter(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = ~(score < self.worst[row])
        row, ids, score = (np.concatenate(p) for p in ((self.row, row[good]), (self.id, ids[good]), (self.score, score[good])))
        order = np.lexsort((ids, -score, ~np.isnan(score), row))  # Spark holds nan to be the most
        row, ids, score = row[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        left = place < self.size
        self.row, self.id, self.score = row[left], ids[left], score[left]
        last = place[left] == self.size - 1
        self.worst[self.row[last]] = self.score[last]


def exactly(q: Column, v: Column, measure: str) -> Column:
    """The measure of two vectors in double precision."""
    term = (lambda x, y: x.cast("double") * y.cast("double")) if measure == "inner" else (lambda x, y: (x.cast("double") - y.cast("double")) * (y.cast("double") - x.cast("double")))
    return F.aggregate(F.zip_with(q, v, term), F.lit(0.0), lambda s, x: s + x)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    sample: int = SAMPLE,
    measure: str = "inner",
) -> DataFrame:
    """The k rows of vectors nearest to each row of queries by inner product: query_id, rank from 1, vec_id, score.

    measure: inner, or l2 for the least squared distance, whose score is negated. Scores are those of the original vectors in
    double precision; ties go to the lesser id; a query's own id is left out. Rows that are null, empty, zero or hold a null or
    non-finite component, rows with a null id, and rows of another length than most of `vectors` have take no part on either
    side. An id has one vector on a side: of several rows of one id that of the least vector, component by component, counts and
    the others don't. An empty side gives no rows. Other columns are ignored. The answer is that of brute force: codes
    only rule out what can't be in it. What is shuffled is each vector, twice, and k + 1 neighbours of each query and part: in
    proportion to vectors and queries.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    dim = usual_length(rows)
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dim)
    tables = Tables(spark, "nearest")
    rows = one_vector_each(rows, tables)
    books = codebooks(rows, sample)
    held = tables.write(index(distinct_vectors(rows, k + 1), books), "vectors")
    files = sorted(held.inputFiles())
    n_codes = held.count()
    asked = tables.write(one_vector_each(usable(queries, id_column, vector_column).where(F.size("v") == dim), tables), "queries")
    n_asked = asked.count()
    # Blocks small enough to keep all cores at work, and bounded.
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n_asked // min(QUERY_BLOCK, max(32, -(-n_asked // (2 * cores))))))
    parts = max(1, min(PARTS, len(files), -(-n_codes // PART_CODES)))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    place = (F.col("block") * F.lit(parts) + F.col("part")).cast("int")
    dealt = dealt.repartitionById(blocks * parts, place).select("part", "vec_id", "v")
    learnt, listed = spark.sparkContext.broadcast(books), spark.sparkContext.broadcast(files)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [b for b in batches if b.num_rows]
        if not mine:
            return
        ids = np.concatenate([b.column(1).to_numpy() for b in mine])
        asked_here = np.concatenate([rows_of(b.column(2)) for b in mine])
        part = mine[0].column(0)[0].as_py()
        for low in range(0, len(ids), QUERY_BLOCK):
            # One more than k, as the query's own vector may be among them.
            best = Nearest(asked_here[low : low + QUERY_BLOCK], learnt.value, k + 1, measure)
            for name in listed.value[part::parts]:
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(CHUNK, columns=["vec_id", "v", "code", "norm", "rest"]):
                        words = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        best.check(batch["vec_id"].to_numpy(), words, batch["norm"].to_numpy(), batch["rest"].to_numpy(), rows_of(batch["v"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + QUERY_BLOCK][best.row]), pa.array(best.id), pa.array(best.score)], schema=FOUND)

    found = dealt.mapInArrow(scan, "query_id long, vec_id long, score double")
    if parts > 1:
        nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= k + 1)
    found = tables.write(found.select("query_id", "vec_id"), "shortlists")
    # A vector that is on very many lists goes to them by broadcast; a query has one list.
    lists = found.groupBy("vec_id").agg(F.count("*").alias("n"))
    wanted = tables.write(held.select("vec_id", "ids", "v").join(lists, "vec_id"), "listed")
    pairs = join_counted(found, wanted, ["vec_id"]).select("query_id", "ids", "v")
    scored = pairs.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = scored.select("query_id", "ids", exactly(F.col("q"), F.col("v"), measure).alias("score"))
    out = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    tables.keep("queries", "shortlists", "listed")
    return out


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.where("vec_id % 20 = 0"))
