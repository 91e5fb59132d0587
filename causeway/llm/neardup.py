"""N-gram Jaccard join by MinHash banding.

Documents with equal shingle sets are one member. Members meet in the buckets of their bands; there each is held against the
bucket's least member by a sketch, and goes on to the next round unless it is close to it, so buckets of any size cost a few
linear passes. What hangs together forms candidate groups, whose members are verified pairwise on their full shingle sets,
block against block. Pairs are never rows: rows are members, with links counted and spanning edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, block_pairs, classes, join_counted, parted, runs, slices, starts, texts_of, to_batch

#: Production parameters: words in a shingle, least similarity (as a fraction), bands, rows in a band. A pair at 0.8 shares no
#: bucket with probability (1 - 0.8 ** ROWS) ** BANDS = 0.00007. That it shares one and is lost there is bounded by `lost_pair`.
WORDS = 5
LEAST = (4, 5)
BANDS = 24
ROWS = 5
#: Sketch agreement from which two members of a bucket are joined, and from which one needs no further leader there. Jaccard
#: distance is a metric: of a pair at 0.8 or more, if one side is at s from a leader, the other is at s - 0.2 or more from it.
JOIN, SETTLED = 0.42, 0.78
#: Rounds of leaders, after which the rest of a bucket is compared in blocks; members in a block.
ROUNDS = 8
BLOCK = 512
#: Shingles in a block of whole sets, 8 bytes each; a set of more is a block's greatest part.
SHINGLES = 4 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)
SIGNED = pa.schema([("doc_id", pa.int64()), ("tx", pa.int64()), ("k", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
SIGNED_DDL = "doc_id long, tx long, k binary, n long, bands array<long>, sketch binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return (rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1))


def lost_pair(similarity: float = 0.8, components: int = BANDS * ROWS) -> float:
    """A bound on the chance that a pair shares a bucket and no candidate group.

    Both sides of a pair stay in a bucket until one of them is settled by a leader (or all that is left is compared in blocks).
    Say that side agrees with the leader on SETTLED of the sketch or more; the other agrees on it wherever it agrees with the
    first, so on SETTLED - (1 - m) or more if the pair itself agrees on m of the components. It is joined to the same leader
    if that is JOIN or more, for certain: only m < 1 - (SETTLED - JOIN) = 0.64 can lose the pair. Sketch bytes agree where the
    minima do, with the similarity as probability or more, independently by component: the chance is a binomial tail.
    """
    most = math.ceil((1 - (SETTLED - JOIN)) * components) - 1
    return sum(math.comb(components, k) * similarity**k * (1 - similarity) ** (components - k) for k in range(most + 1))


class Shingler:
    """Sets of hashed shingles: 64-bit, unique, sorted. A text of less than `words` words has all its words as one shingle."""

    def __init__(self, words: int = WORDS, keep: int = 1_000_000):
        self.words, self.keep = words, keep
        self.seen: dict[str, int] = {}
        self.powers = [pow(int(ODD), k + 1, 1 << 64) for k in range(words)]

    def ids(self, text: str) -> np.ndarray:
        seen = self.seen
        words = text.translate(OTHER_SPACE).split(" ") if text else []
        found = list(map(seen.get, words))
        if None in found:
            for k, v in enumerate(found):
                if v is None:
                    v = seen.get(w := words[k])
                    if v is None:
                        if len(seen) >= self.keep:
                            seen.clear()
                        v = seen[w] = xxhash.xxh3_64_intdigest(w.encode()) if w else 0
                    found[k] = v
        a = np.array(found, np.uint64)
        return a[a != 0]

    def shingles(self, text: str) -> np.ndarray:
        a = self.ids(text)
        w = min(self.words, len(a))
        if not w:
            return a
        n = len(a) - w + 1
        total = np.full(n, np.uint64(w), np.uint64)
        for k in range(w):
            total += a[k : k + n] * np.uint64(self.powers[k])
        return np.unique(mixed(total))


OTHER_SPACE = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash values (sets, count) of sets that aren't empty, as 32-bit numbers."""
    x = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)][:-1])
    low, high = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), count), np.uint32)
    for k, (a, b) in enumerate(zip(*coefficients(count), strict=True)):
        out[:, k] = np.minimum.reduceat(low * a + high * b, at)
    return out


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = values.reshape(len(values), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), v.shape[:2]).copy()
    for k in range(rows):
        total = mixed(total * ODD + v[:, :, k])
    return total.view(np.int64)


def signed(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """doc_id, tx, text to set key, set size, band hashes and sketch; texts without words have null keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for part in slices(batches, 200):
            sets = [shingler.shingles(t) for t in texts_of(part)]
            full = [s for s in sets if len(s)]
            values = signatures(full, bands * per_band) if full else np.empty((0, bands * per_band), np.uint32)
            hashes = iter(band_hashes(values, bands, per_band).tolist())
            sketches = iter((values & np.uint32(255)).astype(np.uint8))
            out: dict[str, list] = {"doc_id": part.column(0).to_pylist(), "tx": part.column(1).to_pylist(), "k": [], "n": [], "bands": [], "sketch": []}
            for s in sets:
                out["k"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["n"].append(len(s))
                out["bands"].append(next(hashes) if len(s) else None)
                out["sketch"].append(next(sketches).tobytes() if len(s) else None)
            yield to_batch(out, SIGNED)

    return rows.mapInArrow(run, SIGNED_DDL)


#: What tells rows apart: whether the id is null, the id, the hash of the text.
ROW = ["none", "id", "tx"]


def zero() -> Column:
    return F.lit(0).cast("long")


def identity(id_column: str, text_column: str) -> list[Column]:
    i = F.col(f"`{id_column}`").cast("long")
    return [i.isNull().alias("none"), F.coalesce(i, zero()).alias("id"), F.coalesce(F.xxhash64(F.col(f"`{text_column}`").cast("string")), zero()).alias("tx")]


def real_id() -> Column:
    return F.when(~F.col("none"), F.col("id")).alias("doc_id")


def rekeyed() -> list[Column]:
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", zero()).alias("id"), F.col("tx")]


EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def bucket_edges(sets: DataFrame, tables: Tables) -> DataFrame:
    """Candidate edges (a, b) between members that share a bucket and look alike."""
    placed = sets.select("k", F.explode("bands").alias("bucket"))
    shared = tables.write(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    members = join_counted(placed, shared, ["bucket"]).join(sets.select("k", "sketch"), "k").select("bucket", "k", "sketch")
    members = tables.write(members, "bucket-members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 4))
                alike = (a == b).mean(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(alike)], names=["bucket", "k", "sketch", "leader", "alike"])

    out = None
    for _ in range(ROUNDS):
        leaders = members.groupBy("bucket").agg(F.min(F.struct("k", "sketch")).alias("l"), F.count("*").alias("n"))
        leaders = tables.write(leaders.where("n > 1"), "leaders")
        pairs = join_counted(members, leaders, ["bucket"]).where(F.col("k") != F.col("l.k"))
        held = tables.write(
            pairs.select("bucket", "k", "sketch", F.col("l.k").alias("leader"), F.col("l.sketch").alias("leader_sketch")).mapInArrow(
                compare, "bucket long, k binary, sketch binary, leader binary, alike double"
            ),
            "bucket-round",
        )
        edges = held.where(F.col("alike") >= JOIN).select(F.col("k").alias("a"), F.col("leader").alias("b"))
        out = edges if out is None else out.unionByName(edges)
        members = held.where(F.col("alike") < SETTLED).select("bucket", "k", "sketch")
        if not members.take(1):
            return out
    # What is left are buckets of many members that are like none of the leaders: compare them all, block by block.
    counts = tables.write(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "left-buckets")
    paired = block_pairs(join_counted(members, counts, ["bucket"]), "bucket", "k", "n", BLOCK).select("bucket", "i", "j", "k", "sketch")
    keys = ["bucket", "i", "j"]

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            at = [*starts(t, keys).tolist(), t.num_rows]
            names, sketches = t.column("k").to_pylist(), t.column("sketch").to_pylist()
            for lo, hi in zip(at, at[1:], strict=False):
                v = np.frombuffer(b"".join(sketches[lo:hi]), np.uint8).reshape(hi - lo, -1)
                alike = np.stack([np.count_nonzero(v == row, axis=1) >= JOIN * v.shape[1] for row in v])
                found = [(names[lo + a], names[lo + b]) for a, b in spanning(alike)]
                if found:
                    yield to_batch({"a": [x[0] for x in found], "b": [x[1] for x in found]}, EDGE)

    rest = paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare_all, "a binary, b binary")
    return out.unionByName(rest)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Counts (sets, sets) of common elements, by products of 0/1 matrices over the elements that two sets or more hold."""
    n = len(sets)
    elements, index = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(index, minlength=len(elements)) > 1
    place = np.cumsum(often) - 1
    keep = often[index]
    index, owner = place[index[keep]], owner[keep]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    width = 4096
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(index, [low, low + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], index[a:b] - low] = 1
        out += m @ m.T
    return out.astype(np.int64)


VERIFIED = pa.schema([("k", pa.binary()), ("links", pa.int64()), ("linked_docs", pa.int64()), ("b", pa.binary())])


def verified(members: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(k, links, linked_docs, b) from members (c, i, j, own, k, copies, s): link counts of a block pair, or a spanning edge k-b.

    In a pair of two blocks only links across them count; the pairs within a block belong to its pair with itself.
    """
    keys = ["c", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            at = [*starts(t, keys).tolist(), t.num_rows]
            names, copies_, raw = t.column("k").to_pylist(), t.column("copies").to_numpy(), t.column("s").to_pylist()
            own, one = t.column("own").to_numpy(), (t.column("i").to_numpy() == t.column("j").to_numpy())
            out: dict[str, list] = {f.name: [] for f in VERIFIED}
            for lo, hi in zip(at, at[1:], strict=False):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in raw[lo:hi]]
                size = np.array([len(s) for s in sets])
                common = intersections(sets)
                link = least[1] * common >= least[0] * (size[:, None] + size - common)
                np.fill_diagonal(link, False)
                if not one[lo]:
                    link &= own[lo:hi, None] != own[lo:hi]
                weight = link @ copies_[lo:hi]
                for k in np.flatnonzero(weight).tolist():
                    out["k"].append(names[lo + k])
                    out["links"].append(int(link[k].sum()))
                    out["linked_docs"].append(int(weight[k]))
                    out["b"].append(None)
                for a, b in spanning(link):
                    out["k"].append(names[lo + a])
                    out["links"].append(0)
                    out["linked_docs"].append(0)
                    out["b"].append(names[lo + b])
            if out["k"]:
                yield to_batch(out, VERIFIED)

    placed = members.select("c", "i", "j", "own", "k", "copies", "s").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, "k binary, links long, linked_docs long, b binary")


def spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest: less than the number of rows."""
    left, out = np.ones(len(link), bool), []
    for start in range(len(link)):
        if left[start]:
            left[start] = False
            todo = [start]
            while todo:
                a = todo.pop()
                near = np.flatnonzero(link[a] & left)
                left[near] = False
                out += [(a, b) for b in near.tolist()]
                todo += near.tolist()
    return out


def with_sets(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, tx, text and others to the same with the shingle set s instead of the text."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 200):
            sets = [shingler.shingles(t).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sets, pa.binary())], names=[*names, "s"])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in names) + ", s binary")


def join_similar(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    least: tuple[int, int] = LEAST,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per row of docs: doc_id, tx (hash of the text), class_id, n_links, n_set_links, n_shingles, class_key.

    Two rows are linked if the Jaccard similarity of their sets of word shingles is least[0]/least[1] or more; rows with equal
    sets are linked. A class is what links hold together, class_id the least id in it, class_key its name, null for no class; n_links counts the rows linked to this
    one, n_set_links the different sets. A text of less than `words` words is one shingle. Texts without words and null texts
    are linked to nothing: class_id is their own id. Null ids stay null, and count as rows. Repeated rows are linked. Other
    columns are ignored. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "near-duplicates")
    # A null id is told apart from 0 by a column of its own, so that (none, id, tx) is never null.
    source = docs.select(*identity(id_column, text_column), F.col(f"`{text_column}`").cast("string").alias("text"))
    signs = signed(source.select(real_id(), "tx", "text"), words, bands, rows)
    signs = tables.write(signs, "signatures")
    own = signs.where("k is not null")
    # Of equal sets one row stands for all, by the least id; copies are counted and dropped before the shuffle.
    sets = own.groupBy("k").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "tx")).alias("first"), F.min("doc_id").alias("least_id"),
        F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"),
    )
    sets = tables.write(sets, "sets")
    candidates = classes(bucket_edges(sets.select("k", "bands", "sketch"), tables), tables, "candidates").withColumnRenamed("class", "c")
    members = tables.write(candidates.join(sets, candidates.id == sets.k).select("c", "k", "copies", "first", "n"), "members")
    sizes = tables.write(members.groupBy("c").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")), "sizes")
    members = join_counted(members.drop("n"), sizes, ["c"], count="m").select(
        "c", "k", "copies", "m", "shingles", F.col("first.doc_id").isNull().alias("none"), F.coalesce("first.doc_id", zero()).alias("id"), F.col("first.tx").alias("tx")
    )
    members = tables.write(members, "members")
    # Only texts that may be members' are shuffled, one of each id and text. They are dealt out at any size: whether the
    # members would fit a broadcast must not decide how this runs.
    maybe, _ = parted(source, F.xxhash64(*ROW), members.select(F.xxhash64(*ROW)))
    keyed = maybe.dropDuplicates(ROW).join(members.hint("merge"), ROW).select("c", "k", "copies", "m", "shingles", "text")
    held = tables.write(with_sets(keyed, words), "member-sets")
    checked = tables.write(verified(block_pairs(held, "c", "k", "m", BLOCK, "shingles", SHINGLES), least), "verified")
    links = checked.where("b is null").groupBy("k").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"))
    found = classes(checked.where("b is not null").select(F.col("k").alias("a"), "b"), tables, "classes")
    named = sets.join(found, sets.k == found.id, "left").select("k", "copies", "least_id", F.coalesce("class", "k").alias("class"))
    named = tables.write(named, "named")
    leasts = tables.write(named.groupBy("class").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n")), "leasts")
    facts = join_counted(named, leasts, ["class"]).join(links, "k", "left").select("k", "copies", "class", "class_id", "links", "linked_docs")
    facts = tables.write(facts, "facts")
    tables.keep("signatures", "facts")
    return join_counted(signs.select("doc_id", "tx", "k", "n"), facts, ["k"], "left", "copies").select(
        "doc_id",
        "tx",
        F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce(F.col("copies") - 1, zero()) + F.coalesce("linked_docs", zero())).alias("n_links"),
        F.coalesce("links", zero()).alias("n_set_links"),
        F.col("n").alias("n_shingles"),
        F.col("class").alias("class_key"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each class: that of the least id (null first), then of the least text hash.

    Rows without words are in no class and stay. All columns stay as they are. Only rows that may share their class with
    another are shuffled.
    """
    tables = Tables(docs.sparkSession, "one-of-each")
    found = join_similar(docs, id_column, text_column).where("class_key is not null")
    found = tables.write(found.select(*rekeyed(), "class_key"), "found")
    first = found.groupBy("class_key").agg(F.min(F.struct(~F.col("none"), "id", "tx")).alias("f"), F.count("*").alias("n"))
    several = tables.write(first.where("n > 1"), "several")
    shared = join_counted(found, several, ["class_key"]).groupBy(*ROW).agg(
        F.count("*").alias("n"), F.max((F.col("id") == F.col("f.id")) & (F.col("tx") == F.col("f.tx")) & (F.col("none") == ~F.col("f.col1"))).alias("stays")
    )
    shared = tables.write(shared, "shared")
    tables.keep("shared")
    # The row travels as one struct, so no column of it can clash with a key.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *identity(id_column, text_column))
    maybe, alone = parted(keyed, F.xxhash64(*ROW), shared.select(F.xxhash64(*ROW)))
    judged = join_counted(maybe, shared, ROW, "left")
    firsts = judged.where("stays")
    kept = firsts.where("n = 1").unionByName(firsts.where("n > 1").dropDuplicates(ROW)).unionByName(judged.where("stays is null"))
    return alone.select("row.*").unionByName(kept.select("row.*"))


def query(docs: DataFrame) -> DataFrame:
    return join_similar(docs).select("doc_id", "class_id", "n_links", "n_set_links", "n_shingles")
