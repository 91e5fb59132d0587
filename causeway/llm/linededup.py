"""Line dedup: later copies of repeated runs of lines are deleted.

Lines get identifiers, and the suffixes of a document's sequence of identifiers get ranks by distributed prefix doubling: the
rank of 2^(k+1) lines comes from the ranks of two neighbouring halves, in sorted order, and a suffix that shares its prefix
with no other drops out. A run is long enough from MIN_WORDS words on, hence of that many lines at most, and that bounds the
doubling. Of each class of equal runs the first occurrence stays, all others are deleted.

Why this is what the suffix array gives. Suffixes in rank order are the suffix array; those with a common prefix of n lines
are neighbours there, an interval within which the LCP is n at least, and their ranks of 2^k lines at both ends of the n lines
(2^k <= n < 2^(k+1)) are equal, while those of any other suffix are not. So (n, rank, rank) names the LCP interval, without a
sort of all suffixes on one machine. A maximal repeated run M is a longest such prefix. The runs that are named here are those
just long enough: `ahead` lines from a line on, `back` lines up to one. For a line of M, the just long enough run that starts
there lies in M; or M has too few words from there on, and the one that ends there lies in M; or it has too few on both sides,
and the one that starts where M does goes past the line. Each of these repeats wherever M does, so all of M's later copies go,
line by line; and no line goes that isn't in a repeated run. Tests hold the deletions against a search of all runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, join_counted, parted, slices, small_batches, texts_of, to_batch

#: Words that a repeated run has at least.
MIN_WORDS = 50

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINES = pa.schema(
    [("none", pa.bool_()), ("id", pa.int64()), ("tx", pa.int64()), ("p", pa.int32()), ("h", pa.binary()), ("ahead", pa.int32()), ("back", pa.int32())]
)
LINES_DDL = "none boolean, id long, tx long, p int, h binary, ahead int, back int"


def reach(words: list[int], least: int) -> list[int]:
    """For each line the number of lines from it on that hold `least` words together, 0 if the rest holds less."""
    out = [0] * len(words)
    total, end = 0, 0
    for start, w in enumerate(words):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        if total >= least:
            out[start] = end - start
        total -= w
    return out


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """A row per line that has a word: its place among those, its identifier, and how many lines ahead and back, itself
    included, make a run that is just long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {f.name: [] for f in LINES}
            for none, doc, tx, text in zip(*(batch.column(c).to_pylist() for c in range(3)), texts_of(batch), strict=True):
                lines = [x for line in text.split("\n") if (x := line.strip(BLANK))]
                words = [len(WORD.findall(x)) for x in lines]
                ahead, back = reach(words, least), reach(words[::-1], least)[::-1]
                out["none"] += [none] * len(lines)
                out["id"] += [doc] * len(lines)
                out["tx"] += [tx] * len(lines)
                out["p"] += range(len(lines))
                out["h"] += [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines]
                out["ahead"] += ahead
                out["back"] += back
            if out["p"]:
                yield to_batch(out, LINES)

    return docs.mapInArrow(run, LINES_DDL)


#: What tells documents apart: whether the id is null, the id (0 then), the hash of the text.
DOC = ["none", "id", "tx"]


def identity(id_column: str, text_column: str) -> list[Column]:
    i, zero = F.col(f"`{id_column}`").cast("long"), F.lit(0).cast("long")
    return [i.isNull().alias("none"), F.coalesce(i, zero).alias("id"), F.coalesce(F.xxhash64(F.col(f"`{text_column}`").cast("string")), zero).alias("tx")]


def ranked(keys: DataFrame, tables: Tables, label: str) -> DataFrame:
    """Distinct keys that occur twice or more, with ranks in their order and counts. Counting comes first and is pre-aggregated."""
    columns = keys.columns
    often = keys.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return tables.write(often.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id()), label)


def suffix_ranks(lines: DataFrame, least: int, tables: Tables) -> list[DataFrame]:
    """By k, the ranks (DOC, p, r) of all prefixes of 2^k lines that occur twice or more; the first also has ahead and back.

    Lines that occur once are gone after the first join; nothing else is done to them. Rows with equal id and text give each
    of their lines twice and are made one after that.
    """
    ranks = ranked(lines.select("h"), tables, "line-ids")
    level = join_counted(lines, ranks, ["h"]).select(*DOC, "p", F.col("rank").alias("r"), "ahead", "back")
    level = tables.write(level.dropDuplicates([*DOC, "p"]), "ranks")
    levels = [level]
    size = 1
    while 2 * size <= least:
        by_doc = Window.partitionBy(*DOC).orderBy("p")
        halves = level.select(*DOC, "p", "r").withColumn("r2", F.when(F.lead("p", size).over(by_doc) == F.col("p") + size, F.lead("r", size).over(by_doc)))
        halves = halves.where("r2 is not null")
        ranks = ranked(halves.select("r", "r2"), tables, "pairs")
        level = tables.write(join_counted(halves, ranks, ["r", "r2"]).select(*DOC, "p", F.col("rank").alias("r")), "ranks")
        if not level.take(1):
            break
        levels.append(level)
        size *= 2
    return levels


def copies(lines: DataFrame, least: int, tables: Tables) -> DataFrame:
    """(DOC, p, n): runs of n lines that repeat an earlier run and don't overlap it."""
    levels = suffix_ranks(lines, least, tables)
    starts, ends = F.struct("p", F.col("ahead").alias("n")), F.struct((F.col("p") - F.col("back") + 1).alias("p"), F.col("back").alias("n"))
    runs = levels[0].select(*DOC, F.explode(F.array(starts, ends)).alias("run")).select(*DOC, "run.p", "run.n").where("n > 0").distinct()
    found = None
    for k, level in enumerate(levels):
        size = 1 << k
        wanted = runs.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        left = wanted.join(level.select(*DOC, "p", F.col("r").alias("ra")), [*DOC, "p"])
        if size == 1:
            named = left.withColumn("rb", F.col("ra"))
        else:
            left = left.withColumn("p2", (F.col("p") + F.col("n") - size).cast("int"))
            named = left.join(level.select(*DOC, F.col("p").alias("p2"), F.col("r").alias("rb")), [*DOC, "p2"])
        named = named.select(*DOC, "p", "n", "ra", "rb")
        found = named if found is None else found.unionByName(named)
    found = tables.write(found, "runs")
    key = ["n", "ra", "rb"]
    first = found.groupBy(*key).agg(F.min(F.struct(~F.col("none"), "id", "tx", "p")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = join_counted(found, tables.write(first, "firsts"), key, count="c")
    here = (F.col("none") == ~F.col("first.col1")) & (F.col("id") == F.col("first.id")) & (F.col("tx") == F.col("first.tx"))
    return later.where(~here | (F.col("p") >= F.col("first.p") + F.col("n"))).select(*DOC, "p", "n")


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines of runs; a line without words goes with the line before it. Also lines, and lines deleted."""
    gone: set[int] = set()
    for p, n in runs:
        gone.update(range(p, p + n))
    out, place, drop, total, deleted = [], -1, 0 in gone, 0, 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            place += 1
            drop = place in gone
            total += 1
            deleted += drop
        if not drop:
            out.append(line)
    return "\n".join(out), total, deleted


def deduplicated(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars", least: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_deleted")
) -> DataFrame:
    """docs with later copies of repeated runs of lines cut out of the text, and the numbers of lines and of deleted lines.

    Lines are compared without white space at their ends; those without a word are no part of runs. The order of occurrences is
    that of id (null first), content and line. Rows with equal id and text are one document and have one result. Null text
    stays null and has no lines. All other columns stay, but for the length of changed texts. counts names the two that are added;
    columns of docs with those names are replaced. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "line-dedup")
    docs = docs.drop(*counts)
    rows = docs.select(*identity(id_column, text_column), F.col(f"`{text_column}`").cast("string").alias("text"))
    lines = tables.write(lines_of(rows, least), "lines")
    runs = copies(lines, least, tables).groupBy(*DOC).agg(F.collect_set(F.struct("p", "n")).alias("_runs"))
    times = lines.where("p = 0").groupBy(*DOC).agg(F.count("*").alias("times")).where("times > 1")
    runs = tables.write(runs.join(times, DOC, "left").select(*DOC, "_runs", F.coalesce("times", F.lit(1)).alias("times")), "cuts")
    tables.keep("cuts")
    names = docs.columns
    at = names.index(text_column)
    # The row travels as one struct, so no column of it can clash with a key. Only rows that may have runs are shuffled.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *identity(id_column, text_column))
    maybe, rest = parted(keyed, F.xxhash64(*DOC), runs.select(F.xxhash64(*DOC)))
    joined = join_counted(maybe, runs, DOC, "left", "times").select("row", "_runs").unionByName(rest.select("row", F.lit(None).cast("array<struct<p: int, n: int>>").alias("_runs")))
    joined = joined.select(*[F.col(f"row.`{c}`") for c in names], F.col("_runs").alias("runs of this row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                (None, 0, 0) if t is None else without(t, [(x["p"], x["n"]) for x in r or []])
                for t, r in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
            ]
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array([f[0] for f in found], pa.string())
            if length_column in names:
                k = names.index(length_column)
                columns[k] = pa.array([len(f[0]) if f[2] else o for f, o in zip(found, columns[k].to_pylist(), strict=True)], columns[k].type)
            columns += [pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *counts])

    small_batches(docs.sparkSession)
    schema = docs.withColumns({c: F.lit(0).cast("long") for c in counts}).schema
    return joined.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))
