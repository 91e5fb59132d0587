"""Repair of conversation structure: which rows to keep, rename, delete or insert so that roles alternate.

A conversation's roles and faults are encoded as a compact string, its signature. Each distinct signature is solved once, by
memoised recursion; audits (strings of edits) are joined back to the conversations and replayed on their rows. A conversation
of very many rows is cut into pieces: what a piece costs between any two states is a small table, and these are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, join_counted, slices, small_batches

#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, RENAME, TRUNCATED = 2, 5, 1, 5
#: States of the pattern (s?(ua)+)?: nothing yet, after a system, a user, an assistant row. The first and last may end it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: What a row of an initial leads to from each state; None where the pattern has no such row.
STEP = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
    "o": (None, None, None, None),
}
#: The one state that a row put in, or one renamed, leads to from each state, and the role that it then has.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Rows of a piece, and letters of a conversation that is solved as one signature.
PIECE, WHOLE = 256, 512

#: A row's letter: s u a, or o for another initial; upper case if it is truncated; 0 1 2 3 if it has to be deleted.
SOUND, CUT, GONE = "suao", "SUAO", "0123"
KIND = {**{c: (c, False, False) for c in SOUND}, **{c: (c.lower(), True, False) for c in CUT}, **{c: (SOUND[k], False, True) for k, c in enumerate(GONE)}}
WHITE = " \t\n\x0b\x0c\r"

Costs = tuple[int, int, int, int]


def filled(costs: list[int]) -> Costs:
    """Costs of the rest from each state, if rows may also be put in first."""
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[NOTHING], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant


#: Nothing is left: from these states rows are put in until the pattern is whole.
LAST: Costs = filled([0, FAR, FAR, 0])


def edits(letter: str, state: int) -> Iterator[tuple[str, int, int]]:
    """The edits of a row in ASCII order, each with its cost and the state that it leads to; what is put in before is not among them."""
    initial, cut, gone = KIND[letter]
    yield "D", DELETE, state
    if not gone:
        more = TRUNCATED if cut else 0
        if (kept := STEP[initial][state]) is not None:
            yield "K", more, kept
        yield "R", RENAME + more, NEXT[state]


def through(letter: str, after: Costs) -> Costs:
    return filled([min(cost + after[to] for _, cost, to in edits(letter, s)) for s in range(4)])


@lru_cache(maxsize=1 << 16)
def ahead(rest: str) -> Costs:
    """The least cost of what is left of a signature, from each state."""
    return through(rest[0], ahead(rest[1:])) if rest else LAST


def audit(letters: str, state: int, costs: list[Costs], last: bool) -> tuple[str, int]:
    """The ASCII-least of the cheapest audits from `state`, and the state it ends in. costs[k]: of what is left before letter k;
    costs[-1]: after all of them. last: whether nothing follows, so that the pattern has to be completed.

    From a state every edit has a letter of its own, so the least letter that keeps to the least cost is the right one.
    """
    out = []
    for k, letter in enumerate(letters):
        while True:
            left = costs[k][state]
            found = {e: (cost, to) for e, cost, to in edits(letter, state) if cost + costs[k + 1][to] == left}
            if "D" in found or INSERT + costs[k][NEXT[state]] != left:
                break
            out.append("I")
            state = NEXT[state]
        edit = min(found)
        out.append(edit)
        state = found[edit][1]
    while last and state not in ENDS:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def illegal(letters: str) -> int:
    initials = "".join(KIND[c][0] for c in letters)
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def solve(signature: str) -> tuple[str, int, int]:
    """Audit, cost and the number of illegal neighbours of a whole signature."""
    costs = [ahead(signature[k:]) for k in range(len(signature) + 1)]
    return audit(signature, NOTHING, costs, True)[0], costs[0][NOTHING], illegal(signature)


def between(letters: str) -> list[Costs]:
    """What the letters cost from each state (outer) to each state after them (inner)."""
    columns = []
    for end in range(4):
        costs: Costs = tuple(0 if s == end else FAR for s in range(4))
        for letter in reversed(letters):
            costs = through(letter, costs)
        columns.append(costs)
    return [tuple(min(columns[e][s], FAR) for e in range(4)) for s in range(4)]


def mapped(fn: Callable[[list], list], types: list[pa.DataType], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Row tuples in, row tuples out, as Arrow batches."""
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = fn(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    return run


def spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def rows_of(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """(conv_id, turn, role, text, mark): null roles and texts are one space. mark orders the rows of one turn and role."""
    named = [F.col(f"`{c}`") for c in (id_column, turn_column, role_column, text_column)]
    rows = conversations.select(named[0].cast("long").alias("conv_id"), named[1].cast("long").alias("turn"), spaced(named[2]).alias("role"), spaced(named[3]).alias("text"))
    return rows.withColumn("mark", F.unhex(F.sha2("text", 256)))


ORDER = ["conv_id", "turn", "role", "mark"]


class Audits:
    """The audits of conversations, and the tables they lie in.

    pieces: (conv_id, piece, turn, role, mark, letters, audit), a row for every run of up to PIECE rows, in order of `piece`; turn, role
    and mark are those of its first row. conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost).
    """

    def __init__(self, tables: Tables, pieces: DataFrame, conversations: DataFrame):
        self.tables, self.pieces, self.conversations = tables, pieces, conversations


def audits(rows: DataFrame, tables: Tables) -> Audits:
    """rows: of rows_of(). No text is shuffled: what is sorted are ids, turns, roles and hashes."""
    text, role = F.col("text"), F.col("role")
    end = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    blank = end == ""
    key = F.concat_ws(":", spaced(F.col("conv_id")), F.length("role").cast("string"), "role", F.hex("mark"))
    facts = rows.select(*ORDER, blank.alias("blank"), (~blank & ~end.isin(".", "!", "?")).alias("truncated"), F.unhex(F.sha2(key, 256)).alias("said"))
    facts = tables.write(facts, "facts")
    # Places in the order of all rows: a partition's number in the upper bits, so a run of PIECE places lies in one partition.
    # Equal rows may be in any order, so a number of each spreads them.
    spread = facts.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*ORDER, "spread")
    placed = spread.drop("spread").sortWithinPartitions(*ORDER).withColumn("place", F.monotonically_increasing_id())
    placed = tables.write(placed, "placed")
    first = placed.where("not blank").groupBy("said").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = tables.write(first, "repeats")
    marked = join_counted(placed, repeats, ["said"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    initial = F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.left(role, F.lit(1))).cast("int")
    at = F.when(initial == 0, 4).otherwise(initial)
    letters = F.when(F.col("blank") | duplicate, F.lit(GONE)).when(F.col("truncated"), F.lit(CUT)).otherwise(F.lit(SOUND))
    lettered = marked.select(*ORDER, "place", "blank", duplicate.alias("duplicate"), (F.col("truncated") & ~duplicate).alias("truncated"), F.substring(letters, at, F.lit(1)).alias("letter"))
    # A piece is keyed by its window of places as well, so that none gathers more than PIECE rows of a conversation.
    rows_in = F.array_sort(F.collect_list(F.struct("place", "letter", "turn", "role", "mark")))
    ones = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    pieces = lettered.groupBy("conv_id", F.shiftright("place", 8).alias("piece")).agg(rows_in.alias("rows"), *ones)
    head = F.get("rows", F.lit(0))
    parts = [F.array_join(F.transform("rows", lambda r: r.letter), "").alias("letters"), *(head[c].alias(c) for c in ("turn", "role", "mark"))]
    pieces = tables.write(pieces.select("conv_id", "piece", *parts, "blank", "duplicate", "truncated"), "pieces")
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    whole = pieces.groupBy("conv_id").agg(F.sum(F.length("letters")).alias("size"), *counts)
    turns = placed.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    span = (F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("*")).cast("long")
    known = whole.join(turns.agg(span.alias("gaps")).withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left")
    known = tables.write(known.select("conv_id", "size", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated"), "known")

    sized = pieces.join(known.select(F.col("conv_id").alias("id"), "size"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    short, long_ = sized.where(F.col("size") <= WHOLE), sized.where(F.col("size") > WHOLE)
    solved = joined(short, tables)
    if not known.where(F.col("size") > WHOLE).isEmpty():
        solved = solved.unionByName(chained(long_, tables))
    solved = tables.write(solved, "solved")
    told = solved.where("cost is not null").select(F.col("conv_id").alias("id"), "illegal", "cost")
    conversations = known.join(told, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id", "size")
    tables.keep("solved", "known")
    return Audits(tables, solved.select("conv_id", "piece", "turn", "role", "mark", "audit"), conversations)


SOLVED = "conv_id long, piece long, turn long, role string, mark binary, audit string, illegal long, cost long"


def joined(pieces: DataFrame, tables: Tables) -> DataFrame:
    """SOLVED for conversations of at most WHOLE letters: a row each, with the keys of its first piece."""
    each = F.array_sort(F.collect_list(F.struct("piece", "letters", "turn", "role", "mark")))
    head = F.get("parts", F.lit(0))
    signed = pieces.groupBy("conv_id").agg(each.alias("parts"))
    signed = signed.select("conv_id", *(head[c].alias(c) for c in ("piece", "turn", "role", "mark")), F.array_join(F.transform("parts", lambda p: p.letters), "").alias("signature"))
    signed = tables.write(signed, "signed")
    distinct = signed.groupBy("signature").agg(F.count("*").alias("n"))
    run = mapped(lambda rows: [(s, n, *solve(s)) for s, n in rows], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], ["signature", "n", "audit", "cost", "illegal"])
    answers = tables.write(distinct.mapInArrow(run, "signature string, n long, audit string, cost long, illegal long"), "answers")
    return join_counted(signed, answers, ["signature"]).select("conv_id", "piece", "turn", "role", "mark", "audit", "illegal", "cost")


def chained(pieces: DataFrame, tables: Tables) -> DataFrame:
    """SOLVED for longer conversations: a row a piece; illegal and cost stand with the first. A task has of a conversation one
    row of 16 costs for every PIECE rows at most, and those of one step alone."""
    costs = pieces.select("conv_id", "piece", "letters").mapInArrow(
        mapped(lambda rows: [(c, p, [v for row in between(s) for v in row]) for c, p, s in rows], [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["conv_id", "piece", "costs"]),
        "conv_id long, piece long, costs array<long>",
    )

    def after(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        left, out = LAST, []
        for cells in reversed(table.column("costs").to_pylist()):
            out.append(list(left))
            left = tuple(min(cells[4 * s + e] + left[e] for e in range(4)) for s in range(4))
        n = table.num_rows
        return pa.table({"id": table.column("conv_id"), "number": table.column("piece"), "after": pa.array(out[::-1], pa.list_(pa.int64())), "total": pa.array([left[NOTHING]] + [None] * (n - 1), pa.int64()), "last": pa.array([False] * (n - 1) + [True])})

    ends = tables.write(costs.groupBy("conv_id").applyInArrow(after, "id long, number long, after array<long>, total long, last boolean"), "ends")
    same = F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("piece") == F.col("number"))

    def ways(rows: list) -> list:
        """The audit of a piece from each state, as the costs after it are known."""
        out = []
        for c, p, letters, after_, last in rows:
            costs = [tuple(after_)]
            for letter in reversed(letters):
                costs.append(through(letter, costs[-1]))
            costs.reverse()
            found = [audit(letters, s, costs, last) if costs[0][s] < FAR else ("", s) for s in range(4)]
            out.append((c, p, [a for a, _ in found], [e for _, e in found], KIND[letters[0]][0] + KIND[letters[-1]][0], illegal(letters)))
        return out

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), pa.int64()]
    names = ["id", "number", "audits", "ends", "edge", "inner"]
    tried = pieces.join(ends, same).select("conv_id", "piece", "letters", "after", "last")
    tried = tables.write(tried.mapInArrow(mapped(ways, kinds, names), "id long, number long, audits array<string>, ends array<long>, edge string, inner long"), "ways")

    def walked(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        state, states, edges = NOTHING, [], table.column("edge").to_pylist()
        for to in table.column("ends").to_pylist():
            states.append(state)
            state = to[state]
        n = len(states)
        wrong = sum(table.column("inner").to_pylist()) + sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(edges, edges[1:], strict=False))
        return pa.table({"conv_id": table.column("id"), "piece": table.column("number"), "state": pa.array(states, pa.int64()), "illegal": pa.array([wrong] + [None] * (n - 1), pa.int64())})

    states = tried.select("id", "number", "ends", "edge", "inner").groupBy("id").applyInArrow(walked, "conv_id long, piece long, state long, illegal long")
    states = tables.write(states, "states")
    out = states.join(tried.select("id", "number", "audits"), same).drop("id", "number").join(ends, same).drop("id", "number")
    out = out.select(F.col("conv_id").alias("id"), F.col("piece").alias("number"), F.get("audits", F.col("state").cast("int")).alias("audit"), "illegal", F.col("total").alias("cost"))
    return pieces.join(out, same).select("conv_id", "piece", "turn", "role", "mark", "audit", "illegal", "cost")


REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def repaired(rows: DataFrame, found: Audits) -> DataFrame:
    """The rows after the edits: conv_id, position (from 0), turn (null for one put in), role, text, edit (K, R or I).

    A conversation's rows follow each other in its order, in one partition. Texts are shuffled once; an audit goes before the
    rows that it is for. A task reads a conversation as a stream and keeps none of it but audits that are not used up.
    """
    kind = [F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"), "piece", "audit"]
    marks = found.pieces.select(*ORDER, *kind)
    texts = rows.select(*ORDER, "text", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("piece"), F.lit(None).cast("string").alias("audit"))
    dealt = marks.unionByName(texts).repartition("conv_id").sortWithinPartitions(*ORDER, "kind", "piece")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv: object = replay  # none yet
        state = position = 0
        left: list[str] = []  # audits, the next one last

        def put(turn: int | None, role: str, text: str, edit: str) -> None:
            nonlocal position
            out.append((conv, position, turn, role, text, edit))
            position += 1

        def inserts() -> None:
            nonlocal state
            while left and (not left[-1] or left[-1][0] == "I"):
                if not left[-1]:
                    left.pop()
                    continue
                left[-1] = left[-1][1:]
                state = NEXT[state]
                put(None, ROLE[state], "", "I")

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), REPAIRED, strict=True)], schema=REPAIRED)
            out.clear()
            return batch

        for batch in slices(batches, 200):
            for c, turn, role, text, kind_, audit_ in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv or conv is replay:
                    inserts()
                    conv, state, position, left = c, NOTHING, 0, []
                if kind_ == 0:
                    left.insert(0, audit_)
                    continue
                inserts()
                edit, left[-1] = left[-1][0], left[-1][1:]
                if edit == "D":
                    continue
                state = NEXT[state] if edit == "R" else STEP[role[:1]][state]
                put(turn, ROLE[state] if edit == "R" else role, text, edit)
            if out:
                yield flushed()
        inserts()
        if out:
            yield flushed()

    ddl = "conv_id long, position long, turn long, role string, text string, edit string"
    return dealt.select("conv_id", "turn", "role", "text", "kind", "audit").mapInArrow(replay, ddl)


def repair(
    conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> tuple[DataFrame, Audits]:
    """The repaired rows of all conversations, and their audits.

    A conversation's rows are taken by turn, nulls first; rows of one turn by role and then by the SHA-256 of the text, so the order
    depends on the rows alone. Null roles and texts count as one space, and a null id is a conversation. Of a row the first fault
    counts: blank, duplicate (role and text of an earlier row), truncated (it doesn't end in . ! or ?). Keeping costs 0, renaming
    the role to user or assistant 1, deleting 2 (required for blank rows and duplicates), putting an empty user or assistant row in
    5; a truncated row that stays adds 5. The cheapest edits that give roles (s?(ua)+)? are taken, of equals the ASCII-least
    string of their initials. An empty table gives no rows. Other columns are ignored.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    rows = rows_of(conversations, id_column, turn_column, role_column, text_column)
    found = audits(rows, Tables(spark, "dialogues"))
    return repaired(rows, found), found


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by the CRC-32 of conv_id:turn: dropped, emptied, without sentence marks, repeated, or with role user."""
    code = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn")))) % 20
    rows = conversations.select("conv_id", "turn", "role", "text", code.cast("int").alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows that stand together and in order: the SHA-256 of role:text, joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the open conversation and its hash
        done: list[tuple] = []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == conv:
                    held[1].update(b"\n")
                else:
                    if held:
                        done.append((held[0], held[1].hexdigest()))
                    held = [conv, hashlib.sha256()]
                held[1].update(f"{role}:{text}".encode())
            if len(done) >= 1000:
                yield told(done)
                done = []
        if held:
            done.append((held[0], held[1].hexdigest()))
        if done:
            yield told(done)

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done])], names=["conv_id", "repaired_sha256"])

    return repaired_rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def query(conversations: DataFrame) -> DataFrame:
    """A row per conversation, also for those that the damage leaves without rows."""
    rows, found = repair(damaged(conversations))
    tables = found.tables
    sums = tables.write(digests(rows).withColumnRenamed("conv_id", "id"), "digests")
    in_order = F.array_sort(F.collect_list(F.struct("piece", "audit")))
    whole = found.pieces.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda x: x.audit), "").alias("audit"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(whole.withColumnRenamed("conv_id", "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left")
    out = out.join(found.conversations.withColumnRenamed("conv_id", "b"), F.col("conv_id").eqNullSafe(F.col("b")), "left")
    out = out.join(sums, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    tables.keep("solved", "known", "digests")
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
