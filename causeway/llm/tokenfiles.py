"""Token-id files: ids of whole corpora in id order, under an adaptive context-mixing range coder.

A file holds blocks of ids. Each block starts with a fresh model and has a checksum, so blocks are coded side by side, as the
lanes of numpy arrays. Three predictors drive the coder: the frequencies of classes of ids (order 0) and the ids that followed the
last one and the last two before (orders 1 and 2). What each of them says is weighed by how often it was right in its present
state, the weighted probabilities are added, and the sum drives one step of a range coder.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, fresh_dir, slices, small_batches, to_batch
from .packing import visible_bytes

#: Production parameters: ids in a block, and blocks that are coded side by side.
BLOCK = 4096
LANES = 2048
MAGIC = b"CWIDS\x00\x01\n"
#: A group of blocks: lanes and steps; then a CRC-32 of these and of the two arrays that follow (words and checksum of each block).
GROUP = struct.Struct("<II")
#: The last bytes of a file: where the table of documents begins, its bytes, documents, ids, block size, vocabulary; then a CRC-32 of the
#: table and these.
TAIL = struct.Struct("<QQQQII")
CRC = struct.Struct("<I")

U = np.uint64
WORD = U(32)
#: Bits of the weights of the three predictors, of the frequencies of classes, and classes an octave of ids.
MIX, CLASS, PER_OCTAVE = 8, 12, 16
#: Bits within a class at most: with those of weights and classes, a step takes 2 ** 32 apart and no more.
LINE = 12
#: Bits that hold the frequency of a class, which may be all of 2 ** CLASS.
MASS = CLASS + 1
LOW = (1 << MASS) - 1
#: Steps after which the frequencies of order 0 are brought up to date: often in the first ones of a block, then seldom.
OFTEN, SELDOM, EARLY = 32, 128, 256
#: A slot of the order-1 and order-2 tables: the place of the id that came last, and whether it was right the last two times.
SLOTS_1, SLOTS_2 = 10, 11
NONE = -4
#: Weights are learnt as two fields of 32 bits of one number, each from 0 to about 64000, moved by a 32nd of what is missing.
FIELDS = 0x0001FFFF_0001FFFF
FULL, RATE = 2000, 5


class Places:
    """Ids as places on a line, in order. The ids of an octave are cut into PER_OCTAVE classes of one size (more, where that would
    take more than LINE bits); lesser ids are classes of their own. A place is the number of the class and, in `bits` lower bits,
    the part of the class that lies before the id."""

    def __init__(self, vocabulary: int):
        if not 0 < vocabulary <= 1 << 20:
            raise ValueError("a vocabulary has 1 to 2 ** 20 ids")
        octaves = int(vocabulary - 1).bit_length()
        lower = max(PER_OCTAVE.bit_length() - 1, octaves - 1 - LINE)
        per = 1 << lower
        self.bits = max(octaves, lower + 2) - 1 - lower
        ids = np.arange(vocabulary)
        octave = np.frexp(np.maximum(ids, 1).astype(np.float64))[1] - 1
        log_size = np.maximum(octave - lower, 0)
        number = np.where(ids < 2 * per, ids, log_size * per + (ids >> log_size))
        self.of = (number << self.bits | (ids & ((1 << log_size) - 1)) << (self.bits - log_size)).astype(np.int32)
        self.classes = int(number[-1]) + 1
        self.size = np.ones(1 << self.classes.bit_length(), np.int64)  # of an id of the class, on the line
        self.size[number] = 1 << (self.bits - log_size)
        back = np.zeros(self.classes << self.bits, np.int32)
        back[self.of] = ids
        self.ids = np.maximum.accumulate(back)


@lru_cache(maxsize=4)
def places(vocabulary: int) -> Places:
    return Places(vocabulary)


class Model:
    """The predictors of n lanes. All arithmetic is on whole numbers, so a reader on any machine gets what the writer had."""

    def __init__(self, n: int, at: Places, inverse: bool = False):
        self.n, self.at = n, at
        lane = np.arange(n)
        self.base_1, self.base_2 = lane << SLOTS_1, lane << SLOTS_2
        self.table_1, self.table_2 = np.full(n << SLOTS_1, NONE, np.int32), np.full(n << SLOTS_2, NONE, np.int32)
        # A state is how orders 2 and 1 did the last two times in their slots, and whether they agree; at first a hit is a fair guess.
        start = np.zeros((4, 4, 2), np.int64)
        for h2, p2 in enumerate((6000, 20000, 28000, 48000)):
            for h1, p1 in enumerate((2000, 8000, 10000, 16000)):
                start[h2, h1] = p2 << 32 | p1 * (64000 - p2) // 64000, p2 << 32
        self.mix, self.base_mix = np.tile(start.ravel(), n), lane * 32
        self.wide = len(at.size)
        self.base = lane * self.wide
        self.count = np.zeros((n, self.wide), np.int32)
        self.count[:, : at.classes] = 1
        # Of each class the sum of those before it and, in MASS lower bits, its own frequency.
        self.line = np.ones((n, self.wide), np.int32)
        self.line_of = self.line.ravel()
        self.class_of: np.ndarray | None = None
        self.kinds = np.tile(np.arange(at.classes, dtype=np.uint8 if at.classes <= 256 else np.uint16), n) if inverse else None
        self.renew()

    def renew(self) -> None:
        """Frequencies of classes that add up to 2 ** CLASS, none of them 0."""
        k = self.at.classes
        count = self.count[:, :k]
        mass = (count.astype(np.float64) * ((1 << CLASS) - k) / count.sum(1, keepdims=True)).astype(np.int32)  # one rounding, the same everywhere
        mass += 1
        mass[np.arange(self.n), mass.argmax(1)] += (1 << CLASS) - mass.sum(1)
        line = np.cumsum(mass, axis=1, dtype=np.int32)
        line -= mass
        line <<= MASS
        line |= mass
        self.line[:, :k] = line
        if self.kinds is not None:  # the class that each part of the line belongs to, so that a reader looks it up
            self.class_of = np.repeat(self.kinds, mass.ravel())

    def learn(self, x: np.ndarray) -> None:
        """Count the classes of a segment (steps, lanes)."""
        at = (x >> self.at.bits) + self.base
        self.count += (4 * np.bincount(at.ravel(), minlength=self.count.size)).astype(np.int32).reshape(self.count.shape)
        self.renew()

    def slots(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = last * 0x9E3779B1, before * 0x85EBCA6B
        return ((one & 0xFFFFFFFF) >> (32 - SLOTS_1)) + self.base_1, (((one ^ two) & 0xFFFFFFFF) >> (32 - SLOTS_2)) + self.base_2

    def look(self, slot_1: np.ndarray, slot_2: np.ndarray) -> tuple[np.ndarray, ...]:
        """What is in the slots, the state that this is, and its weights."""
        v1, v2 = self.table_1.take(slot_1, mode="clip"), self.table_2.take(slot_2, mode="clip")
        a, b = v1 >> 2, v2 >> 2
        state = ((v2 & 3) << 3 | (v1 & 3) << 1 | (a == b)) + self.base_mix
        return v1, v2, a, b, state, self.mix.take(state, mode="clip")

    def note(self, slot_1, slot_2, v1, v2, state, q, hit_1, hit_2, x4) -> None:
        """What has come (x4: four times its place) goes into the slots, and the weights of the state move."""
        self.mix[state] = q - (q >> RATE & FIELDS) + np.where(hit_2, FULL << 32, hit_1 * FULL)
        self.table_1[slot_1] = x4 | (v1 << 1 & 2) | hit_1
        self.table_2[slot_2] = x4 | (v2 << 1 & 2) | hit_2

    def weights(self, q: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of order 0, and of orders 1 and 2 as lengths of the line. They add up to 2 ** MIX; where orders 1 and 2 say the same, 2 has both."""
        w = q >> 8 & 0x000000FF_000000FF
        w2, w1 = w >> 32, (w & 255) * ~agree
        return (1 << MIX) - w1 - w2, w1 << (CLASS + self.at.bits), w2 << (CLASS + self.at.bits)

    def begin(self, x: np.ndarray) -> np.ndarray:
        """Where order 0 has the places."""
        bits = self.at.bits
        line = self.line_of.take((x >> bits) + self.base, mode="clip").astype(np.int64)
        return (line >> MASS << bits) + (x & ((1 << bits) - 1)) * (line & LOW)


def segments(steps: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < steps:
        end = min(steps, at + (OFTEN if at < EARLY else SELDOM))
        yield at, end
        at = end


def code(ids: np.ndarray, at: Places) -> tuple[np.ndarray, np.ndarray]:
    """ids: (steps, lanes). The words of each lane, in its row, and how many they are."""
    steps, n = ids.shape
    model = Model(n, at)
    total = U(MIX + CLASS + at.bits)
    top = U(1 << 32)
    low, span = np.zeros(n, U), np.full(n, 2**64 - 1, U)
    room = steps + 8
    out = np.zeros(n * room, np.uint32)
    put = np.arange(n) * room
    before = np.zeros((2, n), np.int64)
    for first, end in segments(steps):
        x = at.of[ids[first:end]].astype(np.int64)
        known = np.concatenate([before, x])
        slots_1, slots_2 = model.slots(known[1:-1], known[:-2])
        x4 = (x << 2).astype(np.int32)
        said_1, said_2, mixed = np.empty(x.shape, np.int32), np.empty(x.shape, np.int32), np.empty(x.shape, np.int64)
        for i in range(len(x)):
            v1, v2, a, b, state, q = model.look(slots_1[i], slots_2[i])
            model.note(slots_1[i], slots_2[i], v1, v2, state, q, a == x[i], b == x[i], x4[i])
            said_1[i], said_2[i], mixed[i] = a, b, q
        w0, w1, w2 = model.weights(mixed, said_1 == said_2)
        mass = model.line_of.take((x >> at.bits) + model.base).astype(np.int64) & LOW
        starts = model.begin(x) * w0 + (said_1 < x) * w1 + (said_2 < x) * w2
        lengths = mass * at.size.take(x >> at.bits) * w0 + (said_1 == x) * w1 + (said_2 == x) * w2
        starts, lengths = starts.view(U), lengths.view(U)
        for i in range(len(x)):
            unit = span >> total
            more = unit * starts[i]
            low += more
            carry = low < more
            if carry.any():
                j = put[carry] - 1
                while len(j):
                    out[j] += np.uint32(1)
                    j = j[out[j] == 0] - 1
            span = unit * lengths[i]
            need = np.flatnonzero(span < top)
            held, p = low[need], put[need]
            out[p] = held >> WORD
            put[need] = p + 1
            low[need] = held << WORD
            span[need] <<= WORD
        before = known[-2:]
        model.learn(x)
    for _ in range(2):
        out[put] = low >> WORD
        put += 1
        low <<= WORD
    return out.reshape(n, room), put - np.arange(n) * room


def decode(words: np.ndarray, starts: np.ndarray, steps: int, at: Places) -> np.ndarray:
    """The ids (steps, lanes) of lanes whose words begin at `starts`."""
    n = len(starts)
    flat = np.concatenate([words, np.zeros(4, np.uint32)]).astype(U)
    get = starts.astype(np.int64)
    model = Model(n, at, inverse=True)
    total = U(MIX + CLASS + at.bits)
    top, last = U(1 << 32), U((1 << int(total)) - 1)
    value, span = flat[get] << WORD | flat[get + 1], np.full(n, 2**64 - 1, U)
    get += 2
    base_class = np.arange(n) << CLASS
    x = np.empty((steps, n), np.int32)
    came = before = np.zeros(n, np.int64)
    last_word = flat.size - 1
    ends = {end: first for first, end in segments(steps)}
    for i in range(steps):
        slot_1, slot_2 = model.slots(came, before)
        v1, v2, a, b, state, q = model.look(slot_1, slot_2)
        w0, w1, w2 = model.weights(q, a == b)
        unit = span >> total
        t = np.minimum(value // unit, last).view(np.int64)
        # What orders 1 and 2 put on the line is taken out of it again, order 1 first; then order 0 is all there is.
        first = np.maximum(t - model.begin(np.maximum(a, 0)) * w0 - (b < a) * w2, 0)
        t = t - np.minimum(first, w1)
        second = np.maximum(t - model.begin(np.maximum(b, 0)) * w0, 0)
        t = t - np.minimum(second, w2)
        u = (t.view(U) // w0.view(U)).view(np.int64)
        c = model.class_of.take((u >> at.bits) + base_class, mode="clip").astype(np.int64)
        line = model.line_of.take(c + model.base, mode="clip").astype(np.int64)
        mass, base = line & LOW, line >> MASS << at.bits
        size = at.size.take(c, mode="clip")
        within = ((u - base).view(U) // mass.view(U)).view(np.int64) & -size
        now = c << at.bits | within
        hit_1, hit_2 = a == now, b == now
        model.note(slot_1, slot_2, v1, v2, state, q, hit_1, hit_2, (now << 2).astype(np.int32))
        start = (base + within * mass) * w0 + (a < now) * w1 + (b < now) * w2
        length = mass * size * w0 + hit_1 * w1 + hit_2 * w2
        value = value - unit * start.view(U)
        span = unit * length.view(U)
        need = np.flatnonzero(span < top)
        g = get[need]
        value[need] = value[need] << WORD | flat[np.minimum(g, last_word)]
        get[need] = g + 1
        span[need] <<= WORD
        x[i] = now
        before, came = came, now
        if i + 1 in ends:
            model.learn(x[ends[i + 1] : i + 1].astype(np.int64))
    return at.ids[x]


#: Characters of chunks that are cut into pieces here; chunks with others go to the tokenizer whole.
PLAIN = regex.compile(r"[!-~\nÀ-ÖØ-öø-ÿ]+")
#: Marks that end many chunks, and letters before them.
MARKS = ".,;:!?"
LETTERS = frozenset(c for c in map(chr, range(256)) if regex.fullmatch(r"[A-Za-zÀ-ÖØ-öø-ÿ]", c))
# Fixed value: the splitter that byte-level tokenizers use.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Fixed value: a splitter that cuts before a space between two other characters, which is what the short cut needs.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class ChunkEncoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes.

    Under a byte-level merge tokenizer without a normaliser (the file is checked) no id joins what lies before a space between two
    other characters to what follows, so a text is cut there; a chunk is encoded once with its space and kept, up to `keep`
    chunks. Chunks that are empty or begin or end with white space go with their neighbours to the tokenizer itself.
    """

    def __init__(self, path: str, keep: int = 1_200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.known = (
            spec["normalizer"] is None
            and spec["pre_tokenizer"] == SPLITTER
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or t.get("single_word") for t in spec["added_tokens"])
        )
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.shown = visible_bytes()
        self.keep = keep
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # Where no special token has a space or a mark in it, chunks can stand side by side in any order, and a mark after a letter alone.
        self.apart = not any(c in t for t in self.specials for c in " " + MARKS)
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[k for t, k in vocabulary.items() if t.startswith(self.shown[32]) and t not in self.specials]] = True

    def plainly(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            if len(self.pieces) >= self.keep:
                self.pieces.clear()
            out = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize("".join([self.shown[b] for b in piece.encode()]))]).tobytes()
        return out

    def chunk(self, chunk: str, space: str = " ") -> bytes:
        """Of a chunk that neither begins nor ends with white space, after `space`."""
        if PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.specials):
            return b"".join(map(self.piece, PIECES.findall(space + chunk)))
        return self.plainly(space + chunk)

    def encode(self, text: str) -> bytes:
        if not self.known or any(" " in s and s in text for s in self.specials):
            return self.plainly(text)
        chunks = text.split(" ")
        kept = self.chunks
        out = list(map(kept.get, chunks))
        out[0] = self.chunk(chunks[0], "") if clean(chunks[0]) else None
        if None in out:
            for k, v in enumerate(out):
                if v is None:
                    chunk = chunks[k]
                    if not clean(chunk):
                        return self.ragged(chunks)
                    if k == 0:
                        out[0] = self.chunk(chunk, "")
                        continue
                    v = kept.get(chunk)
                    if v is None:
                        v = self.chunk(chunk)
                        self.hold({chunk: v})
                    out[k] = v
        return b"".join(out)

    def hold(self, new: dict[str, bytes]) -> None:
        if len(self.chunks) + len(new) > self.keep:
            self.chunks.clear()
        self.chunks.update((c, v) for c, v in new.items() if len(c) < 100)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """What encode gives for each of the texts (none is null), where a chunk that many of them have is looked up once."""
        if not self.known or not self.apart or not len(texts):
            yield from map(self.encode, texts.to_pylist())
            return
        chunks = pc.split_pattern(texts, " ")
        bounds = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        found: list[bytes | None] = list(map(self.chunks.get, distinct))
        # Texts with a chunk that isn't clean, and the first chunk of a text, which has no space before it, take their own way.
        rough = np.array([not clean(c) if v is None else False for c, v in zip(distinct, found, strict=True)])
        own = np.logical_or.reduceat(rough[index], bounds[:-1])
        first = index[bounds[:-1]]
        index[bounds[:-1]] = len(distinct) + np.arange(len(texts))
        needed = np.zeros(len(distinct) + len(texts), bool)
        needed[index] = True
        new = {distinct[k]: b"" for k in np.flatnonzero(needed[: len(distinct)] & ~rough).tolist() if found[k] is None}
        rest = []
        for c in new:
            # A mark after a letter is a piece of its own.
            if c[-1] in MARKS and c[-2:-1] in LETTERS and (v := self.chunks.get(c[:-1])) is not None:
                new[c] = v + self.piece(c[-1])
            else:
                rest.append(c)
        new.update(zip(rest, self.together(rest), strict=True))
        found = [new.get(c, b"") if v is None else v for c, v in zip(distinct, found, strict=True)]
        found += [b"" if o else self.chunk(distinct[k], "") for k, o in zip(first.tolist(), own.tolist(), strict=True)]
        self.hold(new)
        ids = pa.array(found, pa.large_binary()).take(pa.array(index))
        at, raw = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[bounds].tolist(), memoryview(ids.buffers()[2] or b"")
        for k, rest_of in enumerate(own.tolist()):
            yield self.encode(texts[k].as_py()) if rest_of else bytes(raw[at[k] : at[k + 1]])

    def together(self, chunks: list[str], most: int = 200) -> list[bytes]:
        """Of clean chunks, each after a space, `most` by a call of the tokenizer: a chunk's ids begin with one that begins with the space."""
        out: list[bytes] = []
        for low in range(0, len(chunks), most):
            part = chunks[low : low + most]
            ids = np.array(self.whole.encode(" " + " ".join(part), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(part) and at[0] == 0:
                raw, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                out += [raw[a:b] for a, b in pairwise(cuts)]
            else:
                out += map(self.chunk, part)
        return out

    def ragged(self, chunks: list[str]) -> bytes:
        """Of chunks some of which aren't clean: those that no safe cut parts go to the tokenizer together."""
        out, k = [], 0
        while k < len(chunks):
            low = k
            while k + 1 < len(chunks) and not (clean(chunks[k][-1:]) and clean(chunks[k + 1][:1])):
                k += 1
            k += 1
            space = " " if low else ""
            if k - low == 1 and clean(chunks[low]):
                chunk = chunks[low]
                out.append((self.chunks.get(chunk) if low else None) or self.chunk(chunk, space))
            else:
                out.append(self.plainly(space + " ".join(chunks[low:k])))
        return b"".join(out)


def clean(chunk: str) -> bool:
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


#: Bytes of texts that are cut into chunks at once, if they aren't one text.
TEXTS = 1 << 22


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut at rows, into about TEXTS bytes each."""
    for batch in slices(batches, BATCH_ROWS):
        rows = max(1, batch.num_rows * TEXTS // max(TEXTS, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


class Writer:
    """One file, written under a temporary name; what is added comes out in blocks, coded in groups of up to `lanes`."""

    def __init__(self, fs: pafs.FileSystem, root: str, name: str, vocabulary: int, block: int, lanes: int):
        self.fs, self.root, self.name, self.vocabulary, self.block, self.lanes = fs, root, name, vocabulary, block, lanes
        self.held: list[bytes] = []
        self.waiting = self.ids = self.size = 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.temporary = f"{root}/_temporary_{name}"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.held.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block * self.lanes:
            self.code(self.block * self.lanes)

    def code(self, least: int) -> None:
        """Code what is held in whole groups, and at last (least 1) what is left of it too."""
        ids = np.frombuffer(b"".join(self.held), np.uint32)
        while len(ids) >= least:
            lanes = min(self.lanes, -(-len(ids) // self.block))
            steps = min(self.block, -(-len(ids) // lanes))
            taken, ids = ids[: lanes * steps], ids[lanes * steps :]
            self.group(taken, lanes, steps)
        self.held, self.waiting = [ids.tobytes()], len(ids)

    def group(self, ids: np.ndarray, lanes: int, steps: int) -> None:
        """lanes blocks of `steps` ids, the last ones shorter; those are filled up with id 0 for the coder."""
        full = np.zeros(lanes * steps, np.uint32)
        full[: len(ids)] = ids
        words, counts = code(full.reshape(lanes, steps).T, places(self.vocabulary))
        sums = np.array([zlib.crc32(ids[k * steps : (k + 1) * steps].tobytes()) for k in range(lanes)], "<u4")
        head = counts.astype("<u4").tobytes() + sums.tobytes()
        sizes = GROUP.pack(lanes, steps)
        self.put(sizes + CRC.pack(zlib.crc32(sizes + head)) + head)
        self.put(words[np.arange(words.shape[1])[None] < counts[:, None]].astype("<u4").tobytes())

    def close(self) -> tuple[str, int, int, int]:
        if self.waiting:
            self.code(1)
        known = np.array([d is not None for d in self.docs], np.uint8)
        docs = np.diff(np.array([d or 0 for d in self.docs], np.int64), prepend=0)
        table = zlib.compress(known.tobytes() + docs.astype("<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        at = self.size
        self.put(table)
        tail = TAIL.pack(at, len(table), len(self.docs), self.ids, self.block, self.vocabulary)
        self.put(tail + CRC.pack(zlib.crc32(table + tail)))
        self.out.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        return self.name, self.size, len(self.docs), self.ids


class Reader:
    """A file's documents in order, a group of blocks at a time; every checksum is held against what was read."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.path = path
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(max(0, size - TAIL.size - CRC.size))
        tail, crc = self.file.read(TAIL.size), self.file.read(CRC.size)
        at, length, n, self.ids, _, self.vocabulary = TAIL.unpack(tail)
        self.held(at + length == size - TAIL.size - CRC.size, "the length of the file")
        self.file.seek(at)
        table = self.file.read(length)
        self.held(CRC.pack(zlib.crc32(table + tail)) == crc, "the table of documents")
        raw = zlib.decompress(table)
        self.known = np.frombuffer(raw, np.uint8, n)
        self.docs = np.cumsum(np.frombuffer(raw, "<i8", n, n))
        self.lengths = np.frombuffer(raw, "<i8", n, 9 * n)

    def held(self, right: bool, what: str) -> None:
        if not right:
            raise ValueError(f"{self.path}: {what} differs from its checksum")

    def groups(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        self.held(self.file.read(len(MAGIC)) == MAGIC, "the first line")
        left = self.ids
        while left:
            sizes, crc = self.file.read(GROUP.size), self.file.read(CRC.size)
            lanes, steps = GROUP.unpack(sizes)
            head = self.file.read(8 * lanes)
            self.held(CRC.pack(zlib.crc32(sizes + head)) == crc, "the head of a group")
            counts, sums = np.frombuffer(head, "<u4", lanes).astype(np.int64), np.frombuffer(head, "<u4", lanes, 4 * lanes)
            words = np.frombuffer(self.file.read(4 * int(counts.sum())), "<u4")
            ids = decode(words, np.cumsum(counts) - counts, steps, places(self.vocabulary)).T.astype("<u4").ravel()[:left]
            for k in range(lanes):
                self.held(zlib.crc32(ids[k * steps : (k + 1) * steps].tobytes()) == sums[k], f"block {k} of a group")
            left -= len(ids)
            yield ids

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc, ids of the file before it, its ids, their CRC-32)."""
        groups = self.groups()
        ids, at, start = np.zeros(0, "<u4"), 0, 0
        for doc, known, length in zip(self.docs.tolist(), self.known.tolist(), self.lengths.tolist(), strict=True):
            crc, left = 0, length
            while left:
                if at == len(ids):
                    ids, at = next(groups), 0
                part = ids[at : at + left]
                crc = zlib.crc32(part, crc)
                at, left = at + len(part), left - len(part)
            yield doc if known else None, start, length, crc
            start += length


MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("bytes", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])
MANIFEST_DDL = "shard long, file string, bytes long, documents long, ids long"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_ids(
    docs: DataFrame, out: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, lanes: int = LANES
) -> DataFrame:
    """Write the ids of all texts, end_id after each, into files in the folder `out` (a URI that all executors see), in ascending order
    of document ids over the files in the order of their shards; return the manifest (shard, file, bytes, documents, ids).

    tokenizer: path of a `tokenizers` file, on every executor. Null ids come first. Rows of one id come in the order of their texts,
    and null text is the empty text: the end id alone. Repeated rows are documents each. A text is shuffled once; a task holds the
    ids of one group of blocks and a count for each of its documents. A file gets its name when it is whole, and only files in
    the manifest count, so what a lost task left behind is never read. An empty table gives no files. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root)
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.alias("text"))
    # Rows of one id are spread by the beginning of their texts, equal rows by a number of each; bounds stay short.
    rows = rows.withColumn("head", F.left("text", F.lit(32))).withColumn("spread", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", "head", "spread").sortWithinPartitions("doc_id", "text").select("doc_id", "text")

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        vocabulary = max(tokens.size, end_id + 1)
        context = TaskContext.get()
        file = None
        for batch in portions(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode_all(batch.column(1)), strict=True):
                if file is None:
                    mine, shared = pafs.FileSystem.from_uri(out)
                    file = Writer(mine, shared, f"{context.partitionId():06d}-{uuid.uuid4().hex}.ids", vocabulary, block, lanes)
                file.add(doc, ids + end)
        if file is not None:
            row = (context.partitionId(), *file.close())
            yield to_batch({f.name: [v] for f, v in zip(MANIFEST, row, strict=True)}, MANIFEST)

    dealt.mapInArrow(worker, MANIFEST_DDL).write.parquet(f"{out}/_manifest")
    return spark.read.schema(MANIFEST_DDL).parquet(f"{out}/_manifest")


def read_ids(manifest: DataFrame, out: str) -> DataFrame:
    """A row per document of the manifest's files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A task reads one file. The driver has a name and a count for each file.
    """
    spark = manifest.sparkSession
    files = sorted((r.shard, r.file, r.ids) for r in manifest.collect())
    starts = np.cumsum([0, *(n for _, _, n in files)]).tolist()
    listed = spark.sparkContext.broadcast([(name, at) for (_, name, _), at in zip(files, starts, strict=False)])

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, before = listed.value[k]
                found: list[tuple] = []
                for doc, start, length, crc in Reader(fs, f"{root}/{name}").documents():
                    found.append((doc, before + start, length, crc))
                    if len(found) >= 10_000:
                        yield told(found)
                        found = []
                if found:
                    yield told(found)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(worker, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(docs: DataFrame) -> DataFrame:
    out = fresh_dir(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, out, tokenizer_path(), 2), out)
