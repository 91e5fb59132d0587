"""Harmonic packing of token sequences.

Documents are cut to lengths that divide the capacity with almost no rest, and every class of length fills its own bins
with a fixed number of pieces. A worker needs nothing of the others: no shuffle, no global state.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, small_batches, texts_of, to_batch

#: Pieces this short are not cut further; a class of such a length wastes less than it in a bin.
SHORT = 32
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_tokens", pa.int64()),
        ("class_count", pa.int64()),
    ]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, class_count long"


#: Chunks that the normaliser only puts in lower case and that the splitter cuts as below: printable ASCII without the
#: apostrophe, and the letters of Latin-1, which are composed already.
PLAIN = re.compile(r"[!-&(-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
PARTS = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")


# The normaliser and the splitter that PLAIN and PARTS stand for, as the tokenizer's file has them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def visible_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is visible, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes.

    Under a tokenizer that never joins letters across white space (NORMALIZER and SPLITTER; the file is checked) a text is cut
    at spaces, tabs and line ends, which the tokenizer drops; what lies between is encoded once and kept, up to `keep` entries.
    Plain chunks are cut into words, digits and marks, and those go to the merge model directly, once each; all else takes the
    whole tokenizer.
    """

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The short cuts below are those of one normaliser and splitter; any other tokenizer encodes whole texts.
        self.known = (
            spec["normalizer"] == NORMALIZER
            and spec["pre_tokenizer"] == SPLITTER
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and all(t["content"].startswith("<|") and not set(t["content"]) & set(" \t\r\n") for t in spec["added_tokens"])
        )
        self.keep = keep
        self.shown = visible_bytes()
        self.seen: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            if len(self.words) >= self.keep:
                self.words.clear()
            said = word if word.isascii() else "".join([self.shown[b] for b in word.encode()])
            out = self.words[word] = array("I", [t.id for t in self.model.tokenize(said)]).tobytes()
        return out

    def chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            low = chunk.lower()
            return self.word(low) if low.isalpha() else b"".join(map(self.word, PARTS.findall(low)))
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.known:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        seen = self.seen
        out = list(map(seen.get, chunks))
        if None in out:
            for k, v in enumerate(out):
                if v is None:
                    v = seen.get(c := chunks[k])
                    if v is None:
                        if len(seen) >= self.keep:
                            seen.clear()
                            seen[""] = b""
                        v = seen[c] = self.chunk(c)
                    out[k] = v
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cuts(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of `total` tokens: whole bins, then the largest floor(capacity / k) that fits,
    again and again, until at most SHORT tokens are left."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest > SHORT:
        k = -(-capacity // rest)
        piece = capacity // k
        while piece > rest:
            k += 1
            piece = capacity // k
        out.append(piece)
        rest -= piece
    if rest:
        out.append(rest)
    return out


class Packer:
    """Bins of one worker. `place` returns bins as they fill up, `rest` packs what the open bins hold.

    A bin is a list of (doc, start, length, crc, doc tokens). A class is a length; its bin takes capacity // length pieces.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def place(self, piece: tuple) -> list[tuple] | None:
        length = piece[2]
        bin_ = self.open.setdefault(length, [])
        bin_.append(piece)
        if len(bin_) == self.capacity // length:
            return self.open.pop(length)
        return None

    def rest(self) -> list[list[tuple]]:
        """First fit, the longest pieces first. The open bins hold less than one bin a class, so this is bounded."""
        bins: list[list] = []
        room: list[int] = []
        by_length = sorted(self.open.items(), reverse=True)
        self.open = {}
        for length, pieces in by_length:
            at = 0
            for piece in pieces:
                while at < len(bins) and room[at] < length:
                    at += 1
                if at == len(bins):
                    bins.append([])
                    room.append(self.capacity)
                bins[at].append(piece)
                room[at] -= length
        return bins


def pack(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end_id: int = 1
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the checksum of its ids.

    tokenizer: path of a `tokenizers` file, on every executor. A document is its ids and then end_id. Null text is the empty
    text: one piece, the end id alone. Repeated rows are packed each on its own; a null id stays null. An empty table gives
    no rows. Other columns are ignored, whatever their names. Sequence ids are unique and those of a partition are consecutive.
    A task that runs again gives the same rows if its input comes in the same order, as that of a table does.
    """

    small_batches(docs.sparkSession)

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = end_id.to_bytes(4, "little")
        packer = Packer(capacity)
        next_id = TaskContext.get().partitionId() << 36
        out: dict[str, list] = {f.name: [] for f in SCHEMA}
        columns = [out[f.name] for f in SCHEMA]

        def emit(bin_: list[tuple], count: int) -> None:
            nonlocal next_id
            used = sum(p[2] for p in bin_)
            offset = 0
            for doc, start, length, crc, total in bin_:
                for column, v in zip(columns, (doc, start, length, crc, total, next_id, offset, used, count), strict=True):
                    column.append(v)
                offset += length
            next_id += 1

        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, texts_of(batch, "text"), strict=True):
                tokens = encode(text) + end
                total = len(tokens) // 4
                start = 0
                for length in cuts(total, capacity):
                    crc = zlib.crc32(tokens[4 * start : 4 * (start + length)])
                    if full := packer.place((doc, start, length, crc, total)):
                        emit(full, len(full))
                    start += length
            if columns[0]:
                yield to_batch(out, SCHEMA)
                for column in columns:
                    column.clear()
        for bin_ in packer.rest():
            emit(bin_, 0)
        if columns[0]:
            yield to_batch(out, SCHEMA)

    rows = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"cast(`{text_column}` as string) as text")
    return rows.mapInArrow(worker, DDL)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path())

