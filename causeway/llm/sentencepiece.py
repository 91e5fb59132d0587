"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The compiled machine is the composition of the normaliser (dummy prefix, white space as a visible mark), the pieces, and the
byte fallback. Its states are the pieces read last. An arc between two pieces weighs nothing if merging their joined text
keeps the two apart, and infinity otherwise. With these weights one path of finite weight is left for any input, and that
shortest path in the tropical semiring is the segmentation that the merge order of the vocabulary gives: sums of piece scores
would be the segmentation of another model type. Where several pieces have one score, which this walk can't order, the merges
are carried out one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches, texts_of, to_batch

MARK = "▁"
CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
# Piece types of the model format.
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
# Fixed value: the model type whose pieces are ordered by merges.
MERGES = 2


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Transducer:
    """compile once, then compose with texts. keep: how many chunks are remembered."""

    def __init__(self, path: str, keep: int = 700_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError(f"{path}: its normaliser maps characters; only the identity with a prefix and marks is compiled")
        if model.trainer_spec.model_type != MERGES:
            raise ValueError(f"{path}: model type {model.trainer_spec.model_type}; only merge-ordered models are compiled")
        if {k for k, p in enumerate(model.pieces) if p.type == BYTE} == set():
            raise ValueError(f"{path}: no byte pieces to fall back on")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        scores: list[float] = []
        for k, p in enumerate(model.pieces):
            scores.append(p.score)
            if p.type in (NORMAL, USER_DEFINED, UNUSED):
                self.ids[p.piece] = k
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = k
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.bytes_of.append(b"")
        self.scores = scores
        self.keep = keep
        self.seen: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.chars = {c for c in self.ids if len(c) == 1}
        # A lower rank merges first. Of pieces with a rank of their own, those that the merges build from letters are states.
        order = sorted((-scores[k], k) for s, k in self.ids.items() if len(s) > 1)
        self.rank = {k: n for n, (_, k) in enumerate(order)}
        shared = {s for s, t in zip(order, order[1:], strict=False) if s[0] == t[0]} | {t for s, t in zip(order, order[1:], strict=False) if s[0] == t[0]}
        self.unordered = {k for _, k in shared}
        self.parts: dict[int, tuple[int, int]] = {}
        self.states: dict[str, int] = {c: self.ids[c] for c in self.chars}
        self.join: dict[tuple[int, int], int] = {}
        text_of = {k: s for s, k in self.ids.items()}
        for _, k in order:
            s = text_of[k]
            if k in self.unordered or MARK in s[1:]:
                continue
            for c in range(1, len(s)):
                a, b = self.ids.get(s[:c]), self.ids.get(s[c:])
                if a is not None and b is not None:
                    self.join[a, b] = k
            last = self.last_merge(s)
            if last:
                self.parts[k] = last
                self.states[s] = k
        # No merge crosses two characters that stand side by side in no piece: inputs are cut there, and parts remembered.
        self.inside = {s[i : i + 2] for s in self.ids for i in range(len(s) - 1)}
        self.paths: dict[str, list[int]] = {}
        # The states as a tree of characters: what follows, and the state that ends here or -1.
        self.tree: dict = {}
        for text, k in self.states.items():
            node = self.tree
            for c in text[:-1]:
                node = node.setdefault(c, [-1, {}])[1]
            node.setdefault(text[-1], [-1, {}])[0] = k

    def merges(self, chunk: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges one by one, best score first and leftmost among equals; also the two sides of the last merge."""
        symbols: list[str | None] = list(chunk)
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols):
                k = self.ids.get(symbols[a] + symbols[b])
                if k is not None:
                    heapq.heappush(heap, (-self.scores[k], a, b, symbols[a] + symbols[b]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        last = None
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or symbols[a] + symbols[b] != both or after[a] != b:
                continue
            last = (symbols[a], symbols[b])
            symbols[a], symbols[b] = both, None
            after[a] = after[b]
            if after[a] < len(symbols):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None], last

    def last_merge(self, piece: str) -> tuple[int, int] | None:
        out, last = self.merges(piece)
        return (self.ids[last[0]], self.ids[last[1]]) if out == [piece] and last else None

    def weighs_nothing(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two states keeps them apart: at no point of building both up does a merge
        across the border come before the next merge inside."""
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= 4 * self.keep:
                self.apart.clear()
            known = self.apart[key] = self.stay_apart(a, b)
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        rank, parts = self.rank, self.parts
        limit = float("inf")
        # Taken apart in reverse: the later of the two merges first; on a tie the left one was made first, so the right goes first.
        while True:
            joined = self.join.get((a, b))
            if joined is not None and rank[joined] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]

    def shortest_path(self, part: str) -> list[int]:
        """States of a part with at most one mark, in front. Of the states that can end a prefix, one weighs nothing after what
        comes before it, so the first such arc into a place is the arc of the shortest path."""
        n, apart = len(part), self.apart
        last = [-1] * (n + 1)
        width = [0] * (n + 1)
        for start in range(n):
            node, before = self.tree, last[start] << 20
            for end in range(start, n):
                step = node.get(part[end])
                if step is None:
                    break
                k, node = step
                if k >= 0 and last[end + 1] < 0:
                    if start:
                        free = apart.get(before | k)
                        if not free and (free is not None or not self.weighs_nothing(last[start], k)):
                            continue
                    last[end + 1], width[end + 1] = k, end + 1 - start
        if min(last[1:]) < 0:  # the merges themselves always end
            return [i for s in self.merges(part)[0] for i in ([self.ids[s]] if s in self.ids else self.as_bytes(s))]
        out, at = [], n
        while at:
            out.append(last[at])
            at -= width[at]
        return out[::-1]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk. Characters that are no piece go out as bytes."""
        if MARK in chunk[1:]:
            parts = self.merges(chunk)[0]
            return packed([i for s in parts for i in ([self.ids[s]] if s in self.ids else self.as_bytes(s))])
        out: list[bytes] = []
        at, inside, paths = 0, self.inside, self.paths
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in inside:
                part = chunk[at:i]
                path = paths.get(part)
                if path is None:
                    if len(paths) >= self.keep:
                        paths.clear()
                    path = packed(self.shortest_path(part) if part[0] in self.chars else self.as_bytes(part))
                    if len(part) <= 64:
                        paths[part] = path
                out.append(path)
                at = i
        return b"".join(out)

    def as_bytes(self, char: str) -> list[int]:
        return [self.byte_ids[x] for x in char.encode()]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        chunks = CHUNK.findall((MARK if self.prefix else "") + text.replace(" ", MARK))
        seen = self.seen
        out = list(map(seen.get, chunks))
        if None in out:
            for k, v in enumerate(out):
                if v is None:
                    v = seen.get(c := chunks[k])
                    if v is None:
                        if len(seen) >= self.keep:
                            seen.clear()
                        v = self.chunk(c)
                        if len(c) <= 64:
                            seen[c] = v
                    out[k] = v
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"cast(`{text_column}` as string) as text")


def encoded(batches: Iterator[pa.RecordBatch], machine: Transducer) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids)."""
    for batch in slices(batches):
        found = [machine.encode(t) for t in texts_of(batch)]
        offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs its doc_id and ids (array of int). model: path of a SentencePiece model file, on every executor.

    Null and empty texts give no ids. Null ids and repeated rows keep a row each. Whole texts are encoded. Other columns are
    ignored. An empty table gives no rows. A model that is not merge-ordered, maps characters or has no byte pieces is refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, transducer(model))

    return texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row of tokens its doc_id and text. Null ids give the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in slices(batches):
            texts = [machine.decode(x or []) for x in batch.column(1).to_pylist()]
            yield to_batch({"doc_id": batch.column(0).to_pylist(), "text": texts}, schema)

    return tokens.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"cast(`{ids_column}` as array<int>) as ids").mapInArrow(
        run, "doc_id long, text string"
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, number of ids and of byte ids, checksum of the ids, and the SHA-256 of what they decode to, in one pass."""
    model = model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_byte_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        is_byte = np.zeros(len(machine.bytes_of), bool)
        is_byte[list(machine.byte_ids.values())] = True
        for batch in encoded(batches, machine):
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = ids.values.to_numpy()
                row = (doc, len(a), int(is_byte[a].sum()), zlib.crc32(a.astype("<u4").tobytes()), hashlib.sha256(machine.decode(a.tolist()).encode()).hexdigest())
                for column, v in zip(out.values(), row, strict=True):
                    column.append(v)
            yield to_batch(out, schema)

    return texts(docs, "doc_id", "text").mapInArrow(digest, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string")
