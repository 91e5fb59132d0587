"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by page id and dealt to shards of consecutive ids, a task each; a shard's files roll over at a
compressed size.
Headers and digests are made anew from the payload. A file is written under a temporary name and then renamed; a manifest
lists the files that count, so what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, fresh_dir, join_counted, slices, small_batches, to_batch

#: Shards at most; more bytes give larger shards, whose files still roll over at ROLL_BYTES.
BINS = 65536
SHARD_BYTES = 32 << 20
ROLL_BYTES = 32 << 20
#: The date of all records unless the caller gives another: the archive depends on the pages alone.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = pa.schema(
    [("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())]
)
MANIFEST_DDL = "file string, bytes long, records long, first_id long, last_id long, sha256 string"
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("file", pa.string()),
        ("payload", pa.binary()),
    ]
)
RECORDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}/{page_id}')}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record in its own gzip member. A revisit has the headers of the response but not its payload."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    )
    block = http if kind == "revisit" else http + payload
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, "page")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", clean(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, "page"))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def info_record(name: str, date: str) -> bytes:
    block = b"software: causeway\r\nformat: WARC File Format 1.1\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\n"
        f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


class Files:
    """The open file of one task. A file is made in memory, so it is bounded by the roll size and one record."""

    def __init__(self, uri: str, attempt: str, roll_bytes: int, date: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.attempt, self.roll_bytes, self.date = attempt, roll_bytes, date
        self.shard: int | None = None
        self.roll = 0
        self.parts: list[bytes] = []

    def add(self, shard: int, page_id: int | None, data: bytes) -> dict | None:
        """The manifest's row of the file that this record closes, if any."""
        done = None
        if self.parts and (shard != self.shard or self.size + len(data) > self.roll_bytes):
            done = self.close()
        if not self.parts:
            self.roll = self.roll + 1 if shard == self.shard else 0
            self.shard = shard
            self.name = f"shard-{shard:06d}-{self.roll:05d}.warc.gz"
            self.parts = [info_record(self.name, self.date)]
            self.size = len(self.parts[0])
            self.count = 0
            self.first = page_id
        self.parts.append(data)
        self.size += len(data)
        self.count += 1
        self.last = page_id
        return done

    def close(self) -> dict | None:
        if not self.parts:
            return None
        data = b"".join(self.parts)
        self.parts = []
        temporary = f"{self.root}/_temporary_{self.name}.{self.attempt}"
        with self.fs.open_output_stream(temporary, compression=None) as out:
            out.write(data)
        self.fs.move(temporary, f"{self.root}/{self.name}")
        return {"file": self.name, "bytes": len(data), "records": self.count, "first_id": self.first, "last_id": self.last, "sha256": hashlib.sha256(data).hexdigest()}


def revisits(digests: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat an earlier payload; only digests travel, and those that very many
    pages share by broadcast."""
    repeated = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return join_counted(digests, repeated, ["digest"]).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """The first page id of every shard but the first, in order: shards of consecutive ids and about shard_bytes each.

    sizes: page_id, size. Slices of the id range are counted; those that hold more than a quarter of a shard are cut again
    between their own least and greatest id, until none does or holds a single id. So bounds follow the bytes wherever ids
    cluster, and depend on the rows alone. A pass cuts at most some 8 * BINS slices and the driver gets a row of each; beyond BINS
    shards' worth of bytes the shards get larger.
    """
    spark = sizes.sparkSession
    whole = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if whole[0] is None:
        return []
    total = int(whole[2])
    most = max(shard_bytes, -(-total // BINS))
    done: list[tuple[int, int]] = []
    todo: list[tuple[int, int, int]] = [(whole[0], whole[1], total)]
    while todo:
        cuts: list[int] = []
        for low, high, size in todo:
            step = max(1, -(-(high - low + 1) // max(2, -(-8 * size // most))))
            cuts += range(low, high + 1, step)
        held = spark.sparkContext.broadcast(np.array(cuts, np.int64))
        ends = spark.sparkContext.broadcast(np.array([[low, high] for low, high, _ in todo], np.int64))

        def placed(batches: Iterator[pa.RecordBatch], held=held, ends=ends) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
                at = np.searchsorted(ends.value[:, 0], ids, "right") - 1
                inside = (at >= 0) & (ids <= ends.value[np.maximum(at, 0), 1])
                ids, size = ids[inside], size[inside]
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(held.value, ids, "right") - 1), pa.array(ids), pa.array(size)], names=["slice", "page_id", "size"])

        counted = sizes.mapInArrow(placed, "slice long, page_id long, size long").groupBy("slice").agg(F.min("page_id"), F.max("page_id"), F.sum("size"))
        todo = []
        for _, low, high, size in sorted(map(tuple, counted.collect())):
            if size > most // 4 and low < high:
                todo.append((low, high, size))
            else:
                done.append((low, size))
        held.destroy()
        ends.destroy()
    out, held_bytes = [], 0
    for low, size in sorted(done):
        if held_bytes and held_bytes + size > most:
            out.append(low)
            held_bytes = 0
        held_bytes += size
    return out


def write_archive(
    pages: DataFrame,
    out: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write a record per row of pages into the folder `out` (a URI that all executors see); return the manifest.

    Null payload is the empty one; null url gives no target header. Of rows with equal payloads of min_bytes at least, that
    with the least id is the response and the others revisit it; of repeated rows of that id the first is. A row with a null
    id is a response; these rows have shards of their own after the others, dealt by their content. Other columns are ignored.
    An empty table gives an empty manifest and no files. The files depend on the rows alone: not on partitions, nor on tasks
    that ran twice. A task writes one shard.
    """
    spark = pages.sparkSession
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root)
    rows = pages.select(
        F.col(f"`{id_column}`").cast("long").alias("page_id"),
        F.col(f"`{url_column}`").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_column}`").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    small_batches(spark)
    tables = Tables(spark, "warc-digests")
    size = (F.length("payload") + 512).cast("long").alias("size")
    digests = tables.write(rows.select("page_id", F.sha2("payload", 256).alias("digest"), size), "digests")
    known = digests.where("page_id is not null")
    starts = bounds(known.select("page_id", "size"), shard_bytes)
    nulls = digests.where("page_id is null").agg(F.sum("size")).first()[0] or 0
    numbered, extra = len(starts) + 1, max(1, min(BINS, -(-nulls // shard_bytes)))
    at = spark.sparkContext.broadcast(np.array(starts, np.int64))

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at.value, ids.to_numpy(), "right").astype(np.int32))

    # A mark goes before the record that it makes a revisit: the large payloads are shuffled once, in the order of the archive.
    marks = revisits(known.where(F.col("size") >= min_bytes + 512).select("page_id", "digest"))
    marks = marks.select("page_id", F.lit(None).cast("string").alias("url"), F.unhex("digest").alias("payload"), "refers_to", F.lit(0).alias("kind"))
    records = rows.withColumns({"refers_to": F.lit(None).cast("long"), "kind": F.lit(1)})
    spread = F.pmod(F.xxhash64("payload", "url"), F.lit(extra)).cast("int") + F.lit(numbered)
    shard = F.when(F.col("page_id").isNull(), spread).otherwise(shard_of(F.coalesce("page_id", F.lit(0).cast("long"))))
    dealt = marks.unionByName(records).withColumn("shard", shard)
    dealt = dealt.repartitionById(numbered + (extra if nulls else 0), "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "payload")

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(out, str(TaskContext.get().taskAttemptId()), roll_bytes, date)
        at: int | None = None
        known: dict[bytes, int | None] = {}
        for batch in slices(batches, 100):
            done = []
            for r in batch.to_pylist():
                if r["page_id"] is None or r["page_id"] != at:
                    at, known = r["page_id"], {}
                payload = r["payload"]
                if r["kind"] == 0:
                    known[payload] = r["refers_to"]
                    continue
                digest = hashlib.sha256(payload).digest()
                revisit = digest in known
                refers_to = known.get(digest)
                if at is not None and len(payload) >= min_bytes:
                    known.setdefault(digest, at)
                data = record("revisit" if revisit else "response", at, r["url"], payload, refers_to, date)
                done.append(files.add(r["shard"], at, data))
            if done := [d for d in done if d]:
                yield pa.RecordBatch.from_pylist(done, MANIFEST)
        if last := files.close():
            yield pa.RecordBatch.from_pylist([last], MANIFEST)

    dealt.select("shard", "page_id", "url", "payload", "refers_to", "kind").mapInArrow(worker, MANIFEST_DDL).write.parquet(f"{out}/_manifest")
    tables.keep()
    return spark.read.schema(MANIFEST_DDL).parquet(f"{out}/_manifest")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; a record is a gzip member of its own."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            chunk = view[at : at + 65536]  # what follows a member is copied, so little is offered at a time
            if not chunk:
                raise ValueError("the archive ends within a record")
            parts.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_archive(manifest: DataFrame, out: str, payloads: bool = False) -> DataFrame:
    """A row per record of the manifest's files. Digests and lengths of responses are made from what was read, and checked.

    payloads: whether rows carry the payload; revisits have none of their own.
    """

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for name, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} differs from the manifest")
                found: dict[str, list] = {f.name: [] for f in RECORDS}
                for headers, block in parse(data):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    _, _, payload = block.partition(b"\r\n\r\n")
                    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(headers["X-Payload-Length"])
                    if kind == "response" and (sha1_base32(payload), len(payload)) != (said, length):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    to = headers.get("X-Refers-To-Page-Id")
                    page = headers.get("X-Page-Id")
                    row = (
                        page and int(page), length, said, kind, to and int(to), headers.get("WARC-Target-URI"), name,
                        payload if payloads and kind == "response" else None,
                    )
                    for column, v in zip(found.values(), row, strict=True):
                        column.append(v)
                    if len(found["file"]) >= 500:
                        yield to_batch(found, RECORDS)
                        found = {f.name: [] for f in RECORDS}
                if found["file"]:
                    yield to_batch(found, RECORDS)

    spark = manifest.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "sha256").repartition(tasks, "file").mapInArrow(worker, RECORDS_DDL)


def query(pages: DataFrame) -> DataFrame:
    out = fresh_dir(pages.sparkSession, "warc")
    manifest = write_archive(pages, out)
    return read_archive(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def oracle() -> str:
    """The same in SQL, for tables without repeated or null ids; base 32 of a SHA-1 by 20 bits at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = "cast('0x' || substr(h, 5 * cast(i as int) + 1, 5) as bigint)"
    four = " || ".join(f"substr('{letters}', cast(({bits} >> {s}) & 31 as int) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string([{four} for i in range(8)], '') as payload_digest,
  case when page_id = min(page_id) over (partition by html) then 'response' else 'revisit' end as record_type,
  nullif(min(page_id) over (partition by html), page_id) as refers_to,
  regexp_replace(trim(url), '[ ]+', ' ', 'g') as url
from p
"""
