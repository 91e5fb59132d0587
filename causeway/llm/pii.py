"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Every scan is linear in the text, also on long runs of digits or letters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches, texts_of, to_batch

# Kinds in the order in which they are reported, the first four being the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

# The score a kind starts from, and the words whose nearness raises it.
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "insurance"),
}
#: Spans outside the base count from this score on. The score of a base span orders reports; the span stays.
LEAST = 0.5
#: Code points on either side of a span in which context words are looked for.
AROUND = 60

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
WORD = re.compile(r"[a-z-]+")

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
    ]
)
DDL = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"


def luhn(digits: str) -> bool:
    """The Luhn checksum: every second digit from the right doubled, digit sums added, divisible by ten."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The IBAN checksum: first four characters moved to the end, letters as 10 to 35, remainder 1."""
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.label: one step per @, so no run is scanned twice."""
    free = 0
    at = text.find("@")
    while at >= 0:
        head = text[free:at]
        local = len(head) - len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers up to 255: a chain of dotted numbers gives a match for every four of its parts."""
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(s := p.lstrip("0")) < 4 and int(s or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind, in the order of KINDS and then of start."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if any(d in text for d in "0123456789"):
        for kind, find in (("ip", addresses), ("card", cards), ("phone", phones)):
            for a, b in find(text):
                yield kind, a, b
        for m in IBAN.finditer(text):
            if mod97(m.group()):
                yield "iban", *m.span()
        for m in SSN.finditer(text):
            yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(WORD.findall((text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).lower()))
    return min(1.0, START[kind] + (0.3 if near & set(CONTEXT[kind]) else 0.0))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    scored = [(kind, a, b, score(text, kind, a, b)) for kind, a, b in proposals(text)]
    return [s for s in scored if s[0] in BASE or s[3] >= LEAST]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each stretch of touching or overlapping spans becomes the name of the kind that opens it, in brackets."""
    out, at, open_until = [], 0, -1
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= open_until:
            out.append(text[at:a])
            out.append(f"[{kind.upper()}]")
            open_until = b
        open_until = max(open_until, b)
        at = open_until
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs its id and its spans (kind, start, end in code points, score), by kind and start.

    Null text is the empty text, without spans. Null ids, repeated ids and repeated rows keep a row each. Whole texts are
    scanned, however long. Other columns are ignored, whatever their names. An empty table gives no rows.
    """

    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)] for t in texts_of(batch)]
            yield to_batch({"doc_id": batch.column(0).to_pylist(), "spans": spans}, SCHEMA)

    rows = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"cast(`{text_column}` as string) as text")
    return rows.mapInArrow(scan, DDL)


def redacted(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """docs with every span in its text replaced. All columns stay as they are, but for the length of changed texts.

    Null text stays null; texts without spans stay untouched.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_column)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t if t is None or not (s := find_spans(t)) else redact(t, s) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if length_column in names:
                k = names.index(length_column)
                old = batch.column(k).to_pylist()
                was = batch.column(at).to_pylist()
                columns[k] = pa.array(
                    [o if t == w else len(t) for o, t, w in zip(old, texts, was, strict=True)], batch.column(k).type
                )
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)


DIGEST_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("top_score", pa.float64())]
)
DIGEST_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double"


def query(docs: DataFrame) -> DataFrame:
    """The spans of `find`, counted by base kind and joined to text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {f.name: [] for f in DIGEST_SCHEMA}
            for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                out["doc_id"].append(doc)
                for k in BASE:
                    out[f"n_{k}"].append(sum(kind == k for kind, _ in said))
                out["base_sha256"].append(hashlib.sha256(",".join(s for k, s in said if k in BASE).encode()).hexdigest())
                out["spans"].append(",".join(s for _, s in said))
                out["top_score"].append(max((s["score"] for s in spans), default=None))
            yield to_batch(out, DIGEST_SCHEMA)

    return find(docs).mapInArrow(digest, DIGEST_DDL)
