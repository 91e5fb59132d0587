"""Secret scans over a blob ledger.

Versions of files are content-addressed. A ledger keeps, for every blob and version of the rules, what a scan found; only
blobs that the ledger lacks under the present rules are scanned, once each, and findings go back to all paths by content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, fresh_dir, join_counted, parted, slices, small_batches, texts_of, to_batch

#: Goes up whenever a rule changes; the ledger then scans every blob anew.
RULES_VERSION = 1

# Kinds in the order in which they are reported, the first three being the base.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "github", "jwt")

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
GITHUB = re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,255}(?![A-Za-z0-9_])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")

SPAN = "array<struct<kind: string, start: long, end: long>>"
SCHEMA = pa.schema(
    [("blob", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
)


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """Spans by start, then by kind. Leftmost non-overlapping within a kind; a match that fails its test is dropped whole."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [("pem", *m.span()) for m in PEM.finditer(text)]
    if "gh" in text:
        out += [("github", *m.span()) for m in GITHUB.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, text) to (blob, spans)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan_text(t)] for t in texts_of(batch)]
            yield to_batch({"blob": batch.column(0).to_pylist(), "spans": spans}, SCHEMA)

    return blobs.select("blob", "text").mapInArrow(scan, f"blob string, spans {SPAN}")


def ledger_at(spark, path: str) -> DataFrame:
    """The ledger: blob, rules, spans. A path without a ledger is an empty one."""
    schema = f"blob string, rules int, spans {SPAN}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_versions(
    versions: DataFrame,
    ledger: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_column: str | None = None,
    version_column: str | None = None,
    rules: int = RULES_VERSION,
) -> DataFrame:
    """Per row of versions: doc_id, path, version, blob and the blob's spans; the ledger at `ledger` grows by what was unseen.

    path_column and version_column name where and when a text was found (any type, passed on as strings; null if not given).
    Null text is the empty text. Null ids and repeated rows keep a row each: a blob is scanned once, whichever rows hold it, and
    not at all if the ledger has it under these rules. Texts of blobs that the ledger has are not shuffled (but for the few
    that a bitmap lets pass); hashes are. A ledger that two runs wrote at once may hold a blob twice; it counts once. Other
    columns are ignored, whatever their names. An empty table gives no rows and leaves the ledger as it is.
    """
    spark = versions.sparkSession
    given = [F.lit(None).cast("string").alias(name) if c is None else F.col(f"`{c}`").cast("string").alias(name) for name, c in (("path", path_column), ("version", version_column))]
    rows = versions.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), *given, F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    tables = Tables(spark, "secret-scan")
    paths = tables.write(rows.drop("text"), "paths")
    blobs = paths.groupBy("blob").agg(F.count("*").alias("n"))
    seen = ledger_at(spark, ledger).where(F.col("rules") == rules)
    unseen = blobs.join(seen.select("blob"), "blob", "left_anti")
    # Texts that may be unseen are dealt out by content, one of each: equal texts become one before the shuffle.
    maybe, _ = parted(rows.select("blob", "text"), F.xxhash64("blob"), unseen.select(F.xxhash64("blob")))
    todo = maybe.dropDuplicates(["blob"]).join(unseen.select("blob").hint("merge"), "blob", "left_semi")
    small_batches(spark)
    scan_blobs(todo).select("blob", F.lit(rules).alias("rules"), "spans").write.mode("append").parquet(ledger)
    held = ledger_at(spark, ledger).where((F.col("rules") == rules) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    found = join_counted(paths, tables.write(blobs.join(held, "blob"), "hits"), ["blob"], "left")
    return found.select("doc_id", "path", "version", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    found = scan_versions(docs, fresh_dir(docs.sparkSession, "ledger"))

    def said(only: str) -> str:
        return f"array_join(transform(filter(spans, s -> {only}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    base = "s.kind in ('assign', 'access', 'hex')"
    return found.selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}" for k in BASE),
        f"sha2({said(base)}, 256) as base_sha256",
        f"{said('true')} as spans",
        "blob",
    )


# The kinds' patterns as SQL has them: without look-behind, so what stands before a match is taken with it, as group 1.
SQL_PATTERNS = {
    "assign": r"""()(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "()(AKIA[A-Z0-9]+)",
    "hex": "()([0-9a-f]{32,})",
    "pem": "()(-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----)",
    "github": "(^|[^A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9_]{36,})",
    "jwt": r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
}
SQL_TESTS = {"assign": "length(said) >= 8", "access": "length(said) >= 16", "github": "regexp_full_match(said, 'gh[pousr]_[A-Za-z0-9]{36,255}')"}


def oracle() -> str:
    """The same in SQL: places of matches are the lengths of what lies between them and of the matches before."""
    found = " union all ".join(
        f"""select r, {n} as n, '{kind}' as kind, unnest(range(1, len(m) + 1)) as i, m, g1, g2, pieces from (
  select r, regexp_extract_all(text, $re${p}$re$) as m, regexp_extract_all(text, $re${p}$re$, 1) as g1, regexp_extract_all(text, $re${p}$re$, 2) as g2,
    string_split_regex(text, $re${p}$re$) as pieces
  from d where regexp_matches(text, $re${p}$re$))"""
        for n, (kind, p) in enumerate(SQL_PATTERNS.items())
    )
    tests = " ".join(f"when kind = '{kind}' then {test}" for kind, test in SQL_TESTS.items())
    said = "kind || ':' || s || ':' || e"
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as ({found}),
placed as (
  select r, n, kind, g2[i] as said,
    coalesce(list_sum([length(x) for x in pieces[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) + length(g1[i]) as s, length(m[i]) - length(g1[i]) as n_chars
  from found
),
spans as (select r, n, kind, cast(s as bigint) as s, cast(s + n_chars as bigint) as e from placed where case {tests} else true end),
told as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg({said}, ',' order by s, n) filter (kind in ({base})) as base, string_agg({said}, ',' order by s, n) as spans
  from spans group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(text) as blob
from d left join told on told.r = d.r
"""
