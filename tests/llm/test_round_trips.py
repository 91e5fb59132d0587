"""Whole queries against brute force, and the inputs that break things: long blanks, wide ids, ragged vectors, hot keys."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from brute import jaccard_classes, lines_deleted, quality_counts, words
from test_group_operators import line_rows, vocabulary
from test_text_operators import ODD, docs, pages, plain_secrets, plain_spans

from causeway.llm import ann, common, licenses, linededup, neardup, packing, pii, quality, secrets, sentencepiece, warc


def test_licenses_survive_a_million_blank_lines(spark, tmp_path):
    head = "Released under the MIT License."
    texts = [head + "\n" * 1_000_000 + "end", head + " \t\r\n" * 300_000 + "end", head + " " * 1_000_000 + "end", head + "\n" + " " * 500_000 + "\n" + "x" * 10]
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/docs")
    got = licenses.query(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert {r.doc_id: r.licenses for r in got} == dict.fromkeys(range(4), "MIT")


def test_blank_lines_fold_as_before():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(["a", " ", "\t", "\r", "\n", "\n"]) for _ in range(rng.randint(0, 20)))
        assert re.sub(licenses.BLANKS, "|", text) == re.sub(r"[ \t\r]*\n([ \t\r]*\n)+", "|", text)
        single = re.sub(licenses.BLANKS, "|", text)
        assert re.sub(licenses.BREAK, "_", single) == re.sub(r"[ \t\r]*\n[ \t\r]*", "_", single)


def archive_rows():
    rng = random.Random(3)
    bodies = ["", "same", "é" * 50, *(f"<p>{k}</p>" * rng.randint(1, 60) for k in range(40))]
    rows = [(k * 7 - 100, f"http://h/{k}", rng.choice([*bodies, None])) for k in range(200)]
    return rows + [(-9_000_000_000_000_000_000, "low", "same"), (9_000_000_000_000_000_000, "high", "same"), (9_000_000_000_000_000_001, "top", "only here")]


def test_archive_recomputed(spark):
    """Every digest, length, type and reference, with ids at both ends of 64 bits."""
    rows = archive_rows()
    got = {r.page_id: r for r in warc.query(pages(spark, rows)).collect()}
    first = {}
    for i, _, body in sorted(rows, key=lambda r: r[0]):
        first.setdefault(body or "", i)
    assert len(got) == len(rows)
    for i, url, body in rows:
        data, r = (body or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(data), warc.sha1_base32(data), url)
        own = first[body or ""] == i
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[body or ""]))


def test_shards_follow_the_bytes(spark, tmp_path):
    """A far id does not put all others into one shard; rows without an id have shards of their own."""
    rows = [(k, "u", "x" * 5000 + str(k)) for k in range(300)] + [(9_000_000_000_000_000_000, "far", "y")] + [(None, f"n{k}", "z" * 5000 + str(k)) for k in range(60)]
    out = f"file://{tmp_path}/a"
    manifest = warc.write_archive(pages(spark, rows), out, shard_bytes=100_000).collect()
    shards = defaultdict(int)
    for m in manifest:
        shards[m.file.split("-")[1]] += m.records
    assert sum(shards.values()) == len(rows) and len(shards) > 12 and max(shards.values()) < 60
    numbered = [m for m in manifest if m.first_id is not None]
    spans = sorted((m.first_id, m.last_id) for m in numbered)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(m.first_id is None for m in manifest) > 1


def test_search_leaves_out_other_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(80)] + [(100, [1.0] * 5), (101, []), (102, [1.0] * 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(frame, frame, k=3).collect()
    assert {r.query_id for r in got} == set(range(80)) == {r.query_id for r in got if r.vec_id < 80}
    assert len(got) == 240


@pytest.mark.parametrize("measure", ["inner", "l2"])
def test_recall_over_many_chunks(spark, measure, monkeypatch):
    """Isotropic vectors, the hardest case; several chunks, blocks of queries and parts of the index."""
    monkeypatch.setattr(ann, "PART_CODES", 1500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in ann.search(frame, frame.where("vec_id % 20 = 0"), k=20, measure=measure).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(float)
    hit = 0
    for q, found in got.items():
        s = d @ d[q] if measure == "inner" else -((d - d[q]) ** 2).sum(1)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & {i for i, _ in found})
        assert all(abs(score - s[i]) < 1e-9 for i, score in found)
    assert len(got) == 300 and hit / 6000 >= 0.97


def test_norms_let_chunks_pass():
    rng = np.random.default_rng(1)
    books = ann.learn(rng.normal(size=(500, 8)).astype(np.float32), books=4)
    best = ann.Shortlists(rng.normal(size=(3, 8)), books, 5, "inner")
    codes, norms = ann.encode(rng.normal(size=(50, 8)), books)
    best.add(np.arange(50), codes, norms)
    before = best.ids.copy()
    best.add(np.arange(100, 150), codes, norms * 0)
    assert (best.ids == before).all()


def test_ledger_scans_each_unseen_blob_once(spark, tmp_path, monkeypatch):
    ledger, count = f"file://{tmp_path}/ledger", spark.sparkContext.accumulator(0)
    plain = secrets.scan_blobs

    def counted(blobs):
        def tally(batches):
            for b in batches:
                count.add(b.num_rows)
                yield b

        return plain(blobs.mapInArrow(tally, blobs.schema))

    monkeypatch.setattr(secrets, "scan_blobs", counted)
    rows = docs(spark, [(k, f"token = abcdefgh{k % 2}") for k in range(1000)]).repartition(7)
    assert secrets.scan_versions(rows, ledger).count() == 1000 and count.value == 2
    assert secrets.scan_versions(rows, ledger).count() == 1000 and count.value == 2
    more = docs(spark, [(2000, "token = abcdefgh0"), (2001, "fresh text"), (2002, "fresh text")])
    got = secrets.scan_versions(more, ledger, path_column="spans", version_column="kind").collect()
    assert count.value == 3 and {(r.path, r.version) for r in got} == {("x", "1")}
    # Two runs at once leave a blob twice; it counts once.
    secrets.ledger_at(spark, ledger).write.parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("append").parquet(ledger)
    assert secrets.scan_versions(rows, ledger).count() == 1000 and count.value == 3


def test_secret_query_against_plain_patterns(spark):
    rng = random.Random(7)
    bits = ["password", "secret", "api_key", "=", ":", " ", '"', "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "-", "\n"]
    rows = [*ODD, *((20 + k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for k in range(200))]
    want = Counter()
    for i, t in rows:
        spans = plain_secrets(t or "")
        n = [sum(s.startswith(k) for s in spans) for k in secrets.BASE]
        want[(i, *n, hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    got = secrets.query(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want


def plain_pii(text):
    """All kinds of an independent reading: base spans by plain patterns, account and social security numbers by their rules."""
    out = plain_spans(text)
    near = lambda a, b: set(re.findall("[a-z-]+", (text[max(0, a - 60) : a] + " " + text[b : b + 60]).lower()))
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        bare = m.group().replace(" ", "")
        if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
            out.append(f"iban:{m.start()}:{m.end()}")
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if near(*m.span()) & {"ssn", "social", "security", "insurance"}:
            out.append(f"ssn:{m.start()}:{m.end()}")
    return out


def test_pii_query_against_plain_reading(spark):
    rng = random.Random(8)
    bits = ["a.b@c.de", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (212) 555-0100", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "078-05-1120", " ssn ", " word ", "\n", " é ", "account "]
    rows = [*ODD, *((20 + k, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for k in range(200))]
    want = Counter()
    for i, t in rows:
        spans = plain_pii(t or "")
        base = [s for s in spans if s.split(":")[0] in pii.BASE]
        want[(i, *(sum(s.startswith(k + ":") for s in base) for k in pii.BASE), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans))] += 1
    got = pii.query(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == want


def signed64(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(w):
    return signed64(xxhash.xxh64_intdigest(w.encode(), seed=42))


def pair_hash(a, b):
    first = xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42)
    return signed64(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=first))


def test_ratio_and_verdict_recomputed(spark):
    rng = random.Random(9)
    vocab = vocabulary(rng, 80)
    rows = [*ODD, *((20 + k, " ".join(rng.choice(vocab[: 40 + k % 40]) for _ in range(rng.randint(0, 90)))) for k in range(150))]
    trusted, buckets, prior = set(range(20, 90)), 64, 50.0

    def grams(t):
        h = [spark_hash(w) for w in words(t)]
        return [x % buckets for x in [*h, *(pair_hash(a, b) for a, b in zip(h, h[1:], strict=False))]]

    good, raw = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    total_g, total_r = sum(good.values()), sum(raw.values())
    lr = {b: math.log((good[b] * (total_r / raw[b]) + prior) / (total_g + prior)) for b in raw}
    want = defaultdict(list)
    for i, t in rows:
        g = grams(t)
        ratio = sum(lr[b] for b in g) / len(g) if g else 0.0
        want[i].append((round(ratio, 9), not quality_counts(t)["base_failed"] and ratio >= -0.02))
    got = defaultdict(list)
    frame = docs(spark, rows)
    for r in quality.judge(frame, spark.createDataFrame([(k,) for k in trusted], "doc_id long"), buckets=buckets, prior=prior, threshold=-0.02).collect():
        got[r.doc_id].append((round(r.ratio, 9), r.kept))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert 10 < sum(k for v in got.values() for _, k in v) < len(rows) - 10
    plan = quality.judge(frame, spark.createDataFrame([(20,)], "doc_id long")).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(lambda") <= 4 or plan.index("Filter") < plan.index("Generate")


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup_text_that_is_left(spark, seed):
    """Not only how many lines go: which ones."""
    rows = [(i, t) for i, t in line_rows(seed) if i is not None]
    rows = list({i: t for i, t in rows}.items())
    gone = lines_deleted(rows)
    for r in linededup.deduplicated(docs(spark, rows)).collect():
        text = dict(rows)[r.doc_id]
        before = [x.strip() for x in (text or "").split("\n") if words(x)]
        after = [x.strip() for x in (r.text or "").split("\n") if words(x)]
        assert len(before) - len(after) == r.n_deleted == gone[r.doc_id, text or ""]
        it = iter(before)
        assert all(x in it for x in after)  # in order, none made up
        assert r.n_chars == len(r.text or "") if r.n_deleted else True


def test_line_dedup_with_a_hot_passage(spark, monkeypatch):
    """Half of all documents share a passage, and one line is everywhere: hot keys go their own way to the same result."""
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    rng = random.Random(5)
    vocab = vocabulary(rng, 200)
    passage = "\n".join(" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(3))
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(20)) + "\nfollow us\n" + (passage if k % 2 else "own line " + str(k))) for k in range(60)]
    want = lines_deleted(rows)
    got = {r.doc_id: r.n_deleted for r in linededup.deduplicated(docs(spark, rows)).collect()}
    assert got == {i: want[i, t] for i, t in rows} and sum(got.values()) == 29 * 4


def test_near_duplicates_with_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(6)
    vocab = vocabulary(rng)
    base = [rng.choice(vocab) for _ in range(80)]
    rows = [(k, " ".join(base)) for k in range(30)] + [(30 + k, " ".join([*base[:-1], f"end{k}"])) for k in range(10)] + [(100 + k, " ".join(rng.choice(vocab) for _ in range(50))) for k in range(20)]
    parent, links, _ = jaccard_classes(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.join_similar(docs(spark, rows)).collect()}
    assert got == {i: (rows[parent[k]][0], links[k]) for k, (i, _) in enumerate(rows)}
    assert {r.doc_id for r in neardup.one_of_each(docs(spark, rows)).collect()} == {0, *range(100, 120)}


def test_recall_close_to_the_threshold(spark):
    """Pairs at 0.80 to 0.83, in buckets of many leaders: none is lost."""
    rng = random.Random(10)
    vocab = vocabulary(rng, 3000)
    rows = []
    for k in range(150):
        base = [rng.choice(vocab) for _ in range(300)]
        other = list(base)
        cut = rng.randint(26, 31)  # words replaced at the end: so many shingles less on either side
        other[-cut:] = [rng.choice(vocab) for _ in range(cut)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    parent, links, _ = jaccard_classes(rows)
    assert sum(links) > 200
    got = {r.doc_id: r.n_links for r in neardup.join_similar(docs(spark, rows)).collect()}
    assert [got[k] for k in range(300)] == links
    assert neardup.lost_pair() < 2e-5


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHINGLES", 500)
    rng = random.Random(11)
    vocab = vocabulary(rng)
    base = [rng.choice(vocab) for _ in range(300)]
    rows = [(k, " ".join([*base, f"tail{k}"])) for k in range(12)]
    parent, links, _ = jaccard_classes(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.join_similar(docs(spark, rows)).collect()}
    assert got == {k: (rows[parent[k]][0], links[k]) for k in range(12)}


def test_class_counts_are_fixed(spark):
    """Every full bin of a class holds pieces of its one length, floor(2048 / length) of them."""
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 3000)))) for k in range(150)]
    bins = defaultdict(list)
    for r in packing.query(docs(spark, rows)).collect():
        bins[r.sequence_id].append(r)
    full = [b for b in bins.values() if b[0].class_count]
    assert len(full) > 20
    for b in full:
        assert len({r.length for r in b}) == 1 and len(b) == b[0].class_count == 2048 // b[0].length
        assert b[0].sequence_tokens == sum(r.length for r in b)


def test_another_tokenizer_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, other = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert not mine.known and packing.WordEncoder(packing.tokenizer_path()).known
    for text in ("Two  words,\nit's é", "", "x" * 100):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_sentencepiece_query_against_the_library(spark):
    import sentencepiece as library

    other = library.SentencePieceProcessor(model_file=sentencepiece.model_path())
    rng = random.Random(13)
    letters = "abcde THE\n\té漢字ü.,😀"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for k in range(120)]
    got = {r.doc_id: r for r in sentencepiece.query(docs(spark, rows)).collect()}
    for i, t in rows:
        ids = other.encode(t)
        assert (got[i].n_ids, got[i].n_byte_ids, got[i].ids_crc32) == (len(ids), sum(other.is_byte(x) for x in ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_bitmap_and_counted_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    large = spark.createDataFrame([(k % 7 if k < 90 else k, k) for k in range(100)] + [(None, 1000)], "k long, v long")
    small = large.where("k is not null and k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    for how in ("inner", "left"):
        got = sorted((r.v, r.least) for r in common.join_counted(large, small, ["k"], how).collect())
        want = sorted((r.v, r.least) for r in large.join(small, "k", how).collect())
        assert Counter(got) == Counter(want)
    maybe, rest = common.parted(large.where("k is not null"), F.col("k"), small.select("k"))
    assert {r.k for r in small.collect()} <= {r.k for r in maybe.collect()} and maybe.count() + rest.count() == 100


def test_session_settings_are_only_lowered(spark):
    rows, parts = common.ARROW_ROWS, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(rows, "300")
    pii.query(docs(spark, ODD)).collect()
    warc.query(pages(spark, [(1, "u", "x")])).collect()
    assert spark.conf.get(rows) == "300" and spark.conf.get("spark.sql.shuffle.partitions") == parts
    spark.conf.set(rows, "10000")
    neardup.query(docs(spark, ODD)).collect()
    assert spark.conf.get(rows) == "10000"
    linededup.query(docs(spark, ODD)).collect()
    assert spark.conf.get(rows) == str(common.BATCH_ROWS)


def test_runs_leave_only_what_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    rows = [(k, "a b c d e f g h " * 10 + str(k)) for k in range(20)]
    neardup.query(docs(spark, rows)).collect()
    linededup.query(docs(spark, rows)).collect()
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.glob("shared/*/*"))
    assert left == ["cuts", "facts", "signatures"]
