"""Token files, vector codes and conversation repair against brute force."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from brute import damaged_rows, repaired_conversation
from pyspark.sql import functions as F

from causeway.llm import ann, common, dialogues, licenses, neardup, quality, tokenfiles, vectorcodes, warc

CONVERSATIONS = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversation_rows(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 8)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Fine.", "So it is!", "why", "é\n", " \t", "", None, "long " * 500 + "end?", "Fine.", "?\x0b "])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn * 3, None]), role, text))
    rows += [(7, 2, "user", "Fine.")] * 5 + [(-(2**63), 2**63 - 1, "user", "a."), (-(2**63), -(2**63) + 5, "assistant", "b.")]
    return rows


def check_conversations(spark, rows):
    # columns of clashing names take no part
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS + ", piece string, `a.b` int, letters string")
    got = {r.conv_id: r for r in dialogues.query(table).collect()}
    want = damaged_rows(rows)
    assert set(got) == set(want)
    for conv, kept in want.items():
        expected = repaired_conversation(kept)
        if abs(expected["gaps"]) < 2**62:
            assert {c: got[conv][c] for c in COLUMNS} == expected, (conv, kept)


def test_conversations_against_a_search_over_all_edits(spark):
    check_conversations(spark, [r for r in conversation_rows() if r[0] is None or r[0] >= 0])


def test_long_conversations_are_chained(spark, monkeypatch):
    """With few letters a whole, nearly all conversations go the long way."""
    monkeypatch.setattr(dialogues, "WHOLE", 3)
    check_conversations(spark, [r for r in conversation_rows(150, 6) if r[0] is None or r[0] >= 0])


def test_one_conversation_of_many_rows(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"{t}.", f"{t}.", "cut", ""])) for t in range(3000)]
    rows += [(1, 3000, "user", "the same.")] * 600 + [(2, 0, "user", "Hello."), (2, 1, "assistant", "Yes.")]
    check_conversations(spark, rows)


def test_no_conversations(spark):
    assert dialogues.query(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: [(vec_id, vector)], all of one length. Codes, errors and codebooks in Python integers."""
    ints = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows]
    w = len(ints[0][1]) // parts
    cut = [(i, [v[p * w : p * w + w] for p in range(parts)]) for i, v in ints]
    first = [c for _, c in sorted((x for x in cut if x[0] is not None), key=lambda x: x[0])[:entries]]
    books = [[c[p] for c in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min((apart(v, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        moved = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, c in cut:
                own[near(c[p], book)[1]].append(c[p])
            moved.append([[sum(x) // len(x) for x in zip(*o, strict=True)] if o else e for o, e in zip(own, book, strict=True)])
        books = moved
    found = [[near(c[p], books[p]) for p in range(parts)] for _, c in cut]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize("dim,wide", [(64, 1.0), (32, 1e6), (16, 1e9), (160, 0.01)])
def test_codes_against_all_distances(spark, dim, wide):
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=dim) * (wide if i % 7 == 0 else 1)]) for i in rng.permutation(300) - 20]
    rows += [(1000 + k, rows[5][1]) for k in range(30)] + [(2000, [0.0] * dim), (None, rows[3][1])]
    odd = [(3000, None), (3001, [*rows[0][1][:-1], None]), (3002, [float("nan")] * dim), (3003, [float("inf")] * dim), (3004, [1.0] * (dim + 16)), (3005, []), (3006, [1e300] * dim)]
    labels = {i: None if k % 5 == 0 else k % 3 for k, (i, _) in enumerate(rows + odd)}
    table = spark.createDataFrame([(i, v, labels[i], "x") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, code string")
    got = {r.vec_id: r for r in vectorcodes.query(table).collect()}
    want, books = brute_codes(rows)
    assert len(got) == len(rows) + 3
    assert all(got[i].code is None and got[i].error is None for i in (3004, 3005, 3006))
    sums = {}
    for (i, _), (code, error) in zip(rows, want, strict=True):
        fits = error < 2**63
        assert (got[i].code, got[i].error) == (code, error if fits else None)
        sums[labels[i]] = sums.get(labels[i], 0) + fits * error
    for i, _ in rows:
        assert got[i].codebooks_sha256 == vectorcodes.digest(books)
        assert got[i].label_error == (sums[labels[i]] if sums[labels[i]] < 2**63 else None)


def test_bounds_rule_out_and_lose_nothing():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 4, 7, 16):
        book = vectorcodes.Codebook(rng.integers(-2000, 2000, (64, width)).tolist())
        x = np.concatenate([rng.integers(-2000, 2000, (500, width)), book.rows, book.rows + 1])
        at, least = book.nearest(x)
        all_ = ((x[:, None] - book.rows[None]) ** 2).sum(2)
        assert (at == all_.argmin(1)).all() and (least == all_.min(1)).all()
        assert width < 2 or book.compared < 0.7 * book.pairs


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectorcodes.query(empty).collect() == []
    one = spark.createDataFrame([(4, [0.5] * 16, None), (4, [0.5] * 16, None)], "vec_id long, embedding array<float>, label int")
    assert {tuple(r)[:4] for r in vectorcodes.query(one).collect()} == {(4, "00" * 16, 0, 0)}


TEXTS = [
    "", None, " ", "  a  b ", "Plain words, it's 42 of them.\nNext line", "tab\tand\r\nends \n\n  x", "é à 中文 🙂\u00a0\u3000\x1c\x85 y", "a<|endoftext|>b <|endoftext|> c",
    "x" * 5000, " " * 3000, "word " * 4000, "\n" * 2000, "don't we'll I'd 's 'S", "İstanbul ﬁne e\u0301",
]


def brute_ids(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenfiles.tokenizer_path())
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def token_rows():
    rng = random.Random(9)
    rows = [(k * 3 - 40, t) for k, t in enumerate(TEXTS * 4)] + [(None, "no id"), (None, None), (-(2**63), "low"), (2**63 - 1, "high")]
    rows += [(11, rng.choice(["same id", "of many texts"])) for _ in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,lanes", [(4096, 2048), (50, 7), (1, 3)])
def test_token_files_against_the_tokenizer(spark, tmp_path, block, lanes):
    rows = token_rows() if block > 1 else [r for r in token_rows() if len(r[1] or "") < 1000][:60]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, head int, spread string")
    out = f"file://{tmp_path}/ids"
    manifest = tokenfiles.write_ids(table, out, tokenfiles.tokenizer_path(), 2, block=block, lanes=lanes)
    got = sorted(map(tuple, tokenfiles.read_ids(manifest, out).collect()), key=lambda r: r[1])
    assert got == brute_ids(rows)
    if block == 4096:
        assert sorted(map(tuple, tokenfiles.query(table).collect()), key=lambda r: r[1]) == got
        assert not list(Path(f"{tmp_path}/ids").glob("_temporary*"))


def test_no_token_files(spark):
    assert tokenfiles.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chunks_are_encoded_as_whole_texts():
    rng = random.Random(1)
    encoder = tokenfiles.encoder(tokenfiles.tokenizer_path())
    assert encoder.known
    parts = [" ", "  ", "\n", "\t", "a", "B", "the", "é", "1", "22", "'s", "'ll", ".", "!?", "<|endoftext|>", "\x1c", "\x85", "\xa0", "\u3000", "中", "🙂", "\r\n", "\x0b", "İ", "ﬁ", "\u0301", "x" * 120]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text) == encoder.plainly(text), repr(text)


def test_texts_are_encoded_together_as_alone():
    """Chunks, marks, line ends and white space side by side in many texts; a chunk goes to the tokenizer with the others, and once."""
    import pyarrow as pa

    rng = random.Random(2)
    encoder = tokenfiles.ChunkEncoder(tokenfiles.tokenizer_path())
    parts = [" ", " ", " ", "  ", "\n", "\t", "a", "B", "the", "é", "1", "22", "'s", "'ll", ".", ",", "!?", "<|endoftext|>", "\x1c", "\x85", "\u3000", "中", "🙂", "\u0301", "x" * 120]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 30))]
        assert list(encoder.encode_all(pa.array(texts))) == list(map(encoder.plainly, texts))
    calls, whole = [], encoder.whole

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return whole.encode(text, **options)

    encoder.whole = Counted()
    texts = [f"first {' '.join(f'word{k % 60}x{k}' for k in range(n, n + 90))}, last" for n in range(0, 60, 10)]
    assert list(encoder.encode_all(pa.array(["odd", *texts]).slice(1))) == [tokenfiles.array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert len(calls) == 1


@pytest.mark.parametrize("vocabulary", [1, 2, 40, 50257, 1 << 20])
def test_range_coder_round_trip(vocabulary):
    """Constant, periodic, random, sparse and extreme ids, in lanes beside each other."""
    rng = np.random.default_rng(vocabulary)
    steps, at = 700, tokenfiles.places(vocabulary)
    top = vocabulary - 1
    lanes = [np.zeros(steps), np.full(steps, top), np.arange(steps) % min(vocabulary, 7), rng.integers(0, vocabulary, steps), (rng.random(steps) < 0.01) * top]
    lanes += [np.minimum(rng.zipf(1.3, steps), vocabulary) - 1, np.where(np.arange(steps) < 350, 0, rng.integers(0, vocabulary, steps)), np.repeat(rng.integers(0, vocabulary, 70), 10)]
    ids = np.array(lanes).astype(np.int64).T
    words, counts = tokenfiles.code(ids, at)
    flat = words[np.arange(words.shape[1])[None] < counts[:, None]]
    assert (tokenfiles.decode(flat, np.cumsum(counts) - counts, steps, at) == ids).all()
    if vocabulary == 50257:
        bits = 32 * counts / steps
        assert bits[0] < 0.3 and bits[2] < 0.5 and bits[7] < 5 and bits[3] < 16.5  # a new id in lane 7 costs two misses in ten


def test_a_class_is_looked_up():
    """The reader's table of the line is what a search of the sums gives."""
    at, rng = tokenfiles.places(50257), np.random.default_rng(5)
    model = tokenfiles.Model(3, at, inverse=True)
    model.learn(at.of[rng.integers(0, 50257, (200, 3))].astype(np.int64))
    sums = model.line[:, : at.classes] >> tokenfiles.MASS
    for lane in range(3):
        want = np.searchsorted(sums[lane], np.arange(1 << tokenfiles.CLASS), side="right") - 1
        assert (model.class_of.reshape(3, -1)[lane] == want).all()


def test_a_changed_byte_is_found(tmp_path):
    from pyarrow import fs

    local = fs.LocalFileSystem()
    file = tokenfiles.Writer(local, str(tmp_path), "f.ids", 1000, 64, 4)
    rng = np.random.default_rng(3)
    for k in range(20):
        file.add(k, rng.integers(0, 1000, 37).astype("<u4").tobytes())
    name, size, docs, ids = file.close()
    path = tmp_path / name
    assert (docs, ids, path.stat().st_size) == (20, 740, size)
    sound = path.read_bytes()
    assert [d for d, *_ in tokenfiles.Reader(local, str(path)).documents()] == list(range(20))
    for at in range(0, size, 23):
        path.write_bytes(sound[:at] + bytes([sound[at] ^ 64]) + sound[at + 1 :])
        try:
            found = list(tokenfiles.Reader(local, str(path)).documents())
        except Exception:  # noqa: BLE001  whatever the reader makes of it, but no other ids
            continue
        path.write_bytes(sound)
        assert found == list(tokenfiles.Reader(local, str(path)).documents()), at


def test_an_id_has_one_vector(spark):
    """Rows of one id with several vectors, on either side, and very many copies of one row: never a list of two of them."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(20, [float(x) for x in rng.normal(size=8)]), (33, [float(x) for x in rng.normal(size=8)]), (40, rows[40][1])]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    copies = spark.range(100_000).select(F.lit(60).cast("long").alias("vec_id"), F.array(*[F.lit(x) for x in rows[60][1]]).alias("embedding"))
    table = few.unionByName(copies)
    least = {}
    for i, v in rows:
        least[i] = min(least.get(i, v), v)
    got = {}
    for r in ann.query(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in least if i % 20 == 0}
    for q, found in got.items():
        score = {i: sum(a * b for a, b in zip(least[q], v, strict=True)) for i, v in least.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [i for _, i, _ in sorted(found)] == want
        assert [s for *_, s in sorted(found)] == pytest.approx([score[i] for i in want])


def test_columns_of_awkward_names(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License. " + "word " * 30), (2, None)], "`a.b` long, `c d` string")
    assert {r.doc_id for r in licenses.scan(docs, "a.b", "c d").collect()} == {1, 2}
    assert neardup.join_similar(docs, "a.b", "c d").count() == 2
    assert quality.judge(docs, spark.createDataFrame([(1,)], "doc_id long"), "a.b", "c d").count() == 2
    manifest = warc.write_archive(docs.withColumn("u.r", F.lit("http://x/")), common.fresh_dir(spark, "names"), "a.b", "u.r", "c d")
    assert manifest.agg(F.sum("records")).first()[0] >= 2


@pytest.mark.parametrize("measure", ["inner", "l2"])
def test_search_loses_nothing_where_codes_fit_badly(spark, measure):
    """Tight clusters, very long vectors, ties and components that floats can't hold, on codebooks of a small sample: as brute force."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4, 24))
    x = np.concatenate([
        centres[rng.integers(0, 4, 2400)] + 0.001 * rng.normal(size=(2400, 24)), rng.normal(size=(800, 24)) * np.exp(2 * rng.normal(size=(800, 1))),
        rng.integers(-1, 2, size=(800, 24)).astype(float),
    ])
    x = x[rng.permutation(len(x))]
    x[7], x[40] = x[7] * 1e60, x[40] * 1e-60
    kept = np.flatnonzero((x != 0).any(1))
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 20 = 0"), k=20, sample=200, measure=measure).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, len(x), 20):
        s = np.zeros(len(x))
        for a, b in zip(x.T, x[q], strict=True):
            s += a * b if measure == "inner" else (b - a) * (a - b)
        order = sorted((k for k in kept.tolist() if k != q), key=lambda k: (-s[k], k))[:20]
        assert got[q] == [(k, s[k]) for k in order]
