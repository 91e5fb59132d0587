"""Packing, personal data, secrets, licences, SentencePiece, WARC: brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from brute import quality_counts

from causeway.llm import licenses, packing, pii, quality, secrets, sentencepiece, warc

SCHEMA = "doc_id long, text string, spans string, kind int, n_chars long, words string, _tx int, n_lines string"


def docs(spark, rows):
    """Rows (id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, len(t or ""), "w", 7, "n") for i, t in rows], SCHEMA)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "No id here, mail a.b@c.de now and then some more words to read."), (4, "word " * 30_000), (4, "word " * 30_000), (5, "é漢字 😀 ▁ x"),
]


def test_pack_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(3)
    rows = [*ODD, *((10 + k, "".join(rng.choice("abcd THE. ,'s9é\n\t\x1c") for _ in range(rng.randint(1, 4000)))) for k in range(60)), (99, "<|endoftext|> it's")]
    got = packing.query(docs(spark, rows)).collect()
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in rows]
    assert sum(r.length for r in got) == sum(map(len, ids))
    known = {(i, len(x)): np.array(x, "<u4") for (i, _), x in zip(rows, ids, strict=True)}
    bins = {}
    for r in got:
        piece = known[r.doc_id, r.doc_tokens][r.start : r.start + r.length]
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert len(bins) * 2048 - sum(map(len, ids)) < 0.05 * sum(map(len, ids)) + 4096


def test_cuts_cover_and_fit_classes():
    for total in [1, 31, 32, 33, 1000, 1366, 2047, 2048, 2049, 100_000]:
        parts = packing.cuts(total, 2048)
        assert sum(parts) == total
        assert all(p <= packing.SHORT or p == 2048 // (2048 // p) for p in parts)


def test_pack_of_nothing(spark):
    assert packing.query(docs(spark, [])).count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, r in BASE.items():
        for m in r.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]
            if ok():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_against_plain_patterns():
    rng = random.Random(5)
    bits = ["@", ".", "a", "b.c", "x@y.z", "1.2.3.4", "300.1.1.1", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "12", "(", ")", "+1 (212) 555-0100", "é", "\n", "9" * 9]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        mine = [f"{k}:{a}:{b}" for k, a, b, _ in pii.find_spans(text) if k in pii.BASE]
        assert mine == plain_spans(text), text


def test_pii_is_linear_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "-" * 300_000, "@" * 100_000, "AB12 " * 60_000):
        pii.find_spans(text)


def test_pii_checksums_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32")
    assert not pii.mod97("GB82 WEST 1234 5698 7654 33")
    kinds = [s[0] for s in pii.find_spans("transfer to account GB82 WEST 1234 5698 7654 32 please")]
    assert "iban" in kinds
    assert [s[0] for s in pii.find_spans("her ssn is 078-05-1120")] == ["ssn"]
    assert pii.find_spans("part 078-05-1120") == []
    near, far = pii.find_spans("email me: a@b.cd")[0][3], pii.find_spans("xx yy: a@b.cd")[0][3]
    assert near > far


def test_pii_query_and_redaction(spark):
    rows = [*ODD, (6, "card 4111 1111 1111 1111, a@b.cd, a@b.cd")]
    got = pii.query(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    six = next(r for r in got if r.doc_id == 6)
    assert (six.n_email, six.n_card) == (2, 1)
    assert six.base_sha256 == hashlib.sha256(",".join(plain_spans(rows[-1][1])).encode()).hexdigest()
    clean = pii.redacted(docs(spark, rows))
    assert clean.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    texts = {(r.doc_id, r.n_chars): r.text for r in clean.collect()}
    assert texts[6, len("card [CARD], [EMAIL], [EMAIL]")] == "card [CARD], [EMAIL], [EMAIL]"
    assert texts[1, 0] is None and texts[2, 0] == ""
    assert pii.query(docs(spark, [])).count() == 0


PLAIN_SECRETS = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain_secrets(text):
    out = []
    for n, (kind, r) in enumerate(PLAIN_SECRETS.items()):
        for m in r.finditer(text):
            if {"assign": lambda: len(m.group(2)) >= 8, "access": lambda: len(m.group()) >= 16, "hex": lambda: len(m.group()) >= 32}[kind]():
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_secrets_against_plain_patterns():
    rng = random.Random(6)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "-", "ſecret", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert [f"{k}:{a}:{b}" for k, a, b in secrets.scan_text(text) if k in secrets.BASE] == plain_secrets(text), text


def test_secret_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = docs(spark, [*ODD, (7, "token = abcdefgh12"), (8, "token = abcdefgh12"), (None, "token = abcdefgh12")])
    got = secrets.scan_versions(first, ledger).collect()
    assert len(got) == len(ODD) + 3
    assert sum(len(r.spans) for r in got) == 3
    held = secrets.ledger_at(spark, ledger)
    n = held.count()
    assert n == held.select("blob").distinct().count() == len({t or "" for _, t in ODD}) + 1
    assert len(secrets.scan_versions(first, ledger).collect()) == len(got)
    assert secrets.ledger_at(spark, ledger).count() == n
    secrets.scan_versions(docs(spark, [(1, "new text")]), ledger).collect()
    assert secrets.ledger_at(spark, ledger).count() == n + 1
    secrets.scan_versions(first, ledger, rules=2).collect()
    assert secrets.ledger_at(spark, ledger).where("rules = 2").count() == n
    assert secrets.query(docs(spark, [])).count() == 0


def test_known_sentences_hold_an_anchor():
    assert all(re.search(licenses.ANCHOR, s) for s in licenses.KNOWN)


def test_licenses(spark):
    mit = licenses.RULES["MIT"][3]
    wrapped = "The MIT License\n\nCopyright (c) me\n\n" + mit[0].replace(" the ", "\nthe ") + "\n\n" + mit[1].replace(" and ", "\nand ")
    bsd = licenses.RULES["BSD-3-Clause"][0]
    rows = [*ODD, (10, "Some text.\nReleased under the MIT License."), (11, wrapped), (12, "\n".join(bsd[:3])), (13, "\n".join(bsd)), (14, "\n".join(reversed(bsd))), (15, f"{bsd[0]}\nUnknown one. {bsd[1]} {bsd[2]}"), (16, bsd[0])]
    got = {r.doc_id: r for r in licenses.query(docs(spark, rows)).collect()}
    assert [got[k].licenses for k in range(10, 17)] == ["MIT", "MIT", "BSD-2-Clause", "BSD-2-Clause,BSD-3-Clause", "", "BSD-2-Clause", ""]
    assert got[16].n_known == 1 and got[1].licenses == ""
    assert licenses.query(docs(spark, [])).count() == 0


def test_license_plan_has_no_python(spark):
    plan = licenses.query(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_transducer_equals_the_library():
    import sentencepiece as library

    mine, other = sentencepiece.Transducer(sentencepiece.model_path()), library.SentencePieceProcessor(model_file=sentencepiece.model_path())
    rng = random.Random(1)
    letters = "abcdehilnorst   THE\n\té漢字ü.,-_(){}01239▁\x00😀ааб"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        ids = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert ids == other.encode(text), text
        if "▁" not in text:
            assert mine.decode(ids) == text


def test_sentencepiece_query(spark):
    got = sentencepiece.query(docs(spark, ODD)).collect()
    want = sorted((-1 if i is None else i, hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for i, t in ODD)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.decoded_sha256) for r in got) == want
    tokens = sentencepiece.encode(docs(spark, ODD), sentencepiece.model_path())
    back = sentencepiece.decode(tokens, sentencepiece.model_path())
    assert {r.text for r in back.collect()} == {(t or "").replace("▁", " ") for _, t in ODD}
    assert sentencepiece.query(docs(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 2) for r in rows], "page_id long, url string, html string, payload string, shard int")


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/\nb", "same"), (1, None, "same"), (2, "http://c", None), (5, "u", ""), (9, "v", "é" * 100_000), (9, "v", "é" * 100_000), (None, "n", "alone"), (7, "w", "x\r\n\r\ny")]
    out = f"file://{tmp_path}/a"
    manifest = warc.write_archive(pages(spark, rows), out, shard_bytes=1000, roll_bytes=500)
    got = {(r.page_id, r.record_type): r for r in warc.read_archive(manifest, out, payloads=True).collect()}
    assert {(k[0], k[1], r.refers_to) for k, r in got.items()} == {(1, "response", None), (3, "revisit", 1), (2, "response", None), (5, "revisit", 2), (9, "response", None), (9, "revisit", 9), (None, "response", None), (7, "response", None)}
    assert got[9, "revisit"].payload_digest == warc.sha1_base32(("é" * 100_000).encode()) and got[9, "revisit"].payload_bytes == 200_000
    assert got[7, "response"].payload == b"x\r\n\r\ny"
    assert manifest.count() > 3
    again = f"file://{tmp_path}/b"
    other = warc.write_archive(pages(spark, list(reversed(rows))).repartition(5), again, shard_bytes=1000, roll_bytes=500)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, other.collect()))
    assert not list(tmp_path.glob("*/_temporary*"))
    kept = warc.write_archive(pages(spark, rows), f"file://{tmp_path}/c", min_bytes=5)
    assert {r.page_id for r in warc.read_archive(kept, f"file://{tmp_path}/c").where("record_type = 'revisit'").collect()} == {9}
    assert warc.query(pages(spark, [])).count() == 0


def test_quality_counts(spark):
    rng = random.Random(2)
    rows = [*ODD, *((20 + k, "".join(rng.choice(["a ", "b ", "c\n", "d ", "# ", "é|x ", "a b c d e "]) for _ in range(rng.randint(0, 60)))) for k in range(200))]
    trusted = spark.createDataFrame([(20,), (21,), (None,)], "doc_id long")
    frame = docs(spark, rows)
    got = quality.judge(frame, trusted).collect()
    assert len(got) == len(rows)
    known = {}
    for i, t in rows:
        known.setdefault(i, []).append(quality_counts(t))
    for r in got:
        assert {k: r[k] for k in known[r.doc_id][0]} in known[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs(spark, []), trusted).count() == 0
    assert quality.judge(frame, trusted.limit(0)).count() == len(rows)
    plan = quality.judge(frame, trusted)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(4)
    good, bad = [f"word{k}" for k in range(30)], [f"{k}!!!" for k in range(30)]
    prose = [" ".join(rng.choice(good) for _ in range(60)) for _ in range(200)]
    junk = [" ".join(rng.choice(bad) for _ in range(60)) for _ in range(40)]
    frame = docs(spark, list(enumerate(prose + junk)))
    trusted = spark.range(0, 100).toDF("doc_id")
    kept = {r.doc_id for r in quality.judge(frame, trusted, prior=1000.0).where("kept").collect()}
    assert set(range(100, 200)) <= kept and not kept & set(range(200, 240))


@pytest.mark.parametrize("n", [1, 7])
def test_partition_count_does_not_matter(spark, n):
    rows = [(k, f"mail{k}@x.org and word {k}") for k in range(30)]
    a = pii.query(docs(spark, rows).repartition(n)).orderBy("doc_id").collect()
    assert [r.n_email for r in a] == [1] * 30
