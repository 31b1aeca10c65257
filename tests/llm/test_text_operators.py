"""PII, byte-level BPE, token counts, media, WARC and chat formatting against plain versions and round trips."""

import base64
import hashlib
import io
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.llm import bpe, chat, media, pii, queries, tokens, warc
from tallywright.llm._store import materialize, new_path
from tests.compare import spark_rows, sql_rows
from tests.conftest import SF

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "a", "   a   b  ", " \n x", "don't  'S it's\n\n ok   ", "日本語 🙂🙂 é", "aaaa" * 300, "x \x1c y", "foo\n bar\t\tz  ",
    "ab" * 9000, "word " * 5000, "<|endoftext|>",
]


def luhn(d):
    t = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in t) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_pii(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


PII = [
    *ODD, "a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 001.02.3.255 1.2.3.256", "4111 1111-1111 1111 and 4111111111111112", "+1 (555) 010-9999 +49.30.1234567 +1 2",
    "🙂 ip 10.0.0.1, mail me.too+x@ex-ample.co.uk!", "12.34.56.78@host.org 5500-0000-0000-0004", "DE89 3704 0044 0532 0130 00 DE89370400440532013001", "ssn 123-45-6789, order 123-45-6780",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" then', "API-key: abcDEF123_ghi456-JKL789", "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "token abcdefghijklmnopqrstuvwxyz",
    "+" * 5000 + "1" * 5000, "a." * 5000 + "@b" + ".c" * 5000, "1 " * 8000, "9" * 40000, "@" * 3000, "x" * 60000,
]


def test_pii_against_re(spark):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(PII)], "doc_id long, text string, row string")
    rows = pii.find_pii(df).collect()
    assert len(rows) == len(PII) and rows[0]["row"] == "kept"
    for r in rows:
        got = [(s["kind"], s["start"], s["end"]) for s in r["pii"]]
        assert [s for s in got if s[0] in pii.BASE] == plain_pii(r["text"]), (r["text"] or "")[:60]
    by_text = {r["text"]: [s["kind"] for s in r["pii"] if s["kind"] not in pii.BASE] for r in rows}
    assert by_text["DE89 3704 0044 0532 0130 00 DE89370400440532013001"] == ["iban"]
    assert by_text["ssn 123-45-6789, order 123-45-6780"] == ["ssn"]
    assert [by_text[t] for t in PII if "04dbe" in (t or "") or "bcDEF" in (t or "") or "bcdefghijklmno" in (t or "")] == [["secret"], ["secret"], [], []]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="019.@+- ()ab_é\n", max_size=60), min_size=60, max_size=60))
def test_pii_on_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in pii.BASE] == plain_pii(r["text"]), r["text"]


def test_pii_query_and_masking(spark):
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in docs.collect():
        spans = plain_pii(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert got[r["doc_id"]]["n_email"] == sum(k == "email" for k, _, _ in spans)
    plan = pii.mask_pii(pii.find_pii(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    df = spark.createDataFrame([(1, "x 🙂 a@b.co 10.0.0.1@h.com end", 1), (2, None, 2), (3, "clean", 3)], "doc_id long, text string, pii int")
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(pii.find_pii(df)).collect()}
    assert masked == {1: "x 🙂 <EMAIL> <EMAIL> end", 2: None, 3: "clean"}
    assert pii.find_pii(df.where("false")).count() == 0 and pii.mask_pii(pii.find_pii(df, out="own"), pii="own").columns == ["doc_id", "text", "pii"]


def plain_mask(text):
    """The spans' marks from left to right; a span that begins inside an earlier one belongs to its mark."""
    out, at = [], 0
    for a, b, kind in sorted(plain_pii(text) and [(a, -b, k) for k, a, b in plain_pii(text)]):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, -b)
    return "".join(out) + text[at:]


def test_masking_of_many_spans(spark):
    rng = np.random.default_rng(3)
    words = ["a@b.co", "10.0.0.1", "10.0.0.1@h.com", "+49 30 1234567", "4111 1111 1111 1111", "🙂", "plain", "x@y.org z@w.net"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 63, 64, 65, 129, 400, 6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_pii(df)
    for r in found.collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in pii.BASE] == plain_pii(r["text"])
    for r in pii.mask_pii(found).collect():
        assert r["text"] == plain_mask(texts[r["doc_id"]])


def test_bpe_against_tiktoken(spark):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, token_ids string")
    for r in bpe.encode_texts(df, PATH, P.PATTERN, decoded=True).collect():
        t = ODD[r["doc_id"]] or ""
        assert r["token_ids"] == " ".join(map(str, library.encode_ordinary(t)))
        assert bytes(r["decoded"]) == t.encode()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_bpe(spark, SF).collect():
        ids = library.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\tthe1é", max_size=40), max_size=8))
def test_bpe_on_random_texts(texts):
    e = bpe.encoder(PATH, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.replay.ranks, special_tokens={})
    assert e.encode(texts) == [" ".join(map(str, library.encode_ordinary(t))) for t in texts]


def test_bpe_merges_of_lower_rank_come_first():
    """A merge may make a pair of a lower rank than its own: b+b (5) makes a+bb (4), which is due before the next b+b."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"abb": 4, b"bb": 5, b"abbb": 3}
    replay = bpe.MergeReplay(ranks)
    library = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for w in ("abbbb", "abbb", "bbbbb", "abbabb", "babbbba"):
        ids, count = replay.encode([w.encode(), b"", w.encode()])
        want = library.encode_ordinary(w)
        assert ids.tolist() == want * 2 and count.tolist() == [len(want), 0, len(want)], w


def test_token_counts(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "text string")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    n = sorted(len(library.encode_ordinary(t or "")) for t in ODD)
    h = tokens.length_histogram(tokens.token_counts(df, PATH, P.PATTERN))
    for r in h.collect():
        x = r["n_tokens"]
        assert r["n_docs"] == n.count(x) and r["docs_le"] == sum(v <= x for v in n) and r["tokens_gt"] == sum(v for v in n if v > x)
        assert r["truncated_total"] == sum(min(v, x) for v in n) and r["quantile"] == r["docs_le"] / len(n)
    for r in tokens.truncated_at(h, [0, 7, 100, 10**6]).collect():
        x = r["context_limit"]
        assert r["truncated_total"] == sum(min(v, x) for v in n) and r["docs_cut"] == sum(v > x for v in n)
    assert {r["share"]: r["n_tokens"] for r in tokens.length_quantiles(h, [0.5, 1.0]).collect()} == {0.5: n[-(-len(n) // 2) - 1], 1.0: n[-1]}
    assert tokens.length_histogram(tokens.token_counts(df.where("false"), PATH, P.PATTERN)).count() == 0


def test_token_counts_of_clashing_repeated_and_long_rows(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    long = "word " * 60_000 + "x" * 3_000
    rows = [("a b", -1, 5), ("a b", -1, 5), (None, 3, 5), ("", 3, 5), (long, 9, 5)]
    df = spark.createDataFrame(rows, "text string, n_tokens long, n_docs long")
    got = tokens.token_counts(df, PATH, P.PATTERN)
    assert got.columns == ["n_tokens"]
    want = sorted(len(library.encode_ordinary(t or "")) for t, *_ in rows)
    assert sorted(r["n_tokens"] for r in got.collect()) == want
    assert {r["n_tokens"]: r["n_docs"] for r in tokens.length_histogram(got).collect()} == {n: want.count(n) for n in want}
    assert tokens.token_counts(df.where("false"), PATH, P.PATTERN).count() == 0
    assert [tuple(r) for r in tokens.truncated_at(tokens.length_histogram(got.where("false")), [5]).collect()] == [(5, 0, 0, 0, 0)]


def plain_hash(data):
    """The cosine hash by its definition: areas averaged number by number, each frequency a double sum, not scaled."""
    import math
    from fractions import Fraction

    def shrunk(x, size):
        out = []
        for k in range(size):
            a, b = Fraction(k * len(x), size), Fraction((k + 1) * len(x), size)
            total = [Fraction(0)] * len(x[0])
            for i in range(int(a), min(len(x), math.ceil(b))):
                share = min(b, i + 1) - max(a, i)
                total = [t + share * v for t, v in zip(total, x[i])]
            out.append([t / (b - a) for t in total])
        return out

    rows = [list(data[i : i + 64]) for i in range(0, len(data), 64)]
    small = shrunk(rows, 32)
    small = [list(map(float, r)) for r in zip(*shrunk([list(c) for c in zip(*small)], 32))]
    wave = lambda k, i: math.cos(math.pi * (2 * i + 1) * k / 64)
    low = [[round(math.fsum(wave(u, i) * wave(v, j) * small[i][j] for i in range(32) for j in range(32)), 6) for v in range(8)] for u in range(8)]
    flat = [x for r in low for x in r]
    rest = sorted(flat[1:])
    return f"{sum((x > rest[31]) << (63 - k) for k, x in enumerate(flat)):016x}"


def test_media_hash_by_definition(spark):
    texts = ["", "a", "hello world " * 20, "é" * 700, "".join(chr(0xE0 + i * i * 13 % 31) for i in range(700)), "".join(chr(33 + i * i * 7 % 90) for i in range(3_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["feature"] for r in media.media_features(media.media_column(df, "doc_id"), "doc_id").collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        assert got[i] == plain_hash(raw + bytes(-len(raw) % 64 if raw else 64)), t[:20]


def test_media_round_trip(spark):
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(ODD)], "doc_id long, text string, media string")
    stored = media.media_column(df, "doc_id")
    kept = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    rows = media.media_features(stored, "doc_id").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        raw = (ODD[r["doc_id"]] or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(data), zlib.crc32(data[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["media_sha256"] == hashlib.sha256(kept[r["doc_id"]]).hexdigest()
        assert len(r["feature"]) == 16
    assert media.media_features(stored.where("false"), "doc_id").count() == 0
    big = 2**60 + 1
    odd = spark.createDataFrame([(None, "a"), (big, "a"), (big, "a"), (7, None)], "doc_id long, text string").coalesce(1)
    written = materialize(media.media_column(odd, "doc_id"), "media")
    back = media.media_features(written, "doc_id").select("doc_id", "payload_sha256").collect()
    digest = lambda raw: hashlib.sha256(raw + bytes(64 - len(raw))).hexdigest()
    assert sorted(map(tuple, back), key=repr) == sorted([(None, digest(b"a")), (big, digest(b"a")), (big, digest(b"a")), (7, digest(b""))], key=repr)


def test_media_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_media(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.encode_png(np.frombuffer(data, np.uint8).reshape(-1, 64))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(raw), len(data), zlib.crc32(data[-64:]), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        # The stored form is a picture that any reader of the format takes: filters undone by hand.
        lines = np.frombuffer(zlib.decompress(stored[41 : 41 + int.from_bytes(stored[33:37], "big")]), np.uint8).reshape(-1, 65).astype(int)
        above = np.zeros(64, int)
        for y, line in enumerate(lines):
            row = np.cumsum(line[1:]) % 256 if line[0] == 1 else (line[1:] + above * (line[0] == 2)) % 256
            assert bytes(row.astype(np.uint8).tolist()) == data[64 * y : 64 * y + 64]
            above = row
        assert r["feature"] == media.cosine_hash(np.frombuffer(data, np.uint8).reshape(-1, 64))


def test_token_count_query(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    n = [len(library.encode_ordinary(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op8_token_counts(spark, SF).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n))
    for r in rows:
        x = r["n_tokens"]
        assert (r["n_docs"], r["docs_le"], r["tokens_le"]) == (n.count(x), sum(v <= x for v in n), sum(v for v in n if v <= x))
        assert (r["docs_gt"], r["tokens_gt"], r["truncated_total"]) == (sum(v > x for v in n), sum(v for v in n if v > x), sum(min(v, x) for v in n))
        assert r["quantile"] == r["docs_le"] / len(n)


def test_bpe_keeps_rows(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None, "a b", None), (big, "a b", 1), (big, "a b", 1), (7, None, 2**60 + 3)], "doc_id long, text string, rest long").coalesce(1)
    got = bpe.encode_texts(df, PATH, P.PATTERN).collect()
    assert sorted([(r["doc_id"], r["rest"], r["token_ids"] != "") for r in got], key=repr) == sorted([(None, None, True), (big, 1, True), (big, 1, True), (7, 2**60 + 3, False)], key=repr)
    assert bpe.encode_texts(df.where("false"), PATH, P.PATTERN).count() == 0
    assert bpe.encode_texts(df.select("text"), PATH, P.PATTERN).columns == ["token_ids"]


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 1, 2], [2, 2, 1, 4, 3]])
def test_png_filters(filters):
    """Lines filtered one sample at a time come back."""
    x = np.random.default_rng(1).integers(0, 256, (12, 64)).astype(int)
    lines = np.zeros((12, 65), np.uint8)
    for r in range(12):
        kind = filters[r % len(filters)]
        for c in range(64):
            a, b = x[r, c - 1] if c else 0, x[r - 1, c] if r else 0
            d = x[r - 1, c - 1] if r and c else 0
            near = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
            lines[r, c + 1] = (x[r, c] - [0, a, b, (a + b) // 2, near][kind]) % 256
        lines[r, 0] = kind
    assert (media._unfilter(lines) == x).all()


def test_png_checks():
    good = media.encode_png(np.zeros((2, 64), np.uint8))
    for bad in (good[:-3], b"x" + good, good[:40] + bytes([good[40] ^ 1]) + good[41:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    assert media.cosine_hash(np.arange(64 * 70).reshape(70, 64)) != media.cosine_hash(np.arange(64 * 70)[::-1].reshape(70, 64))


PAGES = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70000), (6, "u", "x"), (6, "u", "x"), (7, "u\r\nX: y", "<p>\r\n\r\nWARC/1.1</p>")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, sha string")
    got = sorted(map(tuple, warc.archive_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))).collect()))
    best = {h or "": max(p for p, _, x in PAGES if (x or "") == (h or "")) for _, _, h in PAGES}
    want = []
    for p, _, h in PAGES:
        raw, top = (h or "").encode(), best[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == top else "revisit", -1 if p == top else top))
    assert got == sorted(want)
    assert warc.archive_pages(df.where("false")).count() == 0


def test_warc_without_page_id(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "u", "x"), (None, "u", "x"), (None, None, "y"), (None, None, None)], "page_id long, url string, html string")
    got = warc.archive_pages(df).select("payload_bytes", "page_id", "record_type", "refers_to").collect()
    want = [(0, None, "response", None), (1, None, "response", None), (1, None, "revisit", big), (1, big, "response", None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_warc_keeps_payloads(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("refers_to", F.when(F.col("page_id") == 1, F.lit(6)).cast("long"))
    folder = new_path(spark, "warc")
    paths = [r["path"] for r in warc.write_archives(df, folder, rotate=500).collect()]
    assert len(paths) > 1
    seen = {}
    for p in paths:
        with open(p, "rb") as f:
            for r in warc.read_records(f, payloads=True):
                seen[r["page_id"]] = (r["record_type"], r["payload"])
    assert seen["<urn:page:1>"] == ("revisit", b"") and seen["<urn:page:5>"][1] == ("é" * 70000).encode() and seen["<urn:page:7>"][1] == PAGES[-1][2].encode()


def test_warc_refuses_damage():
    good = warc.encode_record(1, "u", b"payload" * 50, None) + warc.encode_record(2, "u", b"", None)
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(good))] == ["<urn:page:1>", "<urn:page:2>"]
    plain = zlib.decompress(warc.encode_record(1, "u", b"payload", None), 31)
    for a, b in ((b"payload\r\n", b"pAyload\r\n"), (b"Content-Length: 7\r\n", b"Content-Length: 9\r\n"), (b"WARC/1.1", b"HTTP/1.1")):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(z.compress(plain.replace(a, b)) + z.flush())))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(io.BytesIO(good[:-20])))


def test_queries_with_sql(spark):
    q, sql = queries.queries(), queries.oracle_sql()
    for name in ("op1_warc", "op10_chat"):
        assert spark_rows(q[name](spark, SF)) == sql_rows(sql[name], SF), name


HARD = [r"\### Assistant: </turn> ok", "<turn>user\nx</turn>\n", "\\", "\\\\<turn", "a\\\nb", "<\\turn", "", None, "🙂</turn>", "user\n"]


def test_chat_round_trip(spark):
    rows = [(7, i, ["user", "assistant", "role\nwith <turn>", None][i % 4], t) for i, t in enumerate(HARD * 2)] + [(None, 0, "assistant", "z"), (None, 0, "assistant", "z"), (8, None, "user", "n"), (8, 1, "user", "n"), (8, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.best_paths(chat.linear_trees(df)))).collect()}
    assert [(t["role"], t["text"]) for t in back["7"]["turns"]] == [(r or "", t or "") for _, _, r, t in rows[:20]]
    assert back["7"]["loss_texts"] == [t or "" for _, _, r, t in rows[:20] if r == "assistant"]
    assert len(back["8"]["turns"]) == 3 and sorted(back) == ["7", "8", *[k for k in back if k.startswith("null:")]] and [b["loss_texts"] for k, b in back.items() if k.startswith("null:")] == [["z"], ["z"]]
    assert chat.format_paths(chat.best_paths(chat.linear_trees(df.where("false")))).count() == 0


def test_chat_of_many_turns(spark):
    n = 3000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "case when id % 2 = 0 then 'user' else 'assistant' end as role", "concat('t', id, repeat('<turn>', int(id % 3))) as text")
    (r,) = chat.read_back(chat.format_paths(chat.best_paths(chat.linear_trees(df)))).collect()
    want = [f"t{i}" + "<turn>" * (i % 3) for i in range(n)]
    assert [t["text"] for t in r["turns"]] == want and r["loss_texts"] == want[1::2]


def test_reply_trees_rank_branches(spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 9.0), ("t", 5, 2, None), ("u", 1, 99, 0.0)]
    df = spark.createDataFrame([(*n, "user", str(n[1])) for n in nodes], "tree string, node long, parent long, score double, role string, text string")
    paths = {}
    for r in chat.best_paths(df, top=2).orderBy("tree", "branch", "depth").collect():
        paths.setdefault((r["tree"], r["branch"]), []).append(r["text"])
    assert paths == {("t", 1): ["1", "3", "4"], ("t", 2): ["1", "2", "5"], ("u", 1): ["1"]}
    long = spark.range(300).selectExpr("'c' as tree", "id as node", "case when id > 0 then id - 1 end as parent", "0.0D as score", "'user' as role", "string(id) as text")
    assert [r["text"] for r in chat.best_paths(long).orderBy("depth").collect()] == [str(i) for i in range(300)]
    circle = spark.createDataFrame([("c", 1, 2, 0.0, "user", ""), ("c", 2, 1, 0.0, "user", "")], df.schema)
    monkey, chat.STEPS = chat.STEPS, 4
    try:
        with pytest.raises(ValueError, match="circle"):
            chat.best_paths(circle)
    finally:
        chat.STEPS = monkey
