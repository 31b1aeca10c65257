"""Vector codes, URL rules and the filter audit against brute force and SQL."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import codes, filters, queries, urls
from tests.compare import spark_rows, sql_rows
from tests.conftest import SF


@pytest.mark.parametrize("name", ["op11_codes", "op12_urls", "op13_filters"])
def test_queries_with_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(queries.oracle_sql()[name], SF)


def plain_codes(rows, parts, entries, rounds):
    """Codebooks and (id, label, code, error) in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[list(cut(v, p)) for _, v, _ in rows[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in rows:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for k, v, label in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((k, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return books, out


@pytest.mark.parametrize(("width", "spread"), [(4, 3), (4, 400), (6, 40), (8, 1 << 20), (1, 5)])
def test_nearest_entries(width, spread):
    rng = np.random.default_rng(width + spread)
    x, entries = rng.integers(-spread, spread + 1, (700, width)), rng.integers(-spread, spread + 1, (64, width))
    entries[9] = entries[3]
    x[:5] = entries[9]
    far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    code, error, _ = codes.nearest_entries(x, entries)
    assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(4)
    entries = rng.integers(-300, 300, (64, 4))
    x = entries[rng.integers(0, 64, 2000)] + rng.integers(-30, 31, (2000, 4))
    _, error, taken = codes.nearest_entries(x, entries)
    assert (error == ((x[:, None] - entries[None]) ** 2).sum(axis=2).min(axis=1)).all()
    assert taken < 0.1 * 64 * 2000


def test_codes_of_every_kind(spark):
    rng = np.random.default_rng(2)
    vec = lambda: [float(v) for v in rng.normal(size=8)]
    rows = [(i, vec(), i % 3 if i % 7 else None) for i in range(90)]
    rows += [(5, rows[5][1], 2), (None, vec(), 1), (200, [-0.001] * 8, 0)]
    bad = [(300, None, 1), (301, [float("nan")] * 8, 1), (302, [float("inf")] + [0.0] * 7, 1), (303, [None] + [0.0] * 7, 1)]
    odd = [(400, [1.0] * 7, 1), (401, [], None), (402, [1e30] * 8, 1), (403, [1e12] * 8, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad + odd], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got, books = codes.compress(df, parts=4, entries=5, rounds=2)
    plain, want = plain_codes([(k, [int(np.floor(256 * x)) for x in v], label) for k, v, label in rows], 4, 5, 2)
    assert books.tolist() == plain
    total = Counter()
    for _, label, _, error in want:
        total[label] += error
    want = [(*r, total[r[1]]) for r in want] + [(k, label, None, None, total[label]) for k, _, label in odd]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    back = codes.decode(got.where("vec_id = 200"), books).first()["decoded"]
    assert len(back) == 8
    none, books = codes.compress(df.where("false"))
    assert none.count() == 0 and books.size == 0 and len(codes.digest(books)) == 64
    assert codes.compress(df.where("vec_id between 400 and 401"))[0].count() == 2
    few, books = codes.compress(df.where("vec_id = 7"), parts=2)
    assert [r["error"] for r in few.collect()] == [0] and books.shape == (2, 1, 4)


def fits(pattern, url):
    """A rule over a URL, walked character by character."""
    head, sep, tail = (url or "").partition("://")
    if not sep:
        return False
    host = re.match(r"[^/?#]*", tail).group()
    whole = "://" + host.translate(urls._LOWER) + tail[len(host) :]
    text = pattern.removeprefix("||") if pattern.startswith("||") else pattern.removeprefix("|")
    end = text.endswith("|")
    text = text.removesuffix("|")

    def at(i, k):
        if k == len(text):
            return not end or i == len(whole)
        if text[k] == "*":
            return any(at(j, k + 1) for j in range(i, len(whole) + 1))
        if text[k] == "^":
            return (i == len(whole) and at(i, k + 1)) or (i < len(whole) and not re.match(r"[A-Za-z0-9_.%-]", whole[i]) and at(i + 1, k + 1))
        return i < len(whole) and whole[i] == text[k] and at(i + 1, k + 1)

    if pattern.startswith("||"):
        starts = [3, *(j + 1 for j in range(3, 3 + len(host)) if whole[j] == ".")]
    else:
        starts = [0] if pattern.startswith("|") else range(len(whole) + 1)
    return any(at(i, 0) for i in starts)


RULES = [
    ("net/", "||net/", "block", 1), ("example.net/en/", "||example.net/en/", "allow", 1), (None, "||com^", "block", 0), ("r1", "*", "allow", -1),
    ("r2", "/a*b|", "block", 0), ("r3", "?x=1", "block", 0), ("r3", "?x=1", "block", 0), ("r4", "|://start.", None, 0), ("r5", "(a+b)[c]", "block", 2),
    ("r6", "||Upper.org/", "block", 0), ("r7", "e", "block", 0), ("r8", "a|b", "block", 3), ("r9", None, "block", 9), ("r10", "-ads-", "block", None), ("r11", "\\d$", "block", 0),
]
URLS = [
    None, "", "no scheme", "http://", "HTTP://X.NET/", "http://net/", "http://a.net", "http://a.example.net/en/x", "https://a.example.net/enx", "http://com", "http://com:80/", "http://x.com?x=1",
    "http://u/a123b", "http://u/a123b\n", "http://u/a123bc", "ftp://start.u/", "http://u/(a+b)[c]", "http://upper.org/", "http://U.Upper.ORG/p", "http://u/a|b", "http://u/-ads-", "http://u/-ADS-", "http://u/?q=://net/",
    "x://y://z.net/", "http://u/\\d$", "http://ü.net/é", "http://u/\u212a", "http://u/" + "a" * 5000 + "b",
]


@pytest.mark.parametrize("most", [urls.INDEX_RULES, 0])
def test_url_rules(spark, most):
    rules = spark.createDataFrame(RULES, "rule string, pattern string, verdict string, level int")
    pages = spark.createDataFrame([(i if i else None, u, "clash") for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, Rule string")
    got = {(r["page_id"], r["url"]): (r["rule"], r["pattern"], r["verdict"]) for r in urls.judge_urls(pages, rules, most).collect()}
    assert len(got) == len(URLS) + 1
    for (_, u), result in got.items():
        want = [r for r in RULES if r[1] is not None and fits(r[1], u)]
        want = min(want, key=lambda r: (-(r[3] if r[3] is not None else -1e9), -len(r[1]), r[1]), default=(None,) * 4)
        assert result == want[:3], u
    assert urls.judge_urls(pages.where("false"), rules, most).count() == 0
    none = urls.judge_urls(pages, rules.where("false"), most).collect()
    assert len(none) == len(URLS) + 1 and {r["verdict"] for r in none} == {None}


def test_rules_are_found_by_their_rarest_token(spark):
    rules = spark.createDataFrame([("a", "||example.com/rare/", "block", 0), ("b", "/en/x/", "block", 0), ("c", "loose", "block", 0)], "rule string, pattern string, verdict string, level int")
    pages = spark.createDataFrame([(f"http://h{i}.example.com/en/{'x/' if i % 3 else ''}{'rare/' if i == 5 else ''}",) for i in range(30)], "url string")
    got = {r["rule"]: r["token"] for r in urls.index_rules(rules, pages).collect()}
    assert got == {"a": "rare", "b": "x", "c": None}


def plain_audit(docs, labels, fails):
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    rows = []
    for k, t, s in docs:
        mask = {c for c, f in fails.items() if f(t or "")} | ({"E"} if k is not None and k > least[t or ""] else set())
        rows.append((s or "", mask, any(d == k is not None and q == 1 for d, q, _ in labels), any(d == k is not None and x == 1 for d, _, x in labels)))
    out, share = [], Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                gone = [r for r in mine if r[1] & before]
                here = [r for r in mine if not r[1] & before and f in r[1]]
                share[part, f] += len(here)
                counts = len(mine) - len(gone) - len(here), len(here), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)
                out.append((part, "".join(order), step, *counts))
    return sorted((*r, share[r[0], r[1][r[2] - 1]]) for r in out)


FAILS = {"A": lambda t: len(t.encode().split()) < 3, "B": lambda t: 100 * len(set(t.encode().split())) < 50 * len(t.encode().split()), "C": lambda t: 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": lambda t: any(c in "#$%&*|" for c in t)}


def conditions():
    t = F.col("text")
    return {"A": filters.fails_few_words(t, 3), "B": filters.fails_repeated_words(t), "C": filters.fails_capitals(t), "D": filters.fails_symbols(t)}


def test_filter_audit_of_every_kind(spark, monkeypatch):
    texts = ["", None, "a a a a a", "one two three", "ONE two three", "one two # three", "été\tüber  x", "x" * 200_000 + " b c", "  ", "a\u00a0b c d"]
    docs = [(i, texts[i % len(texts)], ["s", "s", None, "t", ""][i % 5]) for i in range(60)]
    docs += [(3, "one two three", "s"), (3, "other text here", "s"), (None, "one two three", "s"), (None, "alone", "u"), (61, "one two three", "t")]
    labels = [(3, 1, 0), (3, 0, 1), (13, 1, None), (23, None, 1), (None, 1, 1), (999, 1, 1), (5, 0, 0)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, source string, __mask int").repartition(7)
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(docs, labels, FAILS)
    assert sorted(map(tuple, filters.audit(d, label, conditions()).collect())) == want
    # Copies are dealt in lots that meet again, and a task gives up what it holds.
    monkeypatch.setattr(filters, "COPIES", 2)
    monkeypatch.setattr(filters, "HELD", 50)
    assert sorted(map(tuple, filters.audit(d, label, conditions()).collect())) == want
    assert filters.audit(d.where("false"), label, conditions()).count() == 0
    assert filters.audit(d.limit(1), label.where("false"), conditions()).count() == 600


def test_equal_fingerprints_of_different_texts():
    rows = [((7, 0), "a", 5, ("p",), 1), ((7, 0), "b", 3, ("p",), 1), ((7, 0), "a", 2, ("q",), 1), ((7, 0), "b", 3, ("r",), 1), ((7, 0), "a", 9, ("p",), 1)]
    got = sorted((lost, r[1], r[2], r[3]) for lost, r in filters._chains(rows))
    assert got == [(False, "a", 2, ("q",)), (False, "b", 3, ("p",)), (False, "b", 3, ("r",)), (True, "a", 5, ("p",)), (True, "a", 9, ("p",))]


def test_copies_of_a_large_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 7000)).alias("text"), (20_000 - F.col("id")).alias("doc_id"))
    got = filters.mark_copies(df).groupBy("copy").agg(F.sum("n").alias("n"))
    texts = df.select("text").distinct().count()
    assert {r["copy"]: r["n"] for r in got.collect()} == {False: texts, True: 20_000 - texts}
