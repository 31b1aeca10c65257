"""Cover tree, MinHash, toxicity, packing and the pipeline against brute force."""

import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallywright.llm import covertree, minhash, packing, queries, toxicity
from tallywright.llm._components import connected_components
from tallywright.llm._words import NOT_ALNUM, word_hashes
from tests.compare import spark_rows, sql_rows
from tests.conftest import SF

WORD = P.path("word_bpe_49k.json")


def test_queries_with_sql(spark):
    q, sql = queries.queries(), queries.oracle_sql()
    for name in ("op3_covertree", "op6_minhash"):
        assert spark_rows(q[name](spark, SF)) == sql_rows(sql[name], SF), name


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (102, 100)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.05, 0.3])
def test_tree_pairs_are_exact(spread):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = np.vstack([c + spread * rng.normal(size=(60, 16)) for c in centers] + [rng.normal(size=(80, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    w = rng.integers(1, 4, len(x))
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    links, root, _ = covertree.links_within(x, None, w, w[:0], 0.93)
    assert (links == near @ w).all()
    cut = 300
    links, root, _ = covertree.links_within(x[:cut], x[cut:], w[:cut], w[cut:], 0.93)
    near[:cut, :cut] = near[cut:, cut:] = False
    assert (links == near @ w).all()
    for i, j in zip(*np.nonzero(near), strict=True):
        assert root[i] == root[j]


def test_vectors_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, [float(v) for v in base + 0.1 * rng.normal(size=8)], i % 2) for i in range(40)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [nan] * 8, 1), (103, [inf] + [1.0] * 7, 1), (104, [None] + [1.0] * 7, 1), (105, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(200 + i, rows[1][1], 1) for i in range(5)] + [(300, [2 * v for v in rows[1][1]], 1), (301, [1.0, 2.0], 1), (301, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, cell int")
    got = sorted(map(tuple, covertree.near_vectors(df, cell=7).collect()), key=repr)
    good = [(k, np.array(e) / np.linalg.norm(e), c) for k, e, c in rows if k is not None and k not in range(100, 106)]
    find = {k: k for k, _, _ in good}
    links = [0] * len(good)
    for i, (ki, ei, ci) in enumerate(good):
        for j, (kj, ej, cj) in enumerate(good):
            if i != j and ci == cj and len(ei) == len(ej) and ei @ ej >= 0.93:
                links[i] += 1
                low = min(find[ki], find[kj])
                find = {k: low if v in (find[ki], find[kj]) else v for k, v in find.items()}
    want = [(k, n, find[k], find[k] == k) for (k, _, _), n in zip(good, links, strict=True)]
    want += [(k, 0, k, True) for k in range(100, 106)] + [(None, 0, None, True)]
    assert got == sorted(want, key=repr)
    assert covertree.near_vectors(df.where("false")).count() == 0


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def plain_groups(rows):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    find = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low = min(find[a], find[b])
                find = {k: low if v in (find[a], find[b]) else v for k, v in find.items()}
    return {k: (len(sets[k]), find[k]) for k in sets}


def test_near_duplicates_of_every_size(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one\vTWO"), (5, "one two three four five"), (6, "ONE two\tthree  four five"), (7, "é É"), (8, "é É")]
    k = 10
    for size in (6, 8, 9, 12, 13, 16, 17, 20, 24, 40, 120, 900):
        for _ in range(4):
            text = [vocabulary[i] for i in rng.integers(0, 3000, size)]
            for edits in (0, 0, 1, 1, 2, 3, max(1, size // 60), max(1, size // 40)):
                copy = list(text)
                for at in rng.integers(0, size, edits):
                    copy[at] = vocabulary[rng.integers(0, 3000)]
                rows.append((k, " ".join(copy)))
                k += 1
    passage = [vocabulary[i] for i in rng.integers(0, 3000, 60)]
    for _ in range(60):
        rows.append((k, " ".join(passage + [vocabulary[i] for i in rng.integers(0, 3000, int(rng.integers(5, 40)))])))
        k += 1
    want = plain_groups(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == want
    monkeypatch.setattr(minhash, "BLOCK", 8)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == want
    # All buckets through the rarest shingles.
    monkeypatch.setattr(minhash, "MOST_BLOCKS", 0)
    monkeypatch.setattr(minhash, "MOST_OTHERS", 0)
    monkeypatch.setattr(minhash, "FREQUENT", 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == want


def test_documents_alike_without_linking_are_not_compared(spark, monkeypatch):
    """A template of 76 shingles and 13 to 25 of one's own: similarities of 0.60 to 0.745, with a few copies among them."""
    rng = np.random.default_rng(8)
    n = 20_000
    template = " ".join(f"t{i}" for i in range(80))
    own = rng.integers(13, 26, n)
    own[own == 13] = 14
    rows = [(i, template + " " + " ".join(f"u{i}x{j}" for j in range(own[i]))) for i in range(n)]
    rows += [(n + i, rows[i * 100][1] + " more words") for i in range(30)]
    compared = []

    def counted(members, sizes, made=minhash._dealt):
        out = made(members, sizes)
        groups = out.groupBy("key", "lo", "hi").agg(F.count_if(F.col("own") == F.col("lo")).alias("a"), F.count_if(F.col("own") != F.col("lo")).alias("b"))
        inside, across = F.col("a") * (F.col("a") - 1) / 2, F.col("a") * F.col("b")
        compared.append(groups.agg(F.coalesce(F.sum(F.when(F.col("lo") == F.col("hi"), inside).otherwise(across)), F.lit(0.0))).first()[0])
        return out

    monkeypatch.setattr(minhash, "_dealt", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert found == {i: i if i < n else (i - n) * 100 for i in range(n + 30)}
    # All pairs of a band's bucket would be over 10 million, for each of 40 bands.
    assert sum(compared) < 20 * n, compared


def test_one_id_with_different_texts(spark):
    one, two, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (5, one), (5, two), (6, two), (7, other), (7, two + " x"), (8, other), (9, "z " + other), (3, "p q"), (3, "r s"), (2, "r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(i, 1, i == 1) for i in (1, 5, 6, 7, 8, 9)} | {(3, 2, False), (2, 2, True)}


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=repr)
    assert minhash.near_duplicates(df.where("false")).count() == 0
    big = 2**60 + 1
    df = spark.createDataFrame([(None, "x y"), (big, "a b c d e"), (big + 1, "a b c d e"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 1, None, True), (big, 1, big, True), (big + 1, 1, big, False), (big + 2, 0, big + 2, True)], key=repr)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.75, 0.95):
        a = rng.integers(0, 2**64, 4000, np.uint64)
        b = np.concatenate([a[: int(4000 * share)], rng.integers(0, 2**64, 4000 - int(4000 * share), np.uint64)])
        regs = minhash.registers(np.concatenate([a, b]), np.repeat([0, 1], 4000), 2)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(minhash.similarity_of(regs[0], regs[1])[0] - true) < 0.15


def test_toxicity_holds_out_and_separates(spark):
    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in rows["doc_id"]]).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    both = rows.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    clean, toxic = held[held["toxic"] == 0], held[held["toxic"] == 1]
    assert clean["predicted"].mean() <= 0.05
    wins = (toxic["score"].to_numpy()[:, None] > clean["score"].to_numpy()[None]).mean()
    assert wins >= 0.75  # some 300 labelled texts to learn from; 0.96 with ten times as many


def test_toxicity_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, ("you idiot clown " if i % 2 else "a calm word ") + f"x{i}") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    run = lambda t: sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, t)).collect()))
    first = run(labels)
    assert first == run(turned) and [p for _, _, p in first] == [i % 2 for i in range(300)]


def test_toxicity_odd_input(spark):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, "w " * 30000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert [r["predicted"] for r in toxicity.score(docs, None).collect()] == [0] * 4
    model = toxicity.fit(spark.createDataFrame([(i, "bad" if i % 2 else "good") for i in range(40)], "doc_id long, text string"), spark.range(40).selectExpr("id as doc_id", "int(id % 2) as toxic"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0 and toxicity.fit(docs.where("false"), none) is None
    clash = docs.selectExpr("doc_id", "text", "1 as score", "2 as predicted", "3 as toxic", "4 as calibrate")
    assert sorted(map(str, toxicity.score(clash, model).collect())) == sorted(map(str, toxicity.score(docs, model).collect()))


def plain_model(texts, labels):
    """Both Kneser-Ney models of texts in dictionaries, words and stems as bytes: (v, w) -> P(w | v) of the ordinary and the toxic one."""
    import re
    from collections import Counter

    stem = lambda w, k: (w[:k], len(w) >= k)
    n = [Counter(), Counter()]
    for t, c in zip(texts, labels):
        w = [x.encode() for x in re.findall(r"[^\W_]+", t.lower())]
        n[c].update(set(zip([None, *w], w)))
    pairs = n[0] + n[1]
    history = [Counter(), Counter(), Counter()]
    for c in (0, 1):
        for (v, w), k in n[c].items():
            history[c][v] += k
    history[2] = history[0] + history[1]
    paths = lambda w: [("root",), ("short", stem(w, 4)), ("long", stem(w, 6)), ("word", w)]
    follows, own = Counter(), [Counter(), Counter()]
    for v, w in pairs:
        for node in paths(w):
            follows[node] += 1
            for c in (0, 1):
                own[c][node] += n[c][v, w]
    parent = {b: a for _, w in pairs for a, b in zip(paths(w), paths(w)[1:])}
    known = {x for x in parent if follows[x] > 1}
    share = {x: (follows[x] - 0.75) / follows[parent[x]] for x in known}

    def lean(x, c):
        up, k = parent[x], own[0][x] + own[1][x]
        return (own[c][x] + 1) / (k * own[c][up] / (own[0][up] + own[1][up]) + 1)

    rest = lambda up: 1 - sum(share[x] for x in known if parent[x] == up)
    whole = lambda up, c: rest(up) + sum(share[x] * lean(x, c) for x in known if parent[x] == up)

    def word(w):
        q, f = 1.0, [1.0, 1.0]
        for up, x in zip(paths(w), paths(w)[1:]):
            if x not in known:
                return q * rest(up), [f[c] / whole(up, c) for c in (0, 1)]
            q, f = q * share[x], [f[c] * lean(x, c) / whole(up, c) for c in (0, 1)]
        return q, f

    def probability(v, w):
        q, f = word(w)
        seen = [(x, k) for (h, x), k in pairs.items() if h == v and k > 1]
        if not seen:
            return [q * f[0], q * f[1]]
        total = history[2][v]
        left = 1 - sum(k - 0.75 for _, k in seen) / total
        out = []
        for c in (0, 1):
            against = toxicity.PAIR_BACKOFF
            tilt = {x: (n[c][v, x] + against * word(x)[1][c]) / (k * history[c][v] / total + against) for x, k in seen}
            z = left + sum((k - 0.75) / total * tilt[x] for x, k in seen)
            out.append((sum((k - 0.75) / total * tilt[x] for x, k in seen if x == w) + left * q * f[c]) / z)
        return out

    return probability


def _hashed(words):
    w, _, *stems = word_hashes([x.encode() for x in words], NOT_ALNUM, toxicity.STEMS)
    return w, *stems


def test_toxicity_models_against_dictionaries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = ["a", "idiot", "idiotic", "idiots", "moronic", "morons", "scum", "loser", *[f"word{i}" for i in range(12)], *["thought", "through", "throne"]]
    texts = [" ".join(rng.choice(vocabulary[8 * (i % 3 > 0) :], rng.integers(1, 9))) for i in range(120)]
    labels = [int(i % 3 == 0) for i in range(120)]
    monkeypatch.setattr(toxicity, "sample_labels", lambda t, per_class: t.withColumn("calibrate", F.lit(False)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    plain = plain_model(texts, labels)
    before = [None, "a", "idiot", "word3", "through", "unheard"]
    asked = [(v, w) for v in before for w in [*vocabulary, "idio", "idiotx", "throttle", "new"]]
    hash_of = lambda v: np.uint64(0) if v is None else _hashed([v])[0][0]
    got = toxicity.likelihoods(model, _hashed([w for _, w in asked]), np.array([hash_of(v) for v, _ in asked], np.uint64))
    want = np.array([plain(v and v.encode(), w.encode()) for v, w in asked])
    assert np.allclose(got, want, rtol=1e-9)
    # All known words, one unknown word of each stem and one of none: each history sums to 1 in both classes.
    words, long, short = ([np.uint64(k) for k in level.keys] for level in model.levels)
    stems = {int(w): (s6, s4) for w, s6, s4 in zip(*_hashed(vocabulary))}
    short_of = {int(s6): s4 for s6, s4 in stems.values()}
    events = [(w, *stems[int(w)]) for w in words] + [(np.uint64(1), s6, short_of[int(s6)]) for s6 in long] + [(np.uint64(1), np.uint64(2), s4) for s4 in short] + [(np.uint64(1), np.uint64(2), np.uint64(3))]
    for v in before:
        p = toxicity.likelihoods(model, tuple(np.array(x, np.uint64) for x in zip(*events)), np.full(len(events), hash_of(v)))
        assert np.allclose(p.sum(axis=0), 1) and (p > 0).all()


def test_toxicity_of_short_and_dense_texts(spark):
    rng = np.random.default_rng(4)
    plain, insults = [f"word{i}" for i in range(60)], ["idiot", "moron", "scum", "loser", "clown"]
    text = lambda toxic: " ".join([*rng.choice(plain, 30), *(rng.choice(insults, 6) if toxic else rng.choice(plain, 6))])
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(400)], "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    short = ["idiot", "idiot idiot idiot", "moron scum", "Word1 scum loser", "loser clown idiot scum", "word2 idiot moron scum clown", "idiot moron loser clown scum", " ".join(rng.choice(insults, 300))]
    asked = spark.createDataFrame(list(enumerate(["", *plain[:5], *short])), "doc_id int, text string")
    got = [r["score"] for r in toxicity.score(asked, model).orderBy("doc_id").collect()]
    assert min(got[6:]) >= 0.5 > max(got[:6])


def test_toxicity_curve_never_falls():
    rng = np.random.default_rng(6)
    root = np.concatenate([rng.normal(0, 1, 60), rng.normal(1.5, 1, 60)])
    x = np.column_stack([root / 10 + np.concatenate([rng.normal(0.2, 0.1, 60), rng.normal(-0.2, 0.1, 60)]), root])
    curve = toxicity._curve(x, np.repeat([0.0, 1.0], 60), np.ones(120))
    assert curve[0] == 0 and curve[1] > 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_fills_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = [np.minimum(rng.lognormal(5, 1.3, 2000).astype(int) + 1, 4096), rng.integers(1300, 2700, 600), np.full(50, 2049), np.array([4096, 1])][seed]
    bins = packing.pack(lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert max(lengths[b].sum() for b in bins) <= 4096
    least = -(-int(lengths.sum()) // 4096)
    assert len(bins) <= [least + 1, least * 1.03, 50, 2][seed]


def fewest(lengths, limit):
    """The fewest bins, by trying every place for each length."""
    best = len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + lengths[i] <= limit and fills[k] not in fills[:k]:
                place(i + 1, [*fills[:k], fills[k] + lengths[i], *fills[k + 1 :]])
        place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize(
    "lengths",
    [
        [19, 19, 13, 13, 8, 7, 6, 6, 5, 2],
        [19, 14, 14, 11, 10, 7, 6, 5, 4, 4, 3],
        [19, 13, 12, 6, 5, 5, 5, 5, 4, 2, 2],
        [13, 12, 12, 6, 6, 6, 6, 5, 4, 3, 3],
        [19, 19, 14, 8, 8, 7, 6, 6, 6, 3, 2],
    ],
)
def test_exchanges_empty_a_bin(lengths):
    """Best fit alone takes one bin more than needed; exchanges empty it."""
    lengths = np.array(lengths)
    best = fewest(lengths.tolist(), 20)
    assert len(packing.pack(lengths, 20, search=False)) == best + 1
    bins = packing.pack(lengths, 20)
    assert len(bins) == best and sorted(i for b in bins for i in b) == list(range(len(lengths)))


def test_exchanges_on_random_lengths():
    rng = np.random.default_rng(9)
    more = fewer = 0
    for _ in range(150):
        lengths = rng.integers(1, 20, rng.integers(0, 9))
        bins = packing.pack(lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 20 for b in bins)
        best = fewest(lengths.tolist(), 20) if len(lengths) else 0
        assert best <= len(bins) <= len(packing.pack(lengths, 20, search=False))
        more += len(bins) > best
    assert more <= 3
    for n in (300, 900):
        lengths = rng.integers(1000, 1500, n)
        fewer += len(packing.pack(lengths, 4096, search=False)) - len(packing.pack(lengths, 4096))
    assert fewer > 0


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.encode_special_tokens = True
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes())) for i in range(0, len(ids), 4096)]
        assert sorted(pieces[k]) == want
    for x in places.values():
        x.sort()
        assert x[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= 4096
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 4096) + 2
    assert pieces.keys() == texts.keys()


def test_packing_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(queries.op9_packing(spark, SF).collect(), texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbdeElLrRsStTvmIiİßéÉŁłŉ'’0159²½ªº.,<|>-_\x01\x1c \t\u0301ſµ", max_size=30), max_size=6))
def test_word_ids_are_the_library_s(texts):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.encode_special_tokens = True
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.tokenizer(WORD).encode(texts) == want


def test_word_ranks_agree_with_the_merges(tmp_path):
    assert len(packing.read_ranks(WORD)) == 49406
    with open(WORD, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(told), encoding="utf-8")
    assert packing.read_ranks(str(tmp_path / "other.json")) is None


def test_packing_keeps_ids(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "a b"), (None, "c"), (big, "a b"), (7, None)], "doc_id long, text string").coalesce(1)
    got = packing.pack_pieces(packing.cut_pieces(df, WORD)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 2), (7, 1), (big, 3), (big, 3)] and len({r["offset"] for r in got}) == 4


def test_packing_odd_texts(spark):
    texts = dict(enumerate([None, "", "İ é é <|endoftext|>", "a\x1cb \x85c　d", "x" * 30000, "tok " * 9000, "ÀB's 12 3"]))
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, length int")
    check_packing(packing.pack_pieces(packing.cut_pieces(df, WORD)).collect(), texts)
    assert packing.pack_pieces(packing.cut_pieces(df.where("false"), WORD)).count() == 0


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, toxic), (_, near), (_, personal), _ = corpus_pipeline.STAGES
    kept = toxic(spark, docs, SF).collect()
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert {r["doc_id"] for r in kept} == {k for k, p in scores.items() if not p}
    rows = [(r["doc_id"], r["text"]) for r in kept]
    left = {k for k, (_, c) in plain_groups(rows).items() if k == c}
    once = near(spark, spark.createDataFrame(kept, docs.schema), SF)
    assert {r["doc_id"] for r in once.collect()} == left and once.columns == docs.columns
    masked = {r["doc_id"]: r for r in personal(spark, once, SF).collect()}
    from tests.llm.test_text_operators import plain_pii

    texts = dict(rows)
    for k in left:
        spans = plain_pii(texts[k])
        assert all(texts[k][a:b] not in masked[k]["text"] for kind, a, b in spans if kind == "email")
        assert spans or masked[k]["text"] == texts[k] or any(f"<{kind}>" in masked[k]["text"] for kind in ("SSN", "IBAN", "SECRET"))
        assert masked[k]["n_chars"] == len(masked[k]["text"])
    check_packing(corpus_pipeline.run(spark, SF).collect(), {k: r["text"] for k, r in masked.items()})


def test_pipeline_loses_no_text(spark, tmp_path):
    """Texts under one id, and a very long text with a near copy, through every stage."""
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    long = " ".join(f"word{i % 5000}x{i % 7}" for i in range(40_000))
    rows = [(1, one), (5, one), (5, two), (6, two), (7, two), (10, long + " mail a@b.co"), (11, long), (12, long + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
    left = sorted((r["doc_id"], r["text"]) for r in table.collect())
    assert left == [(1, one), (5, one), (5, two), (6, two), (10, long + " mail <EMAIL>")]
    packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
    ids = len(Tokenizer.from_file(WORD).encode(left[-1][1], add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in packed if r["doc_id"] == 10) == ids > 20 * 4096


def test_models_beyond_the_bound_pass_the_least_evidence_on(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 1200)
    few = toxicity.fit(docs, labels)
    rows = lambda m: sum(len(x.keys) for x in (*m.levels, m.pairs, m.histories))
    assert rows(few) <= 1200 < rows(whole)
    known = few.levels[0].keys
    total = few.unknown[0] + sum(x.shared.sum() for x in few.levels)
    assert abs(total - 1) < 1e-9 and len(known)
    for c in (0, 1):
        assert abs(few.unknown[0] * few.unknown[1 + c] + sum((x.shared * x.by_class[:, c]).sum() for x in few.levels) - 1) < 1e-9
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, few).collect())


def test_vectors_in_many_cells(spark, monkeypatch):
    """Pivots, pairs of cells and parts that only hashes deal give what comparing all pairs does."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    x = np.vstack([base[i % 30] + 0.15 * rng.normal(size=8) for i in range(420)])
    labels = [0 if i % 3 else 1 + i % 4 for i in range(420)]
    df = spark.createDataFrame([(i, [float(v) for v in r], k) for i, (r, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(near, False)
    for numbers in (8_000_000, 300, 0):
        monkeypatch.setattr(covertree, "PIVOT_NUMBERS", numbers)
        monkeypatch.setattr(covertree, "PIVOTS", 6)
        got = {r["vec_id"]: r["n_links"] for r in covertree.near_vectors(df, cell=20).collect()}
        assert got == dict(enumerate(near.sum(axis=1).tolist())), numbers


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table go through all stages."""
    big = 2**60 + 1
    rows = [(None, "mail a@b.co now", "en", "s", 3), (big, None, None, None, None), (big + 1, "", "en", "s", 0), (7, "same text of six words here", "en", "s", 1), (7, "same text of six words here", "en", "s", 1), (8, "Same text of six words here", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "own", 5, 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, pii string, component int, score double")
    spark.createDataFrame([(7, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, str(tmp_path))
            assert table.columns == docs.columns, name
        left = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"], r["pii"]) for r in table.collect()), key=repr)
        if left:
            assert left == sorted([(0, "mail <EMAIL> now", 16, "own"), (big, None, None, "own"), (big + 1, "", 0, "own"), (7, rows[3][1], 27, "own"), (7, rows[3][1], 27, "own")], key=repr)
        packed = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
        assert sorted(r["doc_id"] or 0 for r in packed) == ([0, 7, 7, big, big + 1] if left else [])
