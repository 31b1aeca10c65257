"""Small frames for the rules that recur: ties, dates, relations, bands, votes, sessions."""

import datetime
import gzip
import itertools
import math
import re
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.functions import clean
from tallywright.operators.evidence import edge_table, policy_rows, reject_counts, with_earliest
from tallywright.operators.decide import bool_like, reasons, vote
from tallywright.operators.fuse import bayesian_or, reciprocal_rank_fusion
from tallywright.operators import pareto
from tallywright.operators.log import with_sessions
from tallywright.operators.rank import average_rank, band_rerank, global_ranks, global_row_numbers, largest_remainder, top_per_group
from tallywright.operators.calibrate import fit_platt, mcnemar_p, strict_improvement, wilcoxon
from tallywright.operators.similar import bits_set, cosine_matrix, jaccard_of, pack_signs, tanimoto, tanimoto_matrix, word_shingles
from tallywright.plans import ranks, scans, scores
from tallywright.shipping import ship
from tallywright.sources.files import read_any, read_csv, read_fasta, read_reports, read_workbook, read_zip_tsv, scratch
from tallywright.sources.sinks import read_verified, write_verified
from tallywright.sources.tables import find_column, read, with_optional


def values(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_tied_ranks(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5), ("d", None)], "id string, score double")
    got = {r["id"]: (r["rank_min"], r["rank_avg"], r["rank_dense"]) for r in global_ranks(df, "score").collect()}
    assert got == {"a": (1, 1.0, 1), "b": (2, 2.5, 2), "c": (2, 2.5, 2), "d": (None, None, None)}
    up = {r["id"]: r["rank_avg"] for r in global_ranks(df, "score", descending=False).collect()}
    assert up == {"a": 3.0, "b": 1.5, "c": 1.5, "d": None}
    assert global_ranks(df.where("false"), "score").count() == 0


def test_ranks_over_many_values(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("v"))
    top = global_ranks(df, "v").where("v >= 998").select("v", "rank_min", "rank_avg", "rank_dense", "n_values", "k_values").distinct()
    assert sorted(map(tuple, top.collect())) == [(998, 6, 8.0, 2, 5000, 1000), (999, 1, 3.0, 1, 5000, 1000)]


def test_row_numbers_over_a_frequent_value(spark):
    rows = [(i, None if i % 50 == 0 else 7 if i % 3 else i % 11) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    for down in (True, False):
        order = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if down else r[1]) if r[1] is not None else 0, r[0]))
        assert values(global_row_numbers(df, "v", "id", down).orderBy("rank"), "id", "v", "rank") == [(*r, i + 1) for i, r in enumerate(order)]
    assert global_row_numbers(df.where("false"), "v", "id").count() == 0


def test_no_task_numbers_a_table(spark):
    """Row numbers without a partition are those of at most 200 rows."""
    for query, n in ((ranks.derive_rank_fallback, 0), (scores.rank_compare_methods, 0), (scans.explorer_filter_sort, 1)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"row_number\(\) windowspecdefinition\([^,]*(?:ASC|DESC)", plan)) == n


def test_dominance_counts_in_blocks(spark):
    rows = [(i, None if i % 97 == 0 else "hot" if i % 3 else "small", None if i % 89 == 0 else i * 7 % 5, math.nan if i % 41 == 0 else float(i * 13 % 17), i * 31 % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, u long, v double, w int")
    key = lambda r: (r[2], math.inf if math.isnan(r[3]) else r[3], r[4])
    beats = lambda a, b: a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]) and key(a) != key(b) and all(x >= y for x, y in zip(key(a), key(b)))
    want = [(r[0], sum(beats(o, r) for o in rows), sum(beats(r, o) for o in rows)) for r in rows]
    block = pareto.BLOCK
    try:
        for pareto.BLOCK in (block, 16):
            got = pareto.dominance_counts(ship(spark) and df, "g", ["u", "v", "w"])
            assert sorted(values(got, "id", "n_dominating", "n_dominated")) == want
    finally:
        pareto.BLOCK = block
    assert "collect_list" not in ranks.pareto_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_grouped_average_rank(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 2), (2, 9)], "g int, v int")
    assert sorted(values(df.withColumn("r", average_rank(["g"], "v")), "g", "v", "r")) == [(1, 2, 3.0), (1, 5, 1.5), (1, 5, 1.5), (2, 9, 1.0)]


def test_top_per_group(spark):
    df = spark.createDataFrame([(1, i % 3, i) for i in range(9)], "g int, v int, id int")
    assert sorted(values(top_per_group(df, ["g"], [F.desc("v"), "id"], 2), "id", "rank")) == [(2, 1), (5, 2)]


def test_fusion_of_four_lists(spark):
    lists = {"a": ["T1", "T2", "T3"], "b": ["T2", "T1", "T2"], "c": ["T1", "T4"], "d": ["T3"]}
    rows = [(s, t, i + 1) for s, ts in lists.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "s string, t string, r int")
    got = {r["t"]: (r["rrf"], r["n_sources"]) for r in reciprocal_rank_fusion(df, "t", "s", "r").collect()}
    assert got["T1"] == (round(2 / 61 + 1 / 62, 9), 3)
    assert got["T2"] == (round(1 / 62 + 1 / 61, 9), 2)
    assert got["T4"] == (round(1 / 62, 9), 1)
    with pytest.raises(ValueError, match="positive"):
        reciprocal_rank_fusion(df, "t", "s", "r", weights={"a": 0.0})


def test_band_rerank(spark):
    df = spark.createDataFrame([(i, i, -3.0 - 0.05 * i, None) for i in range(1, 61)], "id int, rank int, e double, n double")
    got = dict(values(band_rerank(df, "rank", [("e", False), ("n", True)], 10, 50), "id", "new_rank"))
    assert sorted(got.values()) == list(range(1, 61))
    assert all(got[i] == i for i in [*range(1, 11), *range(51, 61)])
    assert got[50] == 11 and got[11] == 50
    same = dict(values(band_rerank(df, "rank", [("n", True)], 10, 50), "id", "new_rank"))
    assert all(k == v for k, v in same.items())


def test_votes(spark):
    rows = [(i, *c) for i, c in enumerate(itertools.product([None, False, True], repeat=3))]
    df = spark.createDataFrame(rows, "id int, a boolean, b boolean, c boolean")
    for r in df.withColumn("v", vote(F.col("a"), F.col("b"), F.col("c"))).collect():
        known = [x for x in (r["a"], r["b"], r["c"]) if x is not None]
        assert r["v"] == ("FLAG_HIGH" if not known else "HALT" if sum(known) >= 2 else "FLAG_HIGH" if sum(known) else "PASS")


def test_dates(spark):
    text = ["2020-01-05", "2020/01/05", "01/05/2020", "05-Jan-2020", "2020", "2020-02", " ", "junk", None]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    day = datetime.date(2020, 1, 5)
    assert values(df, clean.parse_date(F.col("t"))) == [(day,)] * 4 + [(datetime.date(2020, 12, 31),), (datetime.date(2020, 2, 29),), (None,), (None,), (None,)]


def test_relations(spark):
    df = spark.createDataFrame([(t,) for t in ("<=1,200.5", ">5e3", "~10", "0", "-1", "abc", "7")], "t string")
    got = values(df, clean.relation_of(F.col("t")), clean.number_of(F.col("t")))
    assert got == [("<=", 1200.5), (">", 5000.0), ("~", 10.0), ("=", None), (None, None), (None, None), ("=", 7.0)]


def test_cleaning(spark):
    df = spark.createDataFrame([("a; NA,b|null; ;C", "k: 1.5; junk;m:2", "=1", "https://www.X.org/a/?q#z", "ﬁ  Ｘ")], "l string, m string, s string, u string, n string")
    got = df.select(clean.split_clean(F.col("l")), clean.key_values(F.col("m")), clean.spreadsheet_safe(F.col("s")), clean.normal_url(F.col("u")), clean.compatible_text(F.col("n"))).first()
    assert list(got) == [["A", "B", "C"], {"k": 1.5, "m": 2.0}, "'=1", "x.org/a", "fi x"]


def test_bool_like(spark):
    df = spark.createDataFrame([(None,), (" ",), ("No",), ("T",), ("1",)], "t string")
    assert values(df, bool_like(F.col("t"))) == [(False,), (False,), (False,), (True,), (True,)]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "t string").select(bool_like(F.col("t"))).collect()


def test_reasons_keep_their_order(spark):
    assert spark.range(1).select(reasons(b=F.lit(True), a=F.lit(True), c=F.lit(None).cast("boolean"))).first()[0] == ["b", "a"]


def test_sessions(spark):
    t0 = datetime.datetime(2024, 1, 1)
    at = list(itertools.accumulate([0, 119, 120, 121]))
    df = spark.createDataFrame([(1, t0 + datetime.timedelta(seconds=s), i) for i, s in enumerate(at)], "u int, ts timestamp_ntz, id int")
    assert sorted(values(with_sessions(df, "u", "ts", ["ts", "id"], 120), "id", "session")) == [(0, 1), (1, 1), (2, 1), (3, 2)]


def test_allocation(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "l string, n bigint")
    assert dict(values(largest_remainder(df, "l", "n", 4), "l", "n_taken")) == {"a": 2, "b": 1, "c": 1}
    assert dict(values(largest_remainder(df, "l", "n", 99), "l", "n_taken")) == {"a": 5, "b": 3, "c": 2}


def test_priors(spark):
    df = spark.createDataFrame([("x", 0.5), ("x", 0.5), ("y", 1.0), ("y", 0.2)], "k string, p double")
    assert dict(values(df.groupBy("k").agg(F.round(bayesian_or(F.col("p")), 9).alias("p")), "k", "p")) == {"x": 0.75, "y": 1.0}


def test_bits_and_sets(spark):
    df = spark.createDataFrame([([1.0, -1.0, 2.0],)], "e array<float>")
    assert df.select(pack_signs(F.col("e"))).first()[0] == [0b101]
    words = lambda *w: F.array(*[F.lit(v).cast("long") for v in w])
    assert spark.range(1).select(tanimoto(words(0b101, 1), words(0b111)), tanimoto(words(0), words(0))).first()[:] == (2 / 4, 0.0)
    wide = [1.0 if i in (0, 63, 64, 130) else -1.0 for i in range(131)]
    got = spark.createDataFrame([(wide,), ([],)], "e array<double>").select(pack_signs(F.col("e")), bits_set(pack_signs(F.col("e")))).collect()
    assert [tuple(r) for r in got] == [([1 - 2**63, 1, 4], 4), ([0], 0)]
    a = word_shingles(spark.createDataFrame([(1, "a b c d e f"), (2, "x"), (3, None)], "a int, t string"), "a", "t")
    b = word_shingles(spark.createDataFrame([(9, "A b c d e")], "b int, t string"), "b", "t")
    assert values(jaccard_of(a, b, "a", "b"), "a", "b", "jaccard", "covered") == [(1, 9, 0.5, 0.5)]
    assert values(jaccard_of(a, b, "a", "b", most=0), "a", "b", "jaccard", "covered") == [(1, 9, 0.5, 0.5)]


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    (tmp_path / "x.fa").write_text(">s1 more\nACG\nT\n>s2\nGG\n")
    (tmp_path / "x.tsv").write_text("a\tb\n1\tx\n")
    assert values(read_csv(spark, str(tmp_path / "x.csv"), "a int, b string", ["a", "b"])) == [(1, "x")]
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, str(tmp_path / "x.csv"), "a int, c string", ["a", "c"])
    assert sorted(values(read_fasta(spark, str(tmp_path / "x.fa")))) == [("s1", "ACGT"), ("s2", "GG")]
    assert read_any(spark, str(tmp_path / "x.tsv")).columns == ["a", "b"]
    df = with_optional(spark.createDataFrame([(1,)], "Key int"), extra="double")
    assert df.columns == ["Key", "extra"] and find_column(df, "no", "KEY") == "Key"
    with pytest.raises(ValueError, match="lacks nothing_like_it"):
        read(spark, "/root/testdata/sf0.001", "nation", "nothing_like_it")


def test_streams_agree_with_batch(spark, tmp_path):
    from tallywright.streaming.sessions import hourly_counts, read_events, session_counts, without_repeats

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = read_events(spark, str(tmp_path / "in"), events.schema)
    for name, f in (("sessions", session_counts), ("hours", hourly_counts)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(events).collect()))
    q = without_repeats(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "once")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.count()


def test_platt_fit(spark):
    rng = np.random.default_rng(5)
    s = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * s - 1)))).astype(int)
    w = rng.integers(1, 4, 400).astype(float)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), w.tolist())), "s double, y int, w double")
    r = fit_platt(df, "s", "y", "w").first()
    loss = lambda a, b: np.average(np.logaddexp(0, a * s + b) - y * (a * s + b), weights=w) + 1e-6 * a * a
    best = loss(r["slope"], r["intercept"])
    assert all(best <= loss(r["slope"] + i * 1e-3, r["intercept"] + j * 1e-3) for i in (-1, 0, 1) for j in (-1, 0, 1))
    assert (r["n_rows"], r["weight_sum"]) == (400, w.sum()) and abs(r["weighted_prevalence"] - np.average(y, weights=w)) < 1e-12
    against = fit_platt(df.withColumn("y", 1 - F.col("y")), "s", "y").first()
    assert against["slope"] == 0 and abs(against["intercept"] - math.log(against["weighted_prevalence"] / (1 - against["weighted_prevalence"]))) < 1e-6
    for bad in (df.where("y = 1"), df.where("false"), df.withColumn("s", F.lit(math.nan)), df.withColumn("w", F.lit(0.0)), df.withColumn("y", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            fit_platt(bad, "s", "y", "w")


def test_reports_from_xml(spark, tmp_path):
    def load(*texts):
        folder = tmp_path / uuid.uuid4().hex
        folder.mkdir()
        for i, text in enumerate(texts):
            (folder / f"{i}.xml").write_text(f"<reports>{text}</reports>")
        return sorted(map(tuple, read_reports(spark, str(folder), "report", "_target", "site").collect()))

    report = lambda key, *sites: f"<report target='{key}'>" + "".join(f"<site>{s}</site>" for s in sites) + "</report>"
    assert load(report("a", 3, 1) + report("empty"), report("b", 10)) == [("a", [1, 3]), ("b", [10])]
    for texts, why in (((report("a", 1), report("a", 2)), "more than one report"), ((report("a", 1, 1),), "repeated"), ((report("a", "x"),), "whole number"), (("<report><site>1</site></report>",), "no key")):
        with pytest.raises(Exception, match=why):
            load(*texts)


def test_wilcoxon_p(spark):
    rng = np.random.default_rng(2)
    for n, shift in ((0, 0), (3, 1), (40, 0), (200, 3)):
        a, b = rng.integers(0, 9, n) + shift, rng.integers(0, 9, n)
        d = [int(x) for x in a - b if x]
        size = sorted(abs(x) for x in d)
        rank = {v: (size.index(v) + 1 + size.index(v) + size.count(v)) / 2 for v in set(size)}
        plus, minus = (sum(rank[abs(x)] for x in d if x * sign > 0) for sign in (1, -1))
        got = wilcoxon(spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double"), "a", "b").first()
        assert (got["n"], got["w_plus"], got["w_minus"], got["reliable"]) == (len(d), plus, minus, len(d) >= 20)
        if d:
            z = max(0, abs(min(plus, minus) - len(d) * (len(d) + 1) / 4) - 0.5) / math.sqrt(sum(rank[abs(x)] ** 2 for x in d) / 4)
            assert got["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-12)
        else:
            assert got["p_value"] is None and got["statistic"] is None
    with pytest.raises(Exception, match="finite"):
        wilcoxon(spark.createDataFrame([(1.0, float("nan"))], "a double, b double"), "a", "b").collect()


def test_strict_improvement(spark):
    row = dict(base_x=0.5, new_x=0.6, base_y=0.3, new_y=0.2)
    ask = lambda **k: tuple(strict_improvement(spark.createDataFrame([{**row, **k}], "base_x double, new_x double, base_y double, new_y double"), ["x"], ["y"]).first())
    assert ask() == (pytest.approx(0.2), True, [])
    assert ask(new_y=0.3)[1:] == (False, ["y"]) and ask(new_x=0.1, new_y=0.4)[1:] == (False, ["x", "y"])
    assert ask(new_x=None) == (None, False, ["x"])


def test_mcnemar_of_many_pairs(spark):
    """The bounded sum agrees with the whole one where both can be made, and with the normal curve far beyond."""
    from tallywright.operators import calibrate

    pairs = [(6000, 6100), (5500, 7000), (9000, 9000), (5200, 5300)]
    df = spark.createDataFrame(pairs, "b long, c long")
    most = calibrate.EXACT_TERMS
    few = [r[0] for r in df.select(mcnemar_p(F.col("b"), F.col("c"))).collect()]
    try:
        calibrate.EXACT_TERMS = 10**6
        whole = [r[0] for r in df.select(mcnemar_p(F.col("b"), F.col("c"))).collect()]
    finally:
        calibrate.EXACT_TERMS = most
    assert few == pytest.approx(whole, rel=1e-9)
    b, c = 500_000_000, 500_040_000
    got = spark.createDataFrame([(b, c)], "b long, c long").select(mcnemar_p(F.col("b"), F.col("c"))).first()[0]
    assert got == pytest.approx(math.erfc((c - b - 1) / math.sqrt(b + c) / math.sqrt(2)), rel=1e-3)


def test_mcnemar_p(spark):
    pairs = [(0, 0), (1, 0), (5, 1), (3, 12), (40, 40), (700, 600), (0, 9)]
    got = values(spark.createDataFrame(pairs, "b long, c long").select("b", "c", mcnemar_p(F.col("b"), F.col("c"))))
    for b, c, p in got:
        want = min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
        assert abs(p - want) < 1e-9, (b, c)


def test_units(spark):
    rows = [(10.0, "nM"), (1.0, " \u00b5M"), (1.0, "\u03bcm"), (2.0, "M"), (0.0, "nM"), (1.0, "ug/ml"), (1.0, None), (math.nan, "nM"), (1e30, "mM")]
    got = values(spark.createDataFrame(rows, "v double, u string").select(F.round(clean.p_activity(F.col("v"), F.col("u")), 6), clean.nanomolar_only(F.col("v"), F.col("u"))))
    assert [p for p, _ in got] == [8.0, 6.0, 6.0, None, None, None, None, None, None]
    assert [n for _, n in got[:4]] == [10.0, None, None, None]


def test_verified_sink(spark):
    path = f"{scratch(spark)}/verified-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "a", 2.5), (1, "a", 2.5), (2, None, None)], "k long, s string, v double")
    told = write_verified(df, path, ["s"], {"from": "test"})
    assert told["rows"] == 3 and told["splits"] == [{"s": None, "rows": 1}, {"s": "a", "rows": 2}]
    assert sorted(values(read_verified(spark, path)), key=repr) == sorted(values(df), key=repr)
    with pytest.raises(ValueError):
        write_verified(df, path)
    df.limit(1).drop("s").write.mode("append").parquet(path + "/s=a")
    with pytest.raises(ValueError, match="manifest"):
        read_verified(spark, path)


def test_zip_and_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.tsv", "id\tother\ttext\n1\t-\t" + "y" * 200_000 + "\n2\t-\t\n3\n")
        z.writestr("note.md", "ignored")
    rows = values(read_zip_tsv(spark, str(tmp_path / "a.zip"), ["text", "id"]))
    assert sorted(rows, key=lambda r: r[1]) == [("y" * 200_000, "1"), (None, "2"), (None, "3")]
    with pytest.raises(Exception, match="lacks nope"):
        read_zip_tsv(spark, str(tmp_path / "a.zip"), ["nope"]).count()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>4.5</v></c><c r="AA3" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>')
    got = values(read_workbook(spark, str(tmp_path / "b.xlsx")))
    assert got == [(1, ["name", None, "two runs"]), (3, [None, "4.5", *[None] * 24, "far"])]


def test_gzip_ids_are_read_as_a_stream(spark, tmp_path):
    (tmp_path / "cid.tsv.gz").write_bytes(gzip.compress(b"".join(b"%d\tC%d\n" % (i, i) for i in range(1000))))
    df = spark.read.csv(str(tmp_path / "cid.tsv.gz"), schema="id long, s string", sep="\t")
    assert values(df.join(F.broadcast(spark.createDataFrame([(7,), (5000,)], "id long")), "id", "left_semi")) == [(7, "C7")]


def test_cluster_assignment(spark):
    """Each row's cluster is the nearest of the clusters' centres, and each cluster has its closest row as medoid."""
    from tallywright.plans import similarity

    rows = {r["vec_id"]: r for r in similarity.kmeans_assign(spark, "/root/testdata/sf0.001").collect()}
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    assert rows.keys() == x.keys()
    names = sorted({r["cluster"] for r in rows.values()})
    members = {c: [k for k in rows if rows[k]["cluster"] == c] for c in names}
    # Lloyd's rounds end at centres that are the means of what they hold.
    centre = np.array([np.mean([x[k] for k in members[c]], axis=0) for c in names])
    for k, r in rows.items():
        gaps = np.linalg.norm(centre - x[k], axis=1)
        assert abs(r["distance"] - gaps[names.index(r["cluster"])]) < 0.05 and r["distance"] <= gaps.min() + 0.05
    for c in names:
        closest = min(members[c], key=lambda k: (rows[k]["distance"], k))
        assert [k for k in members[c] if rows[k]["is_medoid"]] == [closest]


def test_evidence_edges(spark):
    rows = [("a", 1, 5.0, 1), ("a", 1, 6.0, 2), ("a", 2, 5.5, 1), ("a", None, None, 3), ("b", 9, 7.0, 4), (None, 1, 4.0, 1)]
    df = spark.createDataFrame(rows, "k string, doc long, v double, line long")
    got = {r["k"]: tuple(r)[1:] for r in edge_table(df, ["k"], "v", "doc", "line", 6.0, 5.0).collect()}
    assert got == {"a": (4, 1, 1, 1, 6.0, 5.5, 2, 3), "b": (1, 1, 0, 0, 7.0, 7.0, 1, 1), None: (1, 0, 1, 0, 4.0, 4.0, 1, 1)}
    assert edge_table(df.where("false"), ["k"], "v", "doc", "line", 6.0, 5.0).count() == 0


def test_earliest_and_policies(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 0), (None, 1, 1), (None, 3, 0)], "x string, y long, o int")
    got = sorted(values(with_earliest(df, "o", by_x=["x"], by_y=["y"]), "x", "y", "o", "by_x", "by_y"), key=repr)
    assert got == sorted([("a", 1, 2, 0, 1), ("a", 2, 0, 0, 0), (None, 1, 1, 0, 1), (None, 3, 0, 0, 0)], key=repr)
    holds = {"named": F.col("x").isNotNull(), "late": F.col("o") > 0, "a": F.col("x") == "a"}
    assert tuple(reject_counts(df, holds).first()) == (4, 2, 2, 2)
    rows = values(policy_rows(df, holds, {"all": (), "strict": ("named", "late"), "a": ("a",)}), "policy", "y")
    assert sorted(rows) == [("a", 1), ("a", 2), ("all", 1), ("all", 1), ("all", 2), ("all", 3), ("strict", 1)]


def plain_fronts(rows):
    """Peeling, over rows (id, group, objectives...), not a number the highest."""
    high = lambda r: tuple(math.inf if isinstance(x, float) and math.isnan(x) else x for x in r[2:])
    left, out, front = [r for r in rows if None not in r[1:]], dict.fromkeys(r[0] for r in rows), 0
    while left:
        front += 1
        top = [r for r in left if not any(o[1] == r[1] and high(o) != high(r) and all(x >= y for x, y in zip(high(o), high(r))) for o in left)]
        out |= {r[0]: front for r in top}
        left = [r for r in left if out[r[0]] is None]
    return out


@pytest.mark.parametrize("block", [pareto.BLOCK, 40, 7])
def test_fronts(spark, monkeypatch, block):
    """Groups of one block, of windows that a task holds, and of a lowest bound beyond any."""
    ship(spark)
    monkeypatch.setattr(pareto, "BLOCK", block)
    rng = np.random.default_rng(3)
    pick = lambda n: int(rng.integers(0, n))
    rows = [(i, "g" if i % 5 else "h", pick(6), None if i == 7 else math.nan if i == 9 else float(pick(6)), pick(4)) for i in range(150)]
    rows += [(200 + i, None if i == 3 else "chain", i, float(i), 1) for i in range(25)] + [(300 + i, "flat", i, float(-i), 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, g string, u long, v double, w int").repartition(3)
    assert {r["id"]: r["front"] for r in pareto.pareto_fronts(df, "g", ["u", "v", "w"]).collect()} == plain_fronts(rows)
    assert pareto.pareto_fronts(df.where("false"), "g", ["u", "v", "w"]).count() == 0


def test_all_fronts_of_five_objectives(spark):
    names = ["p_size", "p_retailprice", "grade", "length", "number"]
    rows = [tuple(r) for r in ranks._points(spark, "/root/testdata/sf0.001").select("id", "p_brand", *names).collect()]
    got = {r["id"]: r["front"] for r in ranks.pareto_peeled(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain_fronts(rows)

