"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.operators.evidence import edge_table
from tallywright.operators.rank import exact_percentile, median_and_deviation
from tallywright.plans.joins import split_of
from tallywright.registry import Registry
from tallywright.sources.files import keep, small_side
from tallywright.sources.tables import EVIDENCE, NEGATIVE, POSITIVE, TIE, TRAIN_END, evidence, read

QUERIES = Registry()
query = QUERIES.query
L = lambda x: (F.col(x) if isinstance(x, str) else x).cast("long")
R = lambda x, n=6: F.round(x, n)

_SPLIT = f"CASE WHEN day <= DATE '{TRAIN_END}' THEN 'train' WHEN day <= DATE '1999-12-31' THEN 'dev' ELSE 'test' END"


def edges(spark, d):
    """(ligand, target, source, family): measurement counts by class, maximum, median, publications."""
    return edge_table(evidence(spark, d), ["ligand", "target", "source", "family"], "p", "pub", "line", POSITIVE, NEGATIVE).withColumn("median_p", R("median_p", 8))


@query(f"WITH {EVIDENCE} SELECT ligand, target, source, family, count(*) AS n, count(*) FILTER (WHERE p >= 6) AS n_pos, count(*) FILTER (WHERE p <= 5) AS n_neg, count(*) FILTER (WHERE p > 5 AND p < 6) AS n_gray, max(p) AS max_p, round(median(p), 8) AS median_p, count(DISTINCT pub) AS n_pubs, count(DISTINCT line) AS n_lines FROM e GROUP BY 1, 2, 3, 4")
def edge_build(spark, d):
    return edges(spark, d)


@query(f"WITH {EVIDENCE} SELECT ligand, target, max(p) FILTER (WHERE source = 'A') AS best_a, max(p) FILTER (WHERE source = 'N') AS best_n, max(p) FILTER (WHERE source = 'R') AS best_r, count(*) AS n FROM e GROUP BY 1, 2")
def edge_source_pivot(spark, d):
    best = [F.max(F.when(F.col("source") == s, F.col("p"))).alias(f"best_{s.lower()}") for s in "ANR"]
    return evidence(spark, d).groupBy("ligand", "target").agg(*best, F.count("*").alias("n"))


@query(f"WITH {EVIDENCE} SELECT target, max(p) AS score, count(DISTINCT ligand) AS n_support, min(ligand) FILTER (WHERE p = m) AS support FROM (SELECT *, max(p) OVER (PARTITION BY target) AS m FROM e) GROUP BY 1")
def argmax_support(spark, d):
    best = F.min_by(F.struct("p", "ligand"), F.struct(-F.col("p"), F.col("ligand")))
    return evidence(spark, d).groupBy("target").agg(best.alias("b"), F.countDistinct("ligand").alias("n_support")).select("target", F.col("b.p").alias("score"), "n_support", F.col("b.ligand").alias("support"))


@query(f"WITH {EVIDENCE} SELECT target, day, ligand, p FROM (SELECT target, day, ligand, p, row_number() OVER (PARTITION BY target ORDER BY p, day, ligand, pub, line) AS r FROM e) WHERE r = 1")
def argmin_support(spark, d):
    low = F.min(F.struct("p", "day", "ligand", "pub", "line"))
    return evidence(spark, d).groupBy("target").agg(low.alias("b")).select("target", "b.day", "b.ligand", "b.p")


@query(f"WITH {EVIDENCE} SELECT target, round(max(0.7 * p / 7 + 0.3 * (0.5 + 0.5 * least(greatest((p - 5) / 3, 0), 1))), 6) AS score, count(DISTINCT ligand) AS n_ligands FROM e WHERE family = 'F' AND disc < 0.08 GROUP BY 1")
def quality_hybrid_score(spark, d):
    from tallywright.operators.fuse import potency_weight

    s = 0.7 * F.col("p") / 7 + 0.3 * potency_weight(F.col("p"))
    return evidence(spark, d).where("family = 'F' and disc < 0.08D").groupBy("target").agg(R(F.max(s)).alias("score"), F.countDistinct("ligand").alias("n_ligands"))


@query(f"WITH {EVIDENCE}, g AS (SELECT ligand, target, max(p) AS best FROM e GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY ligand ORDER BY best DESC, target) AS r FROM g) SELECT ligand, count(*) AS n_targets, max(best) AS best, count(*) FILTER (WHERE best >= 6) AS n_positive, string_agg(target::VARCHAR, ';' ORDER BY r) FILTER (WHERE r <= 3) AS top3, CASE WHEN max(best) >= 6 THEN 'strong' WHEN max(best) > 5 THEN 'weak' ELSE 'low' END AS label FROM t GROUP BY 1")
def entity_context_rollup(spark, d):
    g = evidence(spark, d).groupBy("ligand", "target").agg(F.max("p").alias("best"))
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("ligand").orderBy(F.desc("best"), "target")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "target")))), lambda x: x["target"].cast("string"))
    label = F.when(F.max("best") >= 6, "strong").when(F.max("best") > 5, "weak").otherwise("low")
    return g.groupBy("ligand").agg(F.count("*").alias("n_targets"), F.max("best").alias("best"), F.count_if(F.col("best") >= 6).alias("n_positive"), F.array_join(top, ";").alias("top3"), label.alias("label"))


@query(f"WITH {EVIDENCE} SELECT target, to_json(list_sort(list(DISTINCT source)))::VARCHAR AS sources, to_json(list_sort(list(DISTINCT family)))::VARCHAR AS families, count(*) AS n, count(DISTINCT pub) AS n_pubs, CASE max(CASE WHEN p >= 6 THEN 2 WHEN p > 5 THEN 1 ELSE 0 END) WHEN 2 THEN 'positive' WHEN 1 THEN 'gray' ELSE 'negative' END AS status, min(day) AS first_day, max(day) AS last_day FROM e GROUP BY 1")
def ledger_summary(spark, d):
    severity = F.when(F.col("p") >= 6, 2).when(F.col("p") > 5, 1).otherwise(0)
    name = F.when(severity == 2, "positive").when(severity == 1, "gray").otherwise("negative")
    return evidence(spark, d).groupBy("target").agg(
        F.to_json(F.array_sort(F.collect_set("source"))).alias("sources"), F.to_json(F.array_sort(F.collect_set("family"))).alias("families"), F.count("*").alias("n"),
        F.countDistinct("pub").alias("n_pubs"), F.max_by(name, severity).alias("status"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


@query(f"WITH {EVIDENCE}, k AS (SELECT sha256(ligand || '|' || target || '|' || line) AS h, source FROM e) SELECT n_sources, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM (SELECT h, count(DISTINCT source) AS n_sources, count(*) AS n FROM k GROUP BY 1 HAVING count(DISTINCT source) > 1) GROUP BY 1")
def cross_source_duplicates(spark, d):
    k = evidence(spark, d).select(F.sha2(F.concat_ws("|", "ligand", "target", "line"), 256).alias("h"), "source")
    g = k.groupBy("h").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n")).where("n_sources > 1")
    return g.groupBy("n_sources").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


@query(f"WITH {EVIDENCE} SELECT ligand, target, pub, line, source, row_number() OVER (PARTITION BY ligand, target ORDER BY day, pub, line, source, p)::BIGINT AS ordinal, count(*) OVER (PARTITION BY ligand, target) AS n FROM e QUALIFY count(*) OVER (PARTITION BY ligand, target) > 1")
def duplicate_ordinal(spark, d):
    w = Window.partitionBy("ligand", "target")
    e = evidence(spark, d).withColumn("ordinal", L(F.row_number().over(w.orderBy("day", "pub", "line", "source", "p"))))
    return e.withColumn("n", F.count("*").over(w)).where("n > 1").select("ligand", "target", "pub", "line", "source", "ordinal", "n")


#: Rankings: each customer's query over parts ordered by price, truth the ones it bought.
_TRUTH = """t AS (SELECT o_custkey AS q, l_partkey AS id, 1 + (l_partkey * 7 + o_custkey * 13) % 200 AS rank, CASE WHEN o_custkey % 3 = 0 THEN 'base' ELSE 'new' END AS recipe, l_suppkey AS target, l_returnflag AS source
FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def truth(spark, d):
    t = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rank = 1 + (F.col("l_partkey") * 7 + F.col("o_custkey") * 13) % 200
    recipe = F.when(F.col("o_custkey") % 3 == 0, "base").otherwise("new")
    return t.select(F.col("o_custkey").alias("q"), F.col("l_partkey").alias("id"), rank.alias("rank"), recipe.alias("recipe"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("source"))


_METRICS = "count(*) AS n, round(avg((rank <= 10)::INT), 6) AS top10, round(avg((rank <= 30)::INT), 6) AS top30, round(avg(1.0 / rank), 6) AS mrr"


def metrics():
    r = F.col("rank")
    return [F.count("*").alias("n"), R(F.avg((r <= 10).cast("int"))).alias("top10"), R(F.avg((r <= 30).cast("int"))).alias("top30"), R(F.avg(1 / r)).alias("mrr")]


@query(f"WITH {_TRUTH}, g AS (SELECT target, count(*) AS n, avg((rank <= 10)::INT) AS t10, avg(1.0 / rank) AS mrr, sum((rank <= 10)::INT) AS h FROM t GROUP BY 1) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_targets, round(sum(h) / sum(n), 6) AS top10_micro, round(avg(t10), 6) AS top10_macro, round(avg(mrr), 6) AS mrr_macro, round(max(n) / sum(n), 6) AS max_share, round(1 / sum((n / (SELECT sum(n) FROM g)) * (n / (SELECT sum(n) FROM g))), 6) AS effective FROM g")
def ranking_summary_macro(spark, d):
    r = F.col("rank")
    g = truth(spark, d).groupBy("target").agg(F.count("*").alias("n"), F.avg((r <= 10).cast("int")).alias("t10"), F.avg(1 / r).alias("mrr"), F.count_if(r <= 10).alias("h"))
    return g.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_targets"), R(F.sum("h") / F.sum("n")).alias("top10_micro"), R(F.avg("t10")).alias("top10_macro"), R(F.avg("mrr")).alias("mrr_macro"),
        R(F.max("n") / F.sum("n")).alias("max_share"), R(F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective"),
    )


@query(f"WITH {_TRUTH}, i AS (SELECT *, id % 4 <> 0 AS inside FROM t) SELECT count(*) AS n, count(*) FILTER (WHERE inside) AS n_inside, round(avg((inside AND rank <= 10)::INT), 6) AS top10_all, round(avg((rank <= 10)::INT) FILTER (WHERE inside), 6) AS top10_inside, round(avg(CASE WHEN inside THEN 1.0 / rank ELSE 0 END), 6) AS mrr_all, round(avg(1.0 / rank) FILTER (WHERE inside), 6) AS mrr_inside FROM i")
def ranking_coverage(spark, d):
    inside, hit, rr = F.col("id") % 4 != 0, (F.col("rank") <= 10).cast("int"), 1 / F.col("rank")
    return truth(spark, d).agg(
        F.count("*").alias("n"), F.count_if(inside).alias("n_inside"), R(F.avg(F.when(inside, hit).otherwise(0))).alias("top10_all"), R(F.avg(F.when(inside, hit))).alias("top10_inside"),
        R(F.avg(F.when(inside, rr).otherwise(0.0))).alias("mrr_all"), R(F.avg(F.when(inside, rr))).alias("mrr_inside"),
    )


@query(f"WITH {_TRUTH} SELECT recipe, {_METRICS} FROM t GROUP BY 1")
def ranking_by_recipe(spark, d):
    return truth(spark, d).groupBy("recipe").agg(*metrics())


@query(f"WITH {_TRUTH} SELECT recipe, s AS stratum, {_METRICS} FROM (SELECT recipe, rank, unnest(CASE WHEN rank % 2 = 0 THEN [source, 'even'] ELSE [source] END) AS s FROM t) GROUP BY 1, 2")
def explode_strata(spark, d):
    listed = F.to_json(F.when(F.col("rank") % 2 == 0, F.array("source", F.lit("even"))).otherwise(F.array("source")))
    t = truth(spark, d).withColumn("stratum", F.explode(F.from_json(listed, "array<string>")))
    return t.groupBy("recipe", "stratum").agg(*metrics())


@query(f"WITH {_TRUTH} SELECT coalesce(source, 'all') AS grp, {_METRICS}, count(DISTINCT q) AS n_queries FROM t GROUP BY ROLLUP (source)")
def group_metrics_rollup(spark, d):
    return truth(spark, d).rollup("source").agg(*metrics(), F.countDistinct("q").alias("n_queries")).withColumn("grp", F.coalesce("source", F.lit("all"))).drop("source")


@query(f"WITH {_TRUTH}, f AS (SELECT source, CASE WHEN id % 5 = 0 THEN NULL ELSE rank END AS r FROM t) SELECT source, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(r), 6) AS mean_rank, median(r)::DOUBLE AS median_rank, count(r) AS n_ranked, count(*) AS n FROM f GROUP BY 1")
def finite_rank_metrics(spark, d):
    r = F.when(F.col("id") % 5 != 0, F.col("rank"))
    return truth(spark, d).select("source", r.alias("r")).groupBy("source").agg(
        R(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0)))).alias("mrr"), R(F.avg("r")).alias("mean_rank"), F.median("r").alias("median_rank"), F.count("r").alias("n_ranked"), F.count("*").alias("n")
    )


@query("WITH x AS (SELECT p_partkey, p_type, p_size <= 15 AS a, p_retailprice <= 1500 AS b FROM part) SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'size_only' ELSE 'price_only' END AS bucket, coalesce(CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END, 'orphan') AS class, count(*) AS n FROM x WHERE a OR b GROUP BY 1, 2")
def disagreement_by_class(spark, d):
    a, b = F.col("p_size") <= 15, F.col("p_retailprice") <= 1500
    bucket = F.when(a & b, "both").when(a, "size_only").otherwise("price_only")
    kind = F.coalesce(F.when(F.col("p_type") != "PROMO", F.col("p_type")), F.lit("orphan"))
    return read(spark, d, "part").where(a | b).groupBy(bucket.alias("bucket"), kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {EVIDENCE}, m AS (SELECT target, median(p) AS m, count(*) AS n FROM e GROUP BY 1), s AS (SELECT target, 1.4826 * median(abs(p - m)) AS s FROM e JOIN m USING (target) GROUP BY 1) SELECT target, ligand, pub, line, round((p - m) / s, 5) AS z FROM e JOIN m USING (target) JOIN s USING (target) WHERE n >= 30 AND s > 0")
def robust_zscore(spark, d):
    e = evidence(spark, d)
    m = median_and_deviation(e, ["target"], "p").where("n >= 30").select("target", "m", (1.4826 * F.col("mad")).alias("s"))
    m = small_side(keep(m.where("s > 0"), "backgrounds"))
    return e.join(m, "target").select("target", "ligand", "pub", "line", R((F.col("p") - F.col("m")) / F.col("s"), 5).alias("z"))


@query(f"WITH {EVIDENCE} SELECT ligand, pub, line, source, round((sum(p) OVER (PARTITION BY ligand) - p) / (count(*) OVER (PARTITION BY ligand) - 1) + 1e-9, 6) AS others FROM e QUALIFY count(*) OVER (PARTITION BY ligand) > 5")
def leave_one_out_background(spark, d):
    e = evidence(spark, d)
    e = e.join(e.groupBy("ligand").agg(F.sum("p").alias("s"), F.count("*").alias("n")).where("n > 5"), "ligand")
    return e.select("ligand", "pub", "line", "source", R((F.col("s") - F.col("p")) / (F.col("n") - 1) + TIE).alias("others"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') AND bool_or(event_type = 'purchase') AND bool_or(event_type = 'signup') THEN 'conflict' WHEN bool_or(event_type = 'error') AND bool_or(event_type = 'purchase') THEN 'mixed' WHEN bool_or(event_type = 'error') THEN 'opposes' WHEN bool_or(event_type = 'purchase') THEN 'supports' ELSE 'unknown' END AS direction FROM events GROUP BY 1")
def direction_vote(spark, d):
    seen = lambda t: F.bool_or(F.col("event_type") == t)
    no, yes = seen("error"), seen("purchase")
    vote = F.when(no & yes & seen("signup"), "conflict").when(no & yes, "mixed").when(no, "opposes").when(yes, "supports").otherwise("unknown")
    return read(spark, d, "events").groupBy("user_id").agg(vote.alias("direction"))


@query("WITH x AS (SELECT p_partkey, p_brand, p_size > 25 AS large, p_retailprice > 1500 AS dear, p_type = 'PROMO' AS promo FROM part) SELECT name, count(*) FILTER (WHERE v) AS n_rows, count(DISTINCT CASE WHEN v THEN p_brand END) AS n_brands FROM (SELECT p_brand, 'large' AS name, large AS v FROM x UNION ALL SELECT p_brand, 'dear', dear FROM x UNION ALL SELECT p_brand, 'promo', promo FROM x) GROUP BY 1")
def boolean_coverage_unpivot(spark, d):
    p = read(spark, d, "part").select("p_brand", (F.col("p_size") > 25).alias("large"), (F.col("p_retailprice") > 1500).alias("dear"), (F.col("p_type") == "PROMO").alias("promo"))
    long = p.unpivot(["p_brand"], ["large", "dear", "promo"], "name", "v")
    return long.groupBy("name").agg(F.count_if("v").alias("n_rows"), F.countDistinct(F.when(F.col("v"), F.col("p_brand"))).alias("n_brands"))


@query("SELECT o_custkey % 20 AS grp, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def state_counter_pivot(spark, d):
    o = read(spark, d, "orders").withColumn("grp", F.col("o_custkey") % 20)
    n = o.groupBy("grp").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).fillna(0)
    return o.groupBy("grp").agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("total")).join(n, "grp").select("grp", "n", "total", F.col("F").alias("n_f"), F.col("O").alias("n_o"), F.col("P").alias("n_p"))


_WEIGHTS = f"""WITH {EVIDENCE}, c AS (SELECT target, family, count(*) AS n FROM e GROUP BY 1, 2), k AS (SELECT target, count(*) AS labels FROM c GROUP BY 1), w AS (SELECT target, family, n, 1.0 / ((SELECT count(*) FROM k) * labels * n) AS w FROM c JOIN k USING (target))"""


def _weights(spark, d):
    c = evidence(spark, d).groupBy("target", "family").agg(F.count("*").alias("n"))
    k = c.groupBy("target").agg(F.count("*").alias("labels"))
    t = k.agg(F.count("*").alias("targets"), F.lit(1).alias("one"))
    return c.join(k, "target").join(F.broadcast(t)).withColumn("w", 1.0 / (F.col("targets") * F.col("labels") * F.col("n")))


@query(_WEIGHTS + " SELECT target, family, n, round(w * (SELECT sum(n) FROM c), 6) AS weight FROM w")
def balanced_weights(spark, d):
    w = _weights(spark, d)
    return w.join(F.broadcast(w.agg(F.sum("n").alias("total")))).select("target", "family", "n", R(F.col("w") * F.col("total")).alias("weight"))


@query(f"WITH {EVIDENCE}, s AS (SELECT target, count(*) / (SELECT count(*) FROM e) AS p FROM e WHERE true GROUP BY 1) SELECT count(*) AS n_targets, round(exp(-sum(p * ln(p))), 5) AS effective FROM s")
def entropy_effective_count(spark, d):
    s = evidence(spark, d).groupBy("target").agg(F.count("*").alias("n"))
    n = F.col("n")  # of shares n/N: -sum p ln p = ln N - sum n ln n / N
    return s.agg(F.count("*").alias("n_targets"), R(F.exp(F.ln(F.sum("n")) - F.sum(n * F.ln(n)) / F.sum("n")), 5).alias("effective"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_labels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def label_conflicts(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n_labels")).where("n_labels > 1")


@query(f"WITH {EVIDENCE} SELECT family, source, round(median(p), 6) AS median_p, count(*) AS n FROM e GROUP BY 1, 2")
def agg_activity_strata(spark, d):
    return exact_percentile(evidence(spark, d), ["family", "source"], "p", 0.5, "median_p").select("family", "source", R("median_p").alias("median_p"), "n")


@query(f"WITH {EVIDENCE} SELECT ligand, count(*) AS n FROM e WHERE p >= 6 GROUP BY 1 HAVING count(*) <= 12")
def cold_start_groups(spark, d):
    return evidence(spark, d).where(F.col("p") >= POSITIVE).groupBy("ligand").agg(F.count("*").alias("n")).where("n <= 12")


@query(f"WITH {EVIDENCE} SELECT source, string_agg(DISTINCT family, ';' ORDER BY family) AS families, count(DISTINCT target) AS n_targets, min(day) AS since FROM e GROUP BY 1")
def source_rollup(spark, d):
    return evidence(spark, d).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("family")), ";").alias("families"), F.countDistinct("target").alias("n_targets"), F.min("day").alias("since"))


@query("SELECT l_partkey, round(avg(m) + 1e-9, 4) AS mean, round(stddev_samp(m), 4) AS spread, count(*) AS n FROM (SELECT l_partkey, l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1")
def replica_mean(spark, d):
    r = read(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.avg("l_extendedprice").alias("m"))
    return r.groupBy("l_partkey").agg(R(F.avg("m") + TIE, 4).alias("mean"), R(F.stddev_samp("m"), 4).alias("spread"), F.count("*").alias("n")).where("n > 1")


@query("WITH w AS (SELECT l_partkey AS k, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1) SELECT count(*) FILTER (WHERE a >= 45 AND b < 45) AS only_a, count(*) FILTER (WHERE a < 45 AND b >= 45) AS only_b, count(*) FILTER (WHERE a >= 45 AND b >= 45) AS both_hit, count(*) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def pivot_discordant(spark, d):
    w = read(spark, d, "lineitem").groupBy("l_partkey").pivot("l_returnflag", ["A", "R"]).agg(F.max("l_quantity")).dropna()
    a, b = F.col("A") >= 45, F.col("R") >= 45
    return w.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(a & b).alias("both_hit"), F.count("*").alias("n"))


@query(f"WITH {EVIDENCE} SELECT {_SPLIT} AS split, count(*) AS n, count(DISTINCT ligand) AS n_ligands, min(day) AS first_day, max(day) AS last_day FROM e GROUP BY 1")
def temporal_split_counts(spark, d):
    return evidence(spark, d).groupBy(split_of().alias("split")).agg(F.count("*").alias("n"), F.countDistinct("ligand").alias("n_ligands"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"WITH {EVIDENCE} SELECT CASE WHEN p >= 6 THEN 'strong' WHEN p >= 5 THEN 'weak' ELSE 'low' END AS class, count(*) AS n FROM e GROUP BY 1")
def activity_class_counts(spark, d):
    p = F.col("p")
    return evidence(spark, d).groupBy(F.when(p >= 6, "strong").when(p >= 5, "weak").otherwise("low").alias("class")).agg(F.count("*").alias("n"))


_CENTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_FIELDS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(f"round({c} * 100)::BIGINT" for c in _CENTS) + ", l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')"


@query(f"SELECT count(*) AS n, sum(l_quantity)::BIGINT AS q, bit_xor(('0x' || substr(md5(concat_ws('|', {_FIELDS})), 1, 15))::BIGINT) AS digest FROM lineitem")
def table_fingerprint(spark, d):
    """Rows, a sum, and a digest over all columns, whatever the order of the rows."""
    li = read(spark, d, "lineitem")
    fields = [*[F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], *[F.round(F.col(c) * 100).cast("long") for c in _CENTS], "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *fields)), 1, 15), 16, 10).cast("long")
    return li.agg(F.count("*").alias("n"), L(F.sum("l_quantity")).alias("q"), F.bit_xor(h).alias("digest"))


@query(f"WITH {EVIDENCE}, a AS (SELECT target, count(DISTINCT ligand) AS x, count(DISTINCT ligand) FILTER (WHERE day <= DATE '{TRAIN_END}') AS b FROM e GROUP BY 1), z AS (SELECT CASE WHEN b < 100 THEN '0-99' WHEN b < 200 THEN '100-199' ELSE '200+' END AS band, x, b FROM a) SELECT band, count(*) AS n_targets, sum(b)::BIGINT AS today, sum(x)::BIGINT AS merged, (sum(x) - sum(b))::BIGINT AS gain FROM z GROUP BY 1")
def band_coverage_gain(spark, d):
    early = F.when(F.col("day") <= F.lit(TRAIN_END), F.col("ligand"))
    a = evidence(spark, d).groupBy("target").agg(F.countDistinct("ligand").alias("x"), F.countDistinct(early).alias("b"))
    band = F.when(F.col("b") < 100, "0-99").when(F.col("b") < 200, "100-199").otherwise("200+")
    return a.groupBy(band.alias("band")).agg(F.count("*").alias("n_targets"), F.sum("b").alias("today"), F.sum("x").alias("merged"), (F.sum("x") - F.sum("b")).alias("gain"))


@query(f"WITH {EVIDENCE} SELECT CASE WHEN p >= 6 OR p <= 5 THEN 'measured' ELSE 'ranking_only' END AS part, count(*) AS n, count(DISTINCT target) AS n_targets FROM e GROUP BY 1")
def pu_split(spark, d):
    sure = (F.col("p") >= POSITIVE) | (F.col("p") <= NEGATIVE)
    return evidence(spark, d).groupBy(F.when(sure, "measured").otherwise("ranking_only").alias("part")).agg(F.count("*").alias("n"), F.countDistinct("target").alias("n_targets"))


@query("WITH x AS (SELECT o_custkey AS q, count(*) AS n, count(DISTINCT o_orderstatus) AS s, max(o_totalprice) AS m FROM orders GROUP BY 1) SELECT count(*) AS n_queries, sum(n)::BIGINT AS n_rows, round(max(n) / sum(n), 6) AS max_share, round(sum(n) * sum(n) / sum(n * n), 4) AS effective, count(*) >= 50 AND max(n) / sum(n) <= 0.1 AS adequate FROM x")
def adequacy_check(spark, d):
    x = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return x.agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_rows"), R(share).alias("max_share"), R(F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n")), 4).alias("effective"), ((F.count("*") >= 50) & (share <= 0.1)).alias("adequate"))


@query(f"WITH {EVIDENCE} SELECT {_SPLIT} AS split, count(*) AS n, count(DISTINCT pub) AS n_pubs, sum(line)::BIGINT AS lines FROM e GROUP BY 1")
def verified_split_write(spark, d):
    """Rows routed to a folder of each split in one pass, verified, and read again."""
    from uuid import uuid4

    from tallywright.sources.files import scratch
    from tallywright.sources.sinks import read_verified, write_verified

    path = f"{scratch(spark)}/splits-{uuid4().hex}"
    write_verified(evidence(spark, d).withColumn("split", split_of()), path, ["split"])
    return read_verified(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("pub").alias("n_pubs"), F.sum("line").alias("lines"))
