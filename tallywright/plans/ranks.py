"""Ranks, windows, top-k and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.operators.evidence import with_earliest
from tallywright.operators.pareto import dominance_counts, pareto_fronts
from tallywright.operators.rank import (
    band_rerank, first_per_group, global_ranks, global_row_numbers, grouped_ranks, hashed_row_numbers, largest_remainder, stable_hash, top_per_group,
)
from tallywright.plans.aggregates import _TRUTH, truth
from tallywright.plans.joins import split_of
from tallywright.registry import Registry
from tallywright.shipping import ship
from tallywright.sources.tables import EVIDENCE, TRAIN_END, evidence, read

QUERIES = Registry()
query = QUERIES.query
L = lambda x: (F.col(x) if isinstance(x, str) else x).cast("long")
R = lambda x, n=6: F.round(x, n)


@query("SELECT p_partkey, (rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0)::DOUBLE AS rank FROM part")
def avg_tie_rank(spark, d):
    return global_ranks(read(spark, d, "part", "p_partkey", "p_size"), "p_size").select("p_partkey", F.col("rank_avg").alias("rank"))


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size DESC)::BIGINT AS rank FROM part")
def min_rank(spark, d):
    return global_ranks(read(spark, d, "part", "p_partkey", "p_size"), "p_size").select("p_partkey", F.col("rank_min").alias("rank"))


_PCT = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query(f"WITH x AS (SELECT p_partkey, {_PCT.format('p_size')} / count(*) OVER () AS a, {_PCT.format('p_retailprice')} / count(*) OVER () AS b FROM part) SELECT p_partkey, round(0.7 * a + 0.3 * (1 - b), 6) AS score FROM x")
def pct_avg_rank_score(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_size", "p_retailprice")
    a = global_ranks(p, "p_size", False).withColumn("a", F.coalesce(F.col("rank_avg") / F.col("n_values"), F.lit(0.5))).select("p_partkey", "p_retailprice", "a")
    b = F.coalesce(F.col("rank_avg") / F.col("n_values"), F.lit(0.5))
    return global_ranks(a, "p_retailprice", False).select("p_partkey", R(0.7 * F.col("a") + 0.3 * (1 - b)).alias("score"))


_SIZE = "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END"


@query(f"WITH x AS (SELECT p_partkey, {_SIZE} AS v FROM part), y AS (SELECT p_partkey, ({_PCT.format('v')} - 1) / (count(*) OVER () - 1) AS r FROM x WHERE v IS NOT NULL) SELECT x.p_partkey, round(r, 6) AS r FROM x LEFT JOIN y USING (p_partkey)")
def percentile_rank_0_1(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("v"))
    return global_ranks(p, "v", False).select("p_partkey", R((F.col("rank_avg") - 1) / (F.col("n_values") - 1)).alias("r"))


@query(f"WITH x AS (SELECT p_partkey, {_SIZE} AS v, p_retailprice AS w FROM part), a AS (SELECT p_partkey, ({_PCT.format('v')} - 1) / (count(*) OVER () - 1) AS a FROM x WHERE v IS NOT NULL), b AS (SELECT p_partkey, ({_PCT.format('w')} - 1) / (count(*) OVER () - 1) AS b FROM x) SELECT p_partkey, round((coalesce(a, 0) + b) / (1 + (a IS NOT NULL)::INT), 6) AS merged FROM b LEFT JOIN a USING (p_partkey)")
def merged_rank(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("v"), F.col("p_retailprice").alias("w"))
    share = (F.col("rank_avg") - 1) / (F.col("n_values") - 1)
    a = global_ranks(p, "v", False).select("p_partkey", "w", share.alias("a"))
    b = global_ranks(a, "w", False).withColumn("b", share)
    return b.select("p_partkey", R((F.coalesce("a", F.lit(0.0)) + F.col("b")) / (1 + F.col("a").isNotNull().cast("int"))).alias("merged"))


@query("SELECT p_partkey, round(1 - (dense_rank() OVER (ORDER BY p_size) - 1) / ((SELECT count(DISTINCT p_size) FROM part) - 1), 6) AS score FROM part")
def dense_rank_normalize(spark, d):
    r = global_ranks(read(spark, d, "part", "p_partkey", "p_size"), "p_size", False)
    return r.select("p_partkey", R(1 - (F.col("rank_dense") - 1) / (F.col("k_values") - 1)).alias("score"))


@query("WITH n AS (SELECT least(count(*), greatest(50, round_even(count(*) * 0.025, 0)))::BIGINT AS n FROM part) SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT (SELECT n FROM n)")
def top_pct_floor(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_retailprice")
    n = p.agg(F.greatest(F.lit(50), F.bround(F.count("*") * 0.025).cast("long")).alias("n"))
    ranked = global_row_numbers(p, "p_retailprice", "p_partkey")
    return ranked.join(F.broadcast(n), F.col("rank") <= F.col("n")).select("p_partkey", "p_retailprice")


@query(f"WITH {EVIDENCE}, s AS (SELECT source, target, max(p) AS v, count(*) AS n FROM e GROUP BY 1, 2), u AS (SELECT source, target, v FROM s WHERE source <> 'N' UNION ALL SELECT 'count', target, sum(n) FROM s GROUP BY 2) SELECT source, target, round(1 - (rank() OVER (PARTITION BY source ORDER BY v DESC) - 1) / greatest(count(*) OVER (PARTITION BY source) - 1, 1), 6) AS score FROM u")
def union_ranked_sources(spark, d):
    s = evidence(spark, d).groupBy("source", "target").agg(F.max("p").alias("v"), F.count("*").alias("n"))
    u = s.where("source <> 'N'").select("source", "target", "v").unionByName(s.groupBy("target").agg(F.sum("n").cast("double").alias("v")).withColumn("source", F.lit("count")))
    return grouped_ranks(u, ["source"], "v").select("source", "target", R(1 - (F.col("rank_min") - 1) / F.greatest(F.col("n_values") - 1, F.lit(1))).alias("score"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def first_per_group_(spark, d):
    return first_per_group(read(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])


@query(f"WITH {EVIDENCE} SELECT ligand, target, source, family, day, pub FROM e QUALIFY row_number() OVER (PARTITION BY ligand, target, source, family ORDER BY day, pub, line, p) = 1")
def dedupe_earliest(spark, d):
    first = F.min(F.struct("day", "pub", "line", "p"))
    return evidence(spark, d).groupBy("ligand", "target", "source", "family").agg(first.alias("f")).select("ligand", "target", "source", "family", "f.day", "f.pub")


_ORD = f"CASE WHEN day <= DATE '{TRAIN_END}' THEN 0 WHEN day <= DATE '1999-12-31' THEN 1 ELSE 2 END"


@query(f"WITH {EVIDENCE}, o AS (SELECT *, {_ORD} AS o FROM e) SELECT ligand, target, pub, line, source, o::BIGINT AS split_order FROM o QUALIFY o = min(o) OVER (PARTITION BY ligand, target) AND o = min(o) OVER (PARTITION BY pub)")
def first_observation_filter(spark, d):
    s = split_of()
    o = evidence(spark, d).withColumn("split_order", L(F.when(s == "train", 0).when(s == "dev", 1).otherwise(2)))
    o = with_earliest(o, "split_order", a=["ligand", "target"], b=["pub"])
    return o.where("split_order = a and split_order = b").select("ligand", "target", "pub", "line", "source", "split_order")


@query(f"WITH {EVIDENCE}, f AS (SELECT target, ligand, family, p, pub, line FROM e QUALIFY row_number() OVER (PARTITION BY target, ligand ORDER BY p DESC, pub, line, family) = 1) SELECT target, ligand, p, row_number() OVER (PARTITION BY target ORDER BY p DESC, ligand)::BIGINT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY target ORDER BY p DESC, ligand) <= 4")
def topn_distinct_subkey(spark, d):
    best = evidence(spark, d).groupBy("target", "ligand").agg(F.max("p").alias("p"))
    return top_per_group(best, ["target"], [F.desc("p"), "ligand"], 4).select("target", "ligand", "p", "rank")


@query("SELECT l_suppkey AS node, p_type AS category, count(DISTINCT l_orderkey) AS papers, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(DISTINCT l_orderkey) DESC, lower(p_type))::BIGINT AS rank FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(DISTINCT l_orderkey) DESC, lower(p_type)) <= 3")
def kg_top_categories(spark, d):
    e = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").join(read(spark, d, "part", "p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    papers = e.groupBy(F.col("l_suppkey").alias("node"), F.col("p_type").alias("category")).agg(F.countDistinct("l_orderkey").alias("papers"))
    return top_per_group(papers, ["node"], [F.desc("papers"), F.lower("category")], 3)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END, -s_nationkey) DESC, s_suppkey)::BIGINT AS rank FROM supplier")
def derive_rank_fallback(spark, d):
    s = read(spark, d, "supplier").withColumns({"declared": F.lit(None).cast("long"), "score": F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")), "other": -F.col("s_nationkey").cast("double")})
    check = s.agg(F.min("declared").alias("a"), F.max("declared").alias("b"), F.countDistinct("declared").alias("c"), F.count("*").alias("n")).first()
    if (check["a"], check["b"], check["c"]) == (1, check["n"], check["n"]):
        return s.select("s_suppkey", F.col("declared").alias("rank"))
    return global_row_numbers(s.select("s_suppkey", F.coalesce("score", "other").alias("by")), "by", "s_suppkey").select("s_suppkey", "rank")


@query(f"WITH {_TRUTH} SELECT q, recipe, min(rank) AS best, bool_or(rank <= 10) AS hit10 FROM t GROUP BY 1, 2")
def case_hit_at_k(spark, d):
    return truth(spark, d).groupBy("q", "recipe").agg(F.min("rank").alias("best"), F.bool_or(F.col("rank") <= 10).alias("hit10"))


@query(f"WITH {_TRUTH} SELECT q, count(DISTINCT id) AS n_truth, round(count(DISTINCT CASE WHEN rank <= 10 THEN id END) / count(DISTINCT id), 6) AS at10, round(count(DISTINCT CASE WHEN rank <= 50 THEN id END) / count(DISTINCT id), 6) AS at50 FROM t GROUP BY 1")
def recovery_at_k(spark, d):
    n = lambda k: F.countDistinct(F.when(F.col("rank") <= k, F.col("id")))
    return truth(spark, d).groupBy("q").agg(F.countDistinct("id").alias("n_truth"), R(n(10) / F.countDistinct("id")).alias("at10"), R(n(50) / F.countDistinct("id")).alias("at50"))


@query(f"WITH {_TRUTH} SELECT q, max((rank <= 1)::INT)::BIGINT AS hit1, max((rank <= 5)::INT)::BIGINT AS hit5, max((rank <= 20)::INT)::BIGINT AS hit20 FROM t GROUP BY 1")
def hit_at_k(spark, d):
    return truth(spark, d).groupBy("q").agg(*[L(F.max((F.col("rank") <= k).cast("int"))).alias(f"hit{k}") for k in (1, 5, 20)])


@query("WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), g AS (SELECT user_id, n, coalesce(min(i) FILTER (WHERE value >= 30) - 1, n) AS lead_run, coalesce(n - max(i) FILTER (WHERE value >= 30), n) AS trail_run FROM x GROUP BY 1, 2) SELECT user_id, n, lead_run, trail_run, CASE WHEN lead_run >= 3 THEN lead_run ELSE 0 END AS trim_start, CASE WHEN trail_run >= 3 AND lead_run < n THEN trail_run ELSE 0 END AS trim_end FROM g")
def terminal_run_trim(spark, d):
    w = Window.partitionBy("user_id")
    x = read(spark, d, "events", "user_id", "event_id", "ts", "value").withColumns({"i": L(F.row_number().over(w.orderBy("ts", "event_id"))), "n": F.count("*").over(w)})
    high = F.when(F.col("value") >= 30, F.col("i"))
    g = x.groupBy("user_id", "n").agg(F.min(high).alias("a"), F.max(high).alias("b"))
    g = g.select("user_id", "n", F.coalesce(F.col("a") - 1, "n").alias("lead_run"), F.coalesce(F.col("n") - F.col("b"), "n").alias("trail_run"))
    return g.withColumns({"trim_start": F.when(F.col("lead_run") >= 3, F.col("lead_run")).otherwise(F.lit(0)), "trim_end": F.when((F.col("trail_run") >= 3) & (F.col("lead_run") < F.col("n")), F.col("trail_run")).otherwise(F.lit(0))})


@query("SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS gap FROM conversations WHERE role = 'assistant'")
def sequence_gap_lag(spark, d):
    c = read(spark, d, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", (F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("gap"))


@query("SELECT p_partkey FROM part WHERE p_type <> 'PROMO' ORDER BY sha256('s1' || chr(0) || p_partkey), p_partkey LIMIT 100")
def hash_sample(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_type").where("p_type <> 'PROMO'")
    return p.orderBy(stable_hash(F.lit("s1"), F.col("p_partkey")), "p_partkey").limit(100).select("p_partkey")


_ALLOC = "WITH s AS (SELECT p_type, count(*) AS size FROM part GROUP BY 1), a AS (SELECT p_type, size, size * 100 / sum(size) OVER () AS share FROM s), b AS (SELECT *, floor(share) + (row_number() OVER (ORDER BY share - floor(share) DESC, size DESC, p_type DESC) <= 100 - sum(floor(share)) OVER ())::INT AS n FROM a)"


@query(_ALLOC + " SELECT p_type, size, n::BIGINT AS n_taken FROM b")
def largest_remainder_alloc(spark, d):
    return largest_remainder(read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("size")), "p_type", "size", 100)


@query(_ALLOC + " SELECT p_partkey, p_type, round(size / n, 6) AS weight FROM part JOIN b USING (p_type) QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY sha256('s2' || chr(0) || p_partkey), p_partkey) <= n")
def stratified_hash_sample(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_type")
    alloc = largest_remainder(p.groupBy("p_type").agg(F.count("*").alias("size")), "p_type", "size", 100)
    # No stratum is given more than all of them together.
    first = top_per_group(p, ["p_type"], [stable_hash(F.lit("s2"), F.col("p_partkey")), "p_partkey"], 100, "r")
    x = first.join(alloc, "p_type").where("r <= n_taken")
    return x.select("p_partkey", "p_type", R(F.col("size") / F.col("n_taken")).alias("weight"))


@query("SELECT p_partkey, CASE WHEN (row_number() OVER (PARTITION BY p_brand ORDER BY sha256('s3' || chr(0) || p_partkey), p_partkey) - 1) % 2 = 0 THEN 'fit' ELSE 'eval' END AS part FROM part")
def hash_alternate_split(spark, d):
    p = hashed_row_numbers(read(spark, d, "part", "p_partkey", "p_brand"), ["p_brand"], stable_hash(F.lit("s3"), F.col("p_partkey")), "p_partkey")
    return p.select("p_partkey", F.when((F.col("rank") - 1) % 2 == 0, "fit").otherwise("eval").alias("part"))


@query("WITH x AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('s4' || chr(0) || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey, p_brand FROM x WHERE n >= 2 AND r <= greatest(1, least(floor(n * 0.2), n - 1))")
def hash_holdout_strata(spark, d):
    x = hashed_row_numbers(read(spark, d, "part", "p_partkey", "p_brand"), ["p_brand"], stable_hash(F.lit("s4"), F.col("p_partkey")), "p_partkey")
    return x.where((F.col("n") >= 2) & (F.col("rank") <= F.greatest(F.lit(1), F.least(F.floor(F.col("n") * 0.2), F.col("n") - 1)))).select("p_partkey", "p_brand")


@query("SELECT s_suppkey, n_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::BIGINT AS rank FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def select_top_fixed(spark, d):
    top = read(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)
    top = top.withColumn("rank", L(F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey"))))
    return top.join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "n_name", "rank")


_BAND = """WITH f AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS a, (p_partkey * 37 % 101) AS b FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 80),
i AS (SELECT *, CASE WHEN a IS NULL THEN count(*) OVER () + 1 ELSE rank() OVER (ORDER BY a DESC NULLS LAST) END AS ra, rank() OVER (ORDER BY b) AS rb FROM f WHERE rank BETWEEN 11 AND 50)
SELECT id, rank AS new_rank FROM f WHERE rank NOT BETWEEN 11 AND 50 UNION ALL SELECT id, 10 + row_number() OVER (ORDER BY round(1.0 / (60 + ra) + 1.0 / (60 + rb), 12) DESC, rank) FROM i"""


@query(_BAND)
def band_rerank_(spark, d):
    f = read(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(80)
    f = f.select(
        F.col("p_partkey").alias("id"), L(F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey"))).alias("rank"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("a"), (F.col("p_partkey") * 37 % 101).alias("b"),
    )
    return band_rerank(f, "rank", [("a", True), ("b", False)], 10, 50).select("id", "new_rank")


@query("WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) SELECT min(r) = 1 AND max(r) = count(*) AND count(DISTINCT r) = count(*) AS valid, count(*) AS n FROM r")
def dense_rank_validate(spark, d):
    r = read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("r"))
    return r.agg(((F.min("r") == 1) & (F.max("r") == F.count("*")) & (F.countDistinct("r") == F.count("*"))).alias("valid"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_partkey AS id, p_retailprice AS s FROM part WHERE p_type = 'PROMO' ORDER BY s DESC, id LIMIT 10), b AS (SELECT p_partkey AS id, p_size AS s FROM part WHERE p_size > 30 AND p_partkey NOT IN (SELECT id FROM a) ORDER BY s DESC, id LIMIT 8),
c AS (SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM a UNION SELECT id FROM b) ORDER BY p_retailprice DESC, id LIMIT 12) SELECT id, 'promo' AS track FROM a UNION ALL SELECT id, 'size' FROM b UNION ALL SELECT id, 'backfill' FROM c""")
def quota_basket(spark, d):
    p = read(spark, d, "part")
    take = lambda rows, order, n, track: rows.orderBy(*order).limit(n).select(F.col("p_partkey").alias("id"), F.lit(track).alias("track"))
    without = lambda rows, taken: rows.join(F.broadcast(taken.select(F.col("id").alias("p_partkey"))), "p_partkey", "left_anti")
    a = take(p.where("p_type = 'PROMO'"), [F.desc("p_retailprice"), "p_partkey"], 10, "promo")
    b = take(without(p.where("p_size > 30"), a), [F.desc("p_size"), "p_partkey"], 8, "size")
    c = take(without(p, a.unionByName(b)), [F.desc("p_retailprice"), "p_partkey"], 12, "backfill")
    return a.unionByName(b).unionByName(c)


@query("""WITH RECURSIVE c AS (SELECT p_brand, p_partkey AS id, p_size AS x, round(p_retailprice / 2000, 6) AS s FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 12),
g AS (SELECT p_brand, list({'id': id, 'x': x, 's': s} ORDER BY id) AS items FROM c GROUP BY 1),
m AS (SELECT p_brand, items, 1 AS k, [list_sort([{'v': -i.s, 'id': i.id, 'x': i.x} for i in items])[1]] AS chosen FROM g
UNION ALL SELECT p_brand, items, k + 1, chosen || [list_sort([{'v': -round(i.s - 0.6 * list_max([1 - abs(i.x - j.x) / 50 for j in chosen]), 9), 'id': i.id, 'x': i.x} for i in items if NOT list_contains([j.id for j in chosen], i.id)])[1]] FROM m WHERE k < 5 AND k < len(items))
SELECT p_brand, id, step FROM (SELECT p_brand, unnest([j.id for j in chosen]) AS id, unnest(range(1, len(chosen) + 1))::BIGINT AS step FROM m QUALIFY k = max(k) OVER (PARTITION BY p_brand))""")
def mmr_select(spark, d):
    """Five diverse candidates a seed: the score less 0.6 of the largest similarity to those chosen, one at a time over a bounded list."""
    p = read(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), R(F.col("p_retailprice") / 2000).alias("s"), "p_retailprice")
    c = top_per_group(p, ["p_brand"], [F.desc("p_retailprice"), "id"], 12)
    g = c.groupBy("p_brand").agg(F.collect_list(F.struct("id", "x", "s")).alias("items"))
    kind = "array<struct<id:bigint,x:int>>"

    def step(chosen, _):
        near = lambda i: F.array_max(F.transform(chosen, lambda j: 1 - F.abs(i["x"] - j["x"]) / 50))
        value = lambda i: F.round(i["s"] - 0.6 * F.coalesce(near(i), F.lit(0.0)), 9)
        left = F.filter("items", lambda i: ~F.exists(chosen, lambda j: j["id"] == i["id"]))
        best = F.array_min(F.transform(left, lambda i: F.struct((-value(i)).alias("v"), i["id"].alias("id"), i["x"].alias("x"))))
        return F.when(best.isNull(), chosen).otherwise(F.concat(chosen, F.array(F.struct(best["id"].alias("id"), best["x"].alias("x")))))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.array().cast(kind), step)
    return g.select("p_brand", F.posexplode(chosen).alias("pos", "c")).select("p_brand", "c.id", L(F.col("pos") + 1).alias("step"))


_OBJECTIVES = ("p_size", "p_retailprice", "grade", "length", "number")
_POINTS = "p AS (SELECT p_partkey AS id, p_brand, p_size, p_retailprice, p_partkey % 10 AS grade, length(p_type) AS length, -(p_partkey % 7) AS number FROM part)"
_BEATS = lambda x, y: f"{x}.p_brand = {y}.p_brand AND " + " AND ".join(f"{x}.{o} >= {y}.{o}" for o in _OBJECTIVES) + " AND (" + " OR ".join(f"{x}.{o} > {y}.{o}" for o in _OBJECTIVES) + ")"


def _points(spark, d):
    ship(spark)
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_brand", k.alias("id"), "p_size", "p_retailprice", (k % 10).alias("grade"), F.length("p_type").alias("length"), (-(k % 7)).alias("number"))


@query(f"WITH {_POINTS}, a AS (SELECT y.id, count(x.id) AS n FROM p y LEFT JOIN p x ON {_BEATS('x', 'y')} GROUP BY 1), b AS (SELECT x.id, count(y.id) AS n FROM p x LEFT JOIN p y ON {_BEATS('x', 'y')} GROUP BY 1) SELECT id, a.n AS n_dominating, b.n AS n_dominated FROM a JOIN b USING (id)")
def pareto_counts(spark, d):
    """Within each brand, by how many others a part is dominated in five objectives, and how many it dominates."""
    return dominance_counts(_points(spark, d), "p_brand", list(_OBJECTIVES)).select("id", "n_dominating", "n_dominated")


@query(f"""WITH RECURSIVE {_POINTS}, d AS (SELECT x.id AS above, p.id FROM p x JOIN p ON {_BEATS('x', 'p')}),
f AS (SELECT id, 1 AS k FROM p UNION SELECT d.id, f.k + 1 FROM f JOIN d ON d.above = f.id)
SELECT id, max(k)::INT AS front FROM f GROUP BY id""")
def pareto_peeled(spark, d):
    """The front of each part within its brand, down to the last."""
    return pareto_fronts(_points(spark, d), "p_brand", list(_OBJECTIVES)).select("id", "front")


@query("SELECT l_suppkey, l_partkey, (rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) + (count(*) OVER (PARTITION BY l_suppkey, n) - 1) / 2.0)::DOUBLE AS rank FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def grouped_avg_rank(spark, d):
    n = read(spark, d, "lineitem", "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return grouped_ranks(n, ["l_suppkey"], "n").select("l_suppkey", "l_partkey", F.col("rank_avg").alias("rank"))


for _name in ("first_per_group", "band_rerank"):
    QUERIES[_name] = QUERIES.pop(_name + "_")
