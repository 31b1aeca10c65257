"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.operators.merge import merge_ordered, read_ordered
from tallywright.operators.rank import exact_percentile, first_per_group, global_row_numbers, top_per_group
from tallywright.registry import Registry
from tallywright.sources.tables import EVIDENCE, TRAIN_END, evidence, read

QUERIES = Registry()
query = QUERIES.query
L = lambda x: (F.col(x) if isinstance(x, str) else x).cast("long")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, p_name, s_name, sn.n_name AS source_nation, cn.n_name AS customer_nation, r_name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = sn.n_regionkey""")
def evidence_multiway_join(spark, d):
    nation = read(spark, d, "nation")
    alias = lambda name, key: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    li = read(spark, d, "lineitem")
    out = li.join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    out = out.join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    out = out.join(read(spark, d, "customer").where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source_nation"), "n_regionkey"), "s_nationkey", "left")
    out = out.join(alias("customer_nation", "c_nationkey"), "c_nationkey", "left").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return out.select("l_orderkey", L("l_linenumber").alias("line"), "p_name", "s_name", "source_nation", "customer_nation", "r_name")


_EDGES = f"{EVIDENCE}, g AS (SELECT ligand, target, max(p) AS best, count(*) AS n FROM e GROUP BY 1, 2)"


def _pairs(spark, d):
    return evidence(spark, d).groupBy("ligand", "target").agg(F.max("p").alias("best"), F.count("*").alias("n"))


def _rank_target(spark, d, order):
    edges = _pairs(spark, d).where("target = 3").join(read(spark, d, "part", "p_partkey", "p_name").withColumnRenamed("p_partkey", "ligand"), "ligand")
    return edges.withColumn("rank", L(F.row_number().over(Window.orderBy(*order)))).where("rank <= 25").select("ligand", "p_name", "best", "n", "rank")


_RANK = "WITH {} SELECT ligand, p_name, best, n, row_number() OVER (ORDER BY {})::BIGINT AS rank FROM g JOIN part ON p_partkey = ligand WHERE target = 3 QUALIFY row_number() OVER (ORDER BY {}) <= 25"


@query(_RANK.format(_EDGES, *["best DESC, ligand"] * 2))
def rank_by_potency(spark, d):
    return _rank_target(spark, d, [F.desc("best"), "ligand"])


@query(_RANK.format(_EDGES, *["n DESC, best DESC, ligand"] * 2))
def rank_by_evidence(spark, d):
    return _rank_target(spark, d, [F.desc("n"), F.desc("best"), "ligand"])


@query("""WITH b AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey AS k1, 'Brand#' || (l_partkey % 30) AS k2, l_suppkey % 7 AS k3 FROM lineitem),
x AS (SELECT p_partkey, p_name FROM part WHERE p_size > 20),
y AS (SELECT p_brand, min(p_partkey) AS ky FROM part WHERE p_size = 1 GROUP BY 1 HAVING count(*) = 1),
z AS (SELECT n_nationkey, min(s_suppkey) AS kz FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT l_orderkey, line, coalesce(p_partkey, ky, kz) AS matched, CASE WHEN p_partkey IS NOT NULL THEN 'key' WHEN ky IS NOT NULL THEN 'unique_secondary' WHEN kz IS NOT NULL THEN 'derived' ELSE 'none' END AS method
FROM b LEFT JOIN x ON p_partkey = k1 LEFT JOIN y ON p_brand = k2 LEFT JOIN z ON n_nationkey = k3""")
def fallback_cascade_join(spark, d):
    li = read(spark, d, "lineitem")
    b = li.select("l_orderkey", L("l_linenumber").alias("line"), F.col("l_partkey").alias("k1"), F.concat(F.lit("Brand#"), F.col("l_partkey") % 30).alias("k2"), (F.col("l_suppkey") % 7).cast("int").alias("k3"))
    part = read(spark, d, "part")
    x = part.where("p_size > 20").select(F.col("p_partkey").alias("k1"), F.col("p_partkey").alias("kx"))
    y = part.where("p_size = 1").groupBy(F.col("p_brand").alias("k2")).agg(F.min("p_partkey").alias("ky"), F.count("*").alias("c")).where("c = 1").drop("c")
    z = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k3")).agg(F.min("s_suppkey").alias("kz"))
    method = F.when(F.col("kx").isNotNull(), "key").when(F.col("ky").isNotNull(), "unique_secondary").when(F.col("kz").isNotNull(), "derived").otherwise("none")
    return b.join(x, "k1", "left").join(y, "k2", "left").join(z, "k3", "left").select("l_orderkey", "line", F.coalesce("kx", "ky", "kz").alias("matched"), method.alias("method"))


@query("""WITH q AS (SELECT c_custkey, 'Supplier#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') AS name FROM customer), s AS (SELECT s_name, s_suppkey FROM supplier WHERE s_acctbal > 2000),
p AS (SELECT substr(s_name, 1, 17) AS prefix, min(s_suppkey) AS k FROM s GROUP BY 1)
SELECT c_custkey, coalesce(s_suppkey, k) AS matched, CASE WHEN s_suppkey IS NOT NULL THEN 'exact' WHEN k IS NOT NULL THEN 'prefix' END AS method FROM q LEFT JOIN s ON s_name = name LEFT JOIN p ON prefix = substr(name, 1, 17)""")
def exact_then_prefix_join(spark, d):
    q = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0")).alias("name"))
    s = read(spark, d, "supplier").where("s_acctbal > 2000").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("exact"))
    p = s.groupBy(F.substring("name", 1, 17).alias("prefix")).agg(F.min("exact").alias("k"))
    out = q.join(s, "name", "left").withColumn("prefix", F.substring("name", 1, 17)).join(p, "prefix", "left")
    return out.select("c_custkey", F.coalesce("exact", "k").alias("matched"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("k").isNotNull(), "prefix").alias("method"))


@query("SELECT DISTINCT o_custkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def id_mapping_join(spark, d):
    ids = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).distinct()
    return read(spark, d, "orders", "o_custkey").distinct().join(ids, "o_custkey").join(read(spark, d, "nation"), "n_nationkey").select("o_custkey", "n_name")


@query("SELECT s_suppkey, s_name, n_name AS name, s_acctbal FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def annotate_left_join(spark, d):
    left = read(spark, d, "supplier").withColumn("name", F.lit("old")).withColumnRenamed("s_nationkey", "key")
    right = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    overlap = [c for c in right.columns if c in left.columns and c != "key"]
    return left.drop(*overlap).join(right, "key", "left").select("s_suppkey", "s_name", "name", "s_acctbal")


@query(f"WITH {EVIDENCE}, b AS (SELECT DISTINCT ligand, true AS seen FROM e WHERE day <= DATE '{TRAIN_END}'), t AS (SELECT DISTINCT target, true AS known FROM e WHERE day <= DATE '{TRAIN_END}') SELECT coalesce(seen, false) AS ligand_seen, coalesce(known, false) AS target_seen, count(*) AS n FROM e LEFT JOIN b USING (ligand) LEFT JOIN t USING (target) WHERE day > DATE '{TRAIN_END}' GROUP BY 1, 2")
def seen_before_cutoff_flags(spark, d):
    e = evidence(spark, d).select("ligand", "target", "day")
    early = e.where(F.col("day") <= F.lit(TRAIN_END))
    known = lambda c, name: early.select(c).distinct().withColumn(name, F.lit(True))
    late = e.where(F.col("day") > F.lit(TRAIN_END)).join(known("ligand", "a"), "ligand", "left").join(known("target", "b"), "target", "left")
    return late.groupBy(F.coalesce("a", F.lit(False)).alias("ligand_seen"), F.coalesce("b", F.lit(False)).alias("target_seen")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT concat_ws(' ', p_name, p_brand, p_size) AS alias, p_partkey AS id FROM part), x AS (SELECT alias FROM a GROUP BY 1 HAVING count(DISTINCT id) > 1) SELECT a.alias, count(*) AS n FROM a LEFT JOIN x ON x.alias = a.alias WHERE x.alias IS NULL GROUP BY 1")
def ambiguous_alias_anti_join(spark, d):
    a = read(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("alias"), F.col("p_partkey").alias("id"))
    x = a.groupBy("alias").agg(F.countDistinct("id").alias("n")).where("n > 1").select("alias")
    return a.join(x, "alias", "left_anti").groupBy("alias").agg(F.count("*").alias("n"))


@query("SELECT 'lineitem_part' AS link, count(*) AS n_missing FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) UNION ALL SELECT 'labels_documents', count(*) FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents WHERE documents.doc_id = labels.doc_id)")
def referential_integrity(spark, d):
    def missing(name, table, key, other, other_key):
        gone = read(spark, d, table, key).join(read(spark, d, other, other_key).withColumnRenamed(other_key, key), key, "left_anti")
        return gone.agg(F.count("*").alias("n_missing")).select(F.lit(name).alias("link"), "n_missing")

    return missing("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey").unionByName(missing("orders_customer", "orders", "o_custkey", "customer", "c_custkey")).unionByName(missing("labels_documents", "labels", "doc_id", "documents", "doc_id"))


@query("SELECT c.c_custkey, c.c_custkey // 10 AS parent, p.c_name AS parent_name, p.c_acctbal AS parent_balance FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 10")
def self_join_parent(spark, d):
    c = read(spark, d, "customer").withColumn("parent", F.floor(F.col("c_custkey") / 10))
    p = c.select(F.col("c_custkey").alias("parent"), F.col("c_name").alias("parent_name"), F.col("c_acctbal").alias("parent_balance"))
    return c.join(p, "parent", "left").select("c_custkey", "parent", "parent_name", "parent_balance")


@query(f"WITH {EVIDENCE}, m AS (SELECT target, family, source, median(p) AS m FROM e GROUP BY 1, 2, 3) SELECT a.target, round(min(a.m - b.m), 6) AS worst_delta, count(*) AS n FROM m a JOIN m b ON a.family = b.family AND a.source = b.source AND b.target = a.target % 5 WHERE a.target >= 5 GROUP BY 1")
def strata_delta_join(spark, d):
    m = exact_percentile(evidence(spark, d), ["target", "family", "source"], "p", 0.5, "m").drop("n")
    parent = m.where("target < 5").select(F.col("target").alias("parent"), "family", "source", F.col("m").alias("pm"))
    a = m.where("target >= 5").withColumn("parent", F.col("target") % 5).join(parent, ["parent", "family", "source"])
    return a.groupBy("target").agg(F.round(F.min(F.col("m") - F.col("pm")), 6).alias("worst_delta"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def ordered_merge(spark, d):
    """Customers of the orders, by merging their ids with the customers as they stand in the file, in order or not at all."""
    ids = read(spark, d, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    return merge_ordered(ids, read_ordered(spark, f"{d}/customer.parquet"), "c_custkey").select("c_custkey", "c_name")


_TIER = "CASE WHEN name = 'red' THEN 0 WHEN name LIKE 'red%' THEN 1 WHEN name LIKE '%re%' THEN 2 END"


@query(f"WITH n AS (SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT n_nationkey + 100000, lower(n_name) FROM nation), t AS (SELECT id, name, {_TIER} AS tier FROM n), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, id) AS r FROM t WHERE tier IS NOT NULL) SELECT id, name, tier::BIGINT AS tier FROM f WHERE r = 1 ORDER BY tier, length(name), name LIMIT 12")
def name_search_tiers(spark, d):
    n = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    n = n.unionByName(read(spark, d, "nation").select((F.col("n_nationkey") + 100000).alias("id"), F.lower("n_name").alias("name")))
    x = F.col("name")
    t = n.withColumn("tier", L(F.when(x == "red", 0).when(x.startswith("red"), 1).when(x.contains("re"), 2))).where("tier is not null")
    return first_per_group(t, ["name"], ["tier", "id"]).orderBy("tier", F.length("name"), "name").limit(12).select("id", "name", "tier")


@query("""WITH q(q) AS (VALUES ('NATION_3'), ('3'), ('tion_1'), ('asia'), ('zzz')), l AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region),
m AS (SELECT q, id, CASE WHEN id::VARCHAR = q THEN 0 WHEN name = q THEN 1 WHEN lower(name) = lower(q) THEN 2 WHEN contains(lower(name), lower(q)) THEN 3 END AS tier FROM q, l)
SELECT q, tier::BIGINT AS tier, count(*) AS n, min(id) AS id FROM m WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY q) GROUP BY ALL""".replace(" QUALIFY tier = min(tier) OVER (PARTITION BY q) GROUP BY ALL", " AND (q, tier) IN (SELECT q, min(tier) FROM m GROUP BY q) GROUP BY 1, 2"))
def lexicon_resolve(spark, d):
    q = spark.sql("SELECT * FROM VALUES ('NATION_3'), ('3'), ('tion_1'), ('asia'), ('zzz') AS t(q)")
    lexicon = read(spark, d, "nation").select(L("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(read(spark, d, "region").select(L(F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name")))
    word, name = F.lower("q"), F.lower("name")
    tier = F.when(F.col("id").cast("string") == F.col("q"), 0).when(F.col("name") == F.col("q"), 1).when(name == word, 2).when(F.contains(name, word), 3)
    m = lexicon.join(F.broadcast(q), F.contains(name, word) | (F.col("id").cast("string") == F.col("q"))).withColumn("tier", L(tier))
    best = m.withColumn("least", F.min("tier").over(Window.partitionBy("q"))).where("tier = least")
    return best.groupBy("q", "tier").agg(F.count("*").alias("n"), F.min("id").alias("id"))


@query(f"WITH {_EDGES} SELECT target, ligand, best, n, row_number() OVER (PARTITION BY target ORDER BY best DESC, ligand)::BIGINT AS rank FROM g QUALIFY row_number() OVER (PARTITION BY target ORDER BY best DESC, ligand) <= 5")
def topn_per_group(spark, d):
    return top_per_group(_pairs(spark, d), ["target"], [F.desc("best"), "ligand"], 5).select("target", "ligand", "best", "n", "rank")


@query(f"WITH {EVIDENCE}, a AS (SELECT target, count(*) AS n_rows, count(DISTINCT ligand) AS n_ligands, count(DISTINCT source) AS n_sources, count(DISTINCT coalesce(CASE WHEN family = 'F' THEN 'o' || pub END, 'l' || line)) AS n_pubs FROM e WHERE day <= DATE '1995-01-20' GROUP BY 1) SELECT s_suppkey, coalesce(n_rows, 0) AS n_rows, coalesce(n_ligands, 0) AS n_ligands, coalesce(n_sources, 0) AS n_sources, coalesce(n_pubs, 0) AS n_pubs, n_rows IS NOT NULL AS resolved FROM supplier LEFT JOIN a ON target = s_suppkey")
def coverage_report(spark, d):
    pub = F.coalesce(F.when(F.col("family") == "F", F.concat(F.lit("o"), "pub")), F.concat(F.lit("l"), "line"))
    a = evidence(spark, d).where(F.col("day") <= F.lit("1995-01-20")).groupBy(F.col("target").alias("s_suppkey")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("ligand").alias("n_ligands"), F.countDistinct("source").alias("n_sources"), F.countDistinct(pub).alias("n_pubs")
    )
    out = read(spark, d, "supplier", "s_suppkey").join(a, "s_suppkey", "left").withColumn("resolved", F.col("n_rows").isNotNull())
    return out.fillna(0)


@query(f"WITH {EVIDENCE} SELECT target, count(*) AS n FROM (SELECT target FROM e UNION SELECT s_suppkey + 50 FROM supplier) GROUP BY 1")
def universe_union(spark, d):
    more = read(spark, d, "supplier").select((F.col("s_suppkey") + 50).alias("target"))
    return evidence(spark, d).select("target").union(more).distinct().groupBy("target").agg(F.count("*").alias("n"))


@query(f"WITH {EVIDENCE}, k AS (SELECT ligand, target, source FROM e WHERE day <= DATE '{TRAIN_END}'), n AS (SELECT 'new:' || pub AS id, ligand, target, source, p FROM e WHERE day > DATE '{TRAIN_END}') SELECT ligand, target, source, round(max(p), 6) AS best, min(id) AS id FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.ligand = n.ligand AND k.target = n.target AND k.source = n.source) GROUP BY 1, 2, 3")
def merge_new_evidence(spark, d):
    e, keys = evidence(spark, d), ["ligand", "target", "source"]
    known = e.where(F.col("day") <= F.lit(TRAIN_END)).select(*keys)
    new = e.where(F.col("day") > F.lit(TRAIN_END)).withColumn("id", F.concat(F.lit("new:"), "pub"))
    return new.join(known, keys, "left_anti").groupBy(*keys).agg(F.round(F.max("p"), 6).alias("best"), F.min("id").alias("id"))


@query(f"WITH {_EDGES}, r AS (SELECT ligand, row_number() OVER (ORDER BY best DESC, ligand) AS a, row_number() OVER (ORDER BY n DESC, ligand) AS b FROM g WHERE target = 3), c AS (SELECT count(*) AS c FROM r) SELECT ligand, CASE WHEN a <= 20 AND b <= 20 THEN 'both' WHEN a <= 20 THEN 'potency_only' ELSE 'evidence_only' END AS bucket, a > c / 2 OR b > c / 2 AS far FROM r, c WHERE a <= 20 OR b <= 20")
def rank_disagreement(spark, d):
    g = _pairs(spark, d).where("target = 3")
    size = F.broadcast(g.agg(F.count("*").alias("c")))
    g = global_row_numbers(global_row_numbers(g, "best", "ligand", out="a"), "n", "ligand", out="b").join(size)
    a, b = F.col("a") <= 20, F.col("b") <= 20
    half = F.col("c") / 2
    return g.where(a | b).select("ligand", F.when(a & b, "both").when(a, "potency_only").otherwise("evidence_only").alias("bucket"), ((F.col("a") > half) | (F.col("b") > half)).alias("far"))


@query(f"WITH {EVIDENCE} SELECT target, array_to_string(list_sort(list(line)), ',') AS agreed FROM (SELECT target, line FROM e GROUP BY 1, 2 HAVING count(DISTINCT source) >= 3) GROUP BY 1")
def vote_consensus_sets(spark, d):
    votes = evidence(spark, d).groupBy("target", "line").agg(F.countDistinct("source").alias("n")).where("n >= 3")
    return votes.groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("line")), ",").alias("agreed"))


@query(f"WITH {EVIDENCE} SELECT ligand FROM e GROUP BY 1 HAVING count(DISTINCT source) = 3")
def sources_complete(spark, d):
    return evidence(spark, d).groupBy("ligand").agg(F.countDistinct("source").alias("n")).where("n = 3").select("ligand")


_SPLIT = f"CASE WHEN day <= DATE '{TRAIN_END}' THEN 'train' WHEN day <= DATE '1999-12-31' THEN 'dev' ELSE 'test' END"


def split_of(day="day"):
    return F.when(F.col(day) <= F.lit(TRAIN_END), "train").when(F.col(day) <= F.lit("1999-12-31"), "dev").otherwise("test")


@query(f"WITH {EVIDENCE}, k AS (SELECT DISTINCT {_SPLIT} AS split, kind, k FROM (SELECT day, 'pair' AS kind, ligand || ':' || target AS k FROM e UNION ALL SELECT day, 'pub', pub::VARCHAR FROM e UNION ALL SELECT day, 'ligand', ligand::VARCHAR FROM e)) SELECT a.kind, a.split AS split_a, b.split AS split_b, count(*) AS n FROM k a JOIN k b USING (kind, k) WHERE a.split < b.split GROUP BY 1, 2, 3")
def overlap_matrix(spark, d):
    """Keys that two splits share: each key's splits as bits, keys then counted by what splits they have."""
    names = ("dev", "test", "train")
    s = split_of()
    e = evidence(spark, d).select("ligand", "target", "pub", F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i))]), s).alias("bit"))
    masks = lambda kind, *k: e.groupBy(*k).agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    counts = masks("pair", "ligand", "target").unionByName(masks("pub", "pub")).unionByName(masks("ligand", "ligand"))
    pairs = [F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.lit(1 << i | 1 << j).alias("both")) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    rows = counts.select("kind", "mask", "n", F.inline(F.array(*pairs))).where(F.col("mask").bitwiseAND(F.col("both")) == F.col("both"))
    return rows.groupBy("kind", "split_a", "split_b").agg(F.sum("n").alias("n"))


@query(f"WITH {EVIDENCE}, t AS (SELECT user_id AS ligand, list(DISTINCT event_type) AS s FROM events WHERE value > 80 GROUP BY 1), u AS (SELECT user_id AS ligand, list(DISTINCT event_type) AS s FROM events WHERE value > 40 GROUP BY 1) SELECT ligand, round(len(list_intersect(t.s, u.s)) / len(u.s), 6) AS prec, round(len(list_intersect(t.s, u.s)) / len(t.s), 6) AS recall FROM t JOIN u USING (ligand)".replace(f"WITH {EVIDENCE}, t", "WITH t"))
def set_precision_recall(spark, d):
    ev = read(spark, d, "events").groupBy(F.col("user_id").alias("ligand")).agg(
        F.collect_set(F.when(F.col("value") > 80, F.col("event_type"))).alias("t"), F.collect_set(F.when(F.col("value") > 40, F.col("event_type"))).alias("u")
    )
    both = F.size(F.array_intersect("t", "u"))
    return ev.where("size(t) > 0").select("ligand", F.round(both / F.size("u"), 6).alias("prec"), F.round(both / F.size("t"), 6).alias("recall"))


@query("WITH a AS (SELECT p_partkey AS id, p_brand AS kind, p_type AS st FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_brand, p_type FROM part WHERE p_size < 40) SELECT kind, st, count(*) AS n FROM (SELECT DISTINCT id, kind, st FROM a) GROUP BY 1, 2")
def union_dedupe_histogram(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_type").alias("st"), "p_size")
    rows = p.where("p_size > 25").drop("p_size").unionByName(p.where("p_size < 40").drop("p_size"))
    return rows.dropDuplicates(["id"]).groupBy("kind", "st").agg(F.count("*").alias("n"))


@query("SELECT p_name, count(DISTINCT p_brand) AS n_values, min(p_brand) AS first_value FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def conflicting_keys(spark, d):
    return read(spark, d, "part").groupBy("p_name").agg(F.countDistinct("p_brand").alias("n_values"), F.min("p_brand").alias("first_value")).where("n_values > 1")


@query("""WITH q AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN n_name WHEN s_suppkey % 4 = 1 THEN r_name WHEN s_suppkey % 4 = 2 THEN 'n' || s_nationkey ELSE 'unknown' END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT id, n_nationkey::BIGINT AS resolved, CASE WHEN q.label = n_name THEN 'name' WHEN q.label = r_name THEN 'region' WHEN q.label = 'n' || n_nationkey THEN 'code' ELSE 'unresolved' END AS reason FROM q LEFT JOIN (SELECT * FROM nation JOIN region ON r_regionkey = n_regionkey) n ON q.label = n_name OR q.label = r_name OR q.label = 'n' || n_nationkey""")
def resolve_cascade_fanout(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    q = read(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey") % 4
    q = q.select(F.col("s_suppkey").alias("id"), F.when(k == 0, F.col("n_name")).when(k == 1, F.col("r_name")).when(k == 2, F.concat(F.lit("n"), "s_nationkey")).otherwise("unknown").alias("label"))
    by = lambda c, reason: n.select(c.alias("label"), L("n_nationkey").alias("resolved"), F.lit(reason).alias("reason"))
    lexicon = by(F.col("n_name"), "name").unionByName(by(F.col("r_name"), "region")).unionByName(by(F.concat(F.lit("n"), "n_nationkey"), "code"))
    return q.join(lexicon, "label", "left").select("id", "resolved", F.coalesce("reason", F.lit("unresolved")).alias("reason"))


@query("SELECT count(*) AS n_selected, count(p_partkey) AS n_matched, count(*) - count(p_partkey) AS n_missing, array_to_string((list_sort(list(k) FILTER (WHERE p_partkey IS NULL)))[1:5], ',') AS sample FROM (SELECT DISTINCT l_partkey + 40 AS k FROM lineitem) LEFT JOIN part ON p_partkey = k")
def match_accounting(spark, d):
    wanted = read(spark, d, "lineitem", "l_partkey").select((F.col("l_partkey") + 40).alias("k")).distinct()
    m = wanted.join(read(spark, d, "part", "p_partkey").withColumn("hit", F.lit(1)).withColumnRenamed("p_partkey", "k"), "k", "left")
    sample = m.where("hit is null").orderBy("k").limit(5).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("sample"))
    return m.agg(F.count("*").alias("n_selected"), F.count("hit").alias("n_matched"), F.count_if(F.col("hit").isNull()).alias("n_missing")).join(F.broadcast(sample))
