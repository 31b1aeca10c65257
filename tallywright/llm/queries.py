"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import bpe, chat, codes, covertree, filters, media, minhash, packing, pii, tokens, toxicity, urls, warc
from tallywright.shipping import ship

BYTE_BPE, WORD_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
CONTEXT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE],
        F.sha2(pii.told(base).cast("binary"), 256).alias("base_sha256"),
        pii.told(F.col("pii")).alias("spans"),
    )


def op3_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_column(_table(spark, sf_dir, "documents"), "doc_id")
    return media.media_features(stored, "doc_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.encode_texts(docs, path, pattern, decoded=True)
    ids = F.col("token_ids")
    return decoded.select(
        "doc_id",
        F.when(ids == "", F.lit(0)).otherwise(F.length(ids) - F.length(F.translate(ids, " ", "")) + 1).cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    return tokens.length_histogram(counts)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_pieces(packing.cut_pieces(docs, public_tokenizers.path(WORD_BPE), limit=CONTEXT), CONTEXT)


#: The text of both turns of conversation -7.
_ODD_TEXT = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_ODD_TEXT).alias("text"),
    )
    trees = chat.linear_trees(rows.unionByName(odd))
    back = chat.read_back(chat.format_paths(chat.best_paths(trees)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.expr("try_cast(tree as bigint)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("*", F.lit(codes.digest(books)).alias("codebooks_sha256"))


#: Rules by host and path, the longest of which decides.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: What decides about other URLs: shops, bets, link farms, trackers, and pages that hold no text of their own.
URL_PATTERNS = (
    ("-pills.", "block"), ("-bets.", "block"), ("-farm.", "block"), ("||casino.", "block"), ("||ads-track.", "block"), ("||ads.", "block"), ("||tracker.", "block"),
    ("/wp-admin/", "block"), ("/wp-login.php", "block"), ("/cart/", "block"), ("/login|", "block"), ("?sessionid=", "block"), ("&sessionid=", "block"),
    ("/print/", "block"), ("/login/help/", "allow"), ("/robots.txt|", "allow"),
)


def url_rules(spark: SparkSession) -> DataFrame:
    """The rules of both kinds, host rules a level above patterns."""
    rows = [(rule, f"||{rule}", verdict, 1) for rule, verdict in HOST_RULES] + [(p, p, verdict, 0) for p, verdict in URL_PATTERNS]
    return spark.createDataFrame(rows, "rule string, pattern string, verdict string, level int")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), url_rules(spark))
    rule = F.when(F.col("rule").isin(*[r for r, _ in HOST_RULES]), F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.col("pattern").alias("matched"))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    conditions = {"A": filters.fails_few_words(text), "B": filters.fails_repeated_words(text), "C": filters.fails_capitals(text), "D": filters.fails_symbols(text)}
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filters.audit(docs, _table(spark, sf_dir, "labels"), conditions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_warc, op2_pii, op3_covertree, op4_media, op5_bpe, op6_minhash, op7_toxicity, op8_token_counts, op9_packing, op10_chat,
            op11_codes, op12_urls, op13_filters,
        )
    }


_SHA1_BASE32 = """
list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (1 + ((('0x' || substr(sha, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), lambda a, b: a || b)"""

OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
r AS (SELECT sha, max(page_id) AS response FROM p GROUP BY sha)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_SHA1_BASE32} AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN r USING (sha)"""

OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(t)
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<turn>' || replace(regexp_replace(replace(role, '\', '\\'), '<(/?turn)', '<\\\1', 'g'), chr(10), '\' || chr(10)) || chr(10)
    || regexp_replace(replace(text, '\', '\\'), '<(/?turn)', '<\\\1', 'g') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * n_both >= 75 * (na.n + nb.n - n_both)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


#: Integers, parts, and codebooks as rows (p, i, c); rounds as steps of the same two queries.
_ASSIGN = """
n{k} AS (SELECT v.vec_id, v.rn, v.p, arg_min(b.i, [d, b.i]) AS i, min(d) AS d FROM (
  SELECT x.*, b.i AS bi, list_sum([(x.c[j] - b.c[j]) * (x.c[j] - b.c[j]) for j in range(1, len(x.c) + 1)])::BIGINT AS d FROM x JOIN b{k} b ON b.p = x.p) v JOIN b{k} b ON b.p = v.p AND b.i = v.bi GROUP BY 1, 2, 3)"""
_UPDATE = """
m{k} AS (SELECT n.p, n.i, j, sum(x.c[j]) AS s, count(*) AS n FROM n{k} n JOIN x ON x.rn = n.rn AND x.p = n.p, range(1, (SELECT max(len(c)) FROM x) + 1) AS r(j) GROUP BY 1, 2, 3),
u{k} AS (SELECT p, i, list((s - ((s % n) + n) % n)::BIGINT // n::BIGINT ORDER BY j) AS c FROM m{k} GROUP BY 1, 2),
b{l} AS (SELECT b.p, b.i, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN u{k} u ON u.p = b.p AND u.i = b.i)"""

OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rn, [floor(256 * y::DOUBLE)::BIGINT for y in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), x AS (SELECT vec_id, rn, p::INT AS p, e[p * (len(e) // 16) + 1:(p + 1) * (len(e) // 16)] AS c FROM v, range(16) AS r(p)),
b0 AS (SELECT p, (rn - 1)::INT AS i, c FROM x WHERE rn <= 64),
{_ASSIGN.format(k=0)}, {_UPDATE.format(k=0, l=1)}, {_ASSIGN.format(k=1)}, {_UPDATE.format(k=1, l=2)}, {_ASSIGN.format(k=2)},
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM b2),
t AS (SELECT rn, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n2 GROUP BY rn)
SELECT v.vec_id, v.label, t.code, t.error, sum(t.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, s.codebooks_sha256 FROM v JOIN t USING (rn), s"""


def _fits(pattern: str) -> str:
    """A pattern's condition over u (the normal form) in SQL: what it has to contain, begin a host with, or end with."""
    if pattern.startswith("||"):
        return f"(starts_with(u, '://{pattern[2:]}') OR contains(regexp_extract(u, '^://[^/?#]*'), '.{pattern[2:]}'))"
    return f"suffix(u, '{pattern[:-1]}')" if pattern.endswith("|") else f"contains(u, '{pattern}')"


_BY_LENGTH = sorted(URL_PATTERNS, key=lambda r: (-len(r[0]), r[0]))
_HOST_CASES = "\n".join(
    f"  WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{rule}'"
    for rule, h, p in ((r, r.partition("/")[0], "/" + r.partition("/")[2]) for r, _ in sorted(HOST_RULES, key=lambda r: -len(r[0])))
)
OP12_SQL = f"""
WITH s AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(.*)$', 1) AS rest,
    coalesce(contains(url, '://'), false) AS known FROM pages
), u AS (SELECT *, CASE WHEN known THEN '://' || host || rest ELSE '' END AS u FROM s),
r AS (SELECT *, CASE
{_HOST_CASES} END AS rule, CASE
{chr(10).join(f"  WHEN {_fits(p)} THEN '{p}'" for p, _ in _BY_LENGTH)} END AS method FROM u)
SELECT page_id, host, path, rule, coalesce('||' || rule, method) AS matched, CASE coalesce('||' || rule, method)
{chr(10).join(f"  WHEN '{p}' THEN '{v}'" for p, v in [*((f"||{r}", v) for r, v in HOST_RULES), *URL_PATTERNS])} ELSE 'allow' END AS verdict FROM r"""

OP13_SQL = """
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, ['A', 'B', 'C', 'D', 'E'] AS names, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(copy, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
i AS (SELECT i FROM range(1, 6) AS r(i)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, step, o[step] AS f, o[:step - 1] AS before FROM o, range(1, 6) AS r(step)),
x AS (
  SELECT part, o, step, f, sum(n) FILTER (WHERE NOT gone AND NOT fails[f]) AS kept, sum(n) FILTER (WHERE NOT gone AND fails[f]) AS removed,
    sum(n) FILTER (WHERE gone AND fails[f]) AS redundant, sum(n) FILTER (WHERE fails[f] AND alone) AS unique_fails,
    sum(good) FILTER (WHERE NOT gone AND fails[f]) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND fails[f]) AS toxic_lost
  FROM (SELECT m.*, s.*, coalesce(list_bool_or([fails[j] for j in before]), false) AS gone, list_sum([b::INT for b in fails]) = 1 AS alone FROM m, s) GROUP BY 1, 2, 3, 4
)
SELECT part, array_to_string([chr((64 + j)::INT) for j in o], '') AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM x"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_covertree": OP3_SQL, "op6_minhash": OP6_SQL, "op1_warc": OP1_SQL, "op10_chat": OP10_SQL,
        "op11_codes": OP11_SQL, "op12_urls": OP12_SQL, "op13_filters": OP13_SQL,
    }
