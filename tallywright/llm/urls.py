"""URL rules, indexed by their rarest literal token, so that a URL meets few regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallywright.llm._store import BROADCAST_BYTES, materialize, small_side
from tallywright.llm._words import give_back

#: Up to so many rules the index goes whole to every task; more meet the URLs' tokens in a join.
INDEX_RULES = 200_000

_TOKEN = "[a-z0-9]+"
#: A rule's literal tokens: what wildcards and open ends don't touch, so that a URL that fits the rule has them as whole tokens.
_LITERAL = re.compile(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])")
_ESCAPE = re.compile(r"([\\.+?()\[\]{}$|\-#&~])")
_UPPER_CASE, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER_CASE, _LOWER_CASE)


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER_CASE, _LOWER_CASE)


def path(url: Column) -> Column:
    """What stands between the host and the next ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal(url: Column) -> Column:
    """What rules are held against: ://, the host in lower case, and the rest as it is; empty where there is no host to judge."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.concat(F.lit("://"), host(url), rest)).otherwise("")


def compiled(pattern: str) -> tuple[str, list[str]]:
    """The regular expression (of Python and Java alike) over normal(), and the literal tokens, of a rule.

    `||` at the start anchors at the host or one of its parents, a single `|` at
    the start or end anchors there, `*` stands for anything and `^` for one
    character that is neither a letter nor a digit nor one of `_-.%`, or the end. All else is
    literal; the host is lower case, the rest is compared as it is written.
    """
    text, front, back = pattern, "", ""
    if text.startswith("||"):
        text, front = text[2:], "^://([^/?#]*\\.)?"
    elif text.startswith("|"):
        text, front = text[1:], "^"
    if text.endswith("|"):
        text, back = text[:-1], "(?!.)"
    body = "".join(".*" if c == "*" else "([^A-Za-z0-9_.%-]|(?!.))" if c == "^" else _ESCAPE.sub(r"\\\1", c) for c in text)
    # An end that isn't anchored may lie within a token of the URL.
    open_text = ("" if front else "*") + text.translate(_LOWER) + ("" if back else "*")
    return f"(?s){front}{body}{back}", sorted(set(_LITERAL.findall(open_text)))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """rules (rule, pattern, verdict, level) with regex and token, the literal token that the fewest URLs have (ties: the first); null without one.

    A rule's level is how it stands to others, null the lowest. Only tokens of rules are counted, by sums that each task makes before
    anything moves. Rules without a whole literal token are held against every
    URL, which is what their pattern asks for. Rules with a null pattern fit
    nothing and are left out; repeated rules are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [compiled(p) for p in batch.column(1).to_pylist()]
            extra = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["rule", "pattern", "verdict", "level", "regex", "tokens"])

    known = rules.select(F.col("rule").cast("string"), F.col("pattern").cast("string"), F.col("verdict").cast("string"), F.coalesce(F.col("level").cast("int"), F.lit(-(1 << 30))).alias("level"))
    known = known.where("pattern is not null").distinct()
    known = materialize(known.mapInArrow(run, "rule string, pattern string, verdict string, level int, regex string, tokens array<string>"), "rules")
    mine = materialize(known.select(F.explode("tokens").alias("token")).distinct(), "rule_tokens")
    found = urls.select(F.explode(F.array_distinct(tokens(F.col("url")))).alias("token"))
    counts = found.join(small_side(mine), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # Tokens that no URL has are the rarest.
    each = known.select("pattern", F.explode("tokens").alias("token")).distinct().join(counts, "token", "left")
    rarest = each.groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    return known.join(rarest.select("pattern", F.col("r.token").alias("token")), "pattern", "left").select("rule", "pattern", "verdict", "level", "regex", "token")


def tokens(url: Column) -> Column:
    """The runs of ASCII letters and digits of a URL, lower-cased."""
    return F.regexp_extract_all(F.translate(normal(url), _UPPER_CASE, _LOWER_CASE), F.lit(_TOKEN), F.lit(0))


def judge_urls(urls: DataFrame, rules: DataFrame, most: int = INDEX_RULES) -> DataFrame:
    """urls with host, path, rule, pattern and verdict: those of the rule that wins among all that fit the URL, else null.

    rules are (rule, pattern, verdict, level); of those that fit, the one of the
    highest level wins, then the longest pattern, then the first in order. A
    rule is found through its rarest literal token: a URL looks its own tokens up and
    runs the regular expressions of what it finds and no others. The index goes to
    each task, where URLs are judged as they lie and nothing is shuffled; if it has over
    `most` rules or takes over BROADCAST_BYTES, different URLs meet it by token in a join instead,
    with the same result.

    A null or empty URL, or one without ://, has an empty host and path and fits
    nothing. Repeated rows are judged each; URLs may be of any length; other columns
    pass through, but for ones named host, path, rule, pattern or verdict, which are replaced.
    """
    index = materialize(index_rules(rules, urls.select("url")), "rule_index")
    n, size = index.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("regex") + F.octet_length("pattern") + F.octet_length("rule")), F.lit(0))).first()
    rest = urls.drop("host", "path", "rule", "pattern", "verdict")
    judged = _in_tasks(rest, index) if n <= most and size <= BROADCAST_BYTES else _by_join(rest, index)
    return judged.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})


def _in_tasks(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Judged where they lie; the index is within the bounds that judge_urls() has checked."""
    by_token: dict[str | None, list[tuple]] = {}
    for r in index.collect():
        out = r["rule"], r["pattern"], r["verdict"]
        rank = -r["level"], -len(r["pattern"]), r["pattern"], r["rule"] or "", r["verdict"] or ""
        by_token.setdefault(r["token"], []).append((r["regex"], rank, out))
    for found in by_token.values():
        found.sort(key=lambda x: x[1])
    shipped = urls.sparkSession.sparkContext.broadcast(by_token)
    names = urls.columns
    at = names.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = {k: [(re.compile(x), rank, out) for x, rank, out in v] for k, v in shipped.value.items()}
        token = re.compile(_TOKEN)
        for batch in batches:
            won = []
            for text in batch.column(at).to_pylist():
                cut = (text or "").partition("://")
                best, result = None, (None, None, None)
                if cut[1]:
                    end = re.search(r"[/?#]", cut[2])
                    end = end.start() if end else len(cut[2])
                    whole = "://" + cut[2][:end].translate(_LOWER) + cut[2][end:]
                    for t in {None, *token.findall(whole.translate(_LOWER))}:
                        for regex, rank, out in rules.get(t, ()):
                            if best is not None and rank >= best:
                                break
                            if regex.search(whole):
                                best, result = rank, out
                won.append(result)
            extra = [pa.array([w[i] for w in won], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "rule", "pattern", "verdict"])
        give_back()

    return urls.mapInArrow(run, StructType([*urls.schema.fields, *(StructField(c, StringType()) for c in ("rule", "pattern", "verdict"))]))


def _by_join(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Different URLs by their tokens and rules by theirs, joined; only the winners go back to the rows."""
    different = urls.select("url").where("url is not null").distinct()
    different = different.withColumn("__whole", normal(F.col("url"))).where("__whole <> ''")
    found = different.select("url", "__whole", F.explode(F.array_append(F.array_distinct(tokens(F.col("url"))), F.lit(""))).alias("token"))
    fits = found.join(index.withColumn("token", F.coalesce("token", F.lit(""))), "token").where(F.regexp_like("__whole", F.col("regex")))
    order = F.struct((-F.col("level")).alias("l"), (-F.length("pattern")).alias("n"), "pattern", "rule", "verdict")
    best = fits.groupBy("url").agg(F.min(order).alias("__w"))
    return urls.join(best, "url", "left").select(*[urls[c] for c in urls.columns], "__w.rule", "__w.pattern", "__w.verdict")
