"""What document filters remove, alone and after one another, with exact duplicates found through fingerprints."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm._store import discard, materialize, small_side
from tallywright.shipping import ship

#: Copies of one text that meet in one chain; more are dealt out first, and those that are left meet again.
COPIES = 4096
#: Texts of a map task that are held to drop copies before anything moves: so many characters.
HELD = 16 << 20
#: Records, and bytes of texts, of a partition of chains, before copies within map tasks are dropped.
ROUTED, ROUTED_BYTES = 20_000, 64 << 20


def words(text: Column) -> Column:
    """The maximal runs of anything but ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def fails_few_words(text: Column, least: int = 200) -> Column:
    """Fewer than `least` words."""
    return F.size(words(text)) < least


def fails_repeated_words(text: Column, percent: int = 50) -> Column:
    """Under `percent` in a hundred of the words are different."""
    w = words(text)
    return 100 * F.size(F.array_distinct(w)) < percent * F.size(w)


def fails_capitals(text: Column, percent: int = 2) -> Column:
    """Over `percent` in a hundred of the code points are A to Z."""
    return 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > percent * F.length(text)


def fails_symbols(text: Column, symbols: str = "#$%&*|") -> Column:
    """Holds any of the symbols."""
    return F.length(F.translate(text, symbols, "")) < F.length(text)


def _chains(records: Iterable[tuple], held: int | None = None) -> Iterator[tuple]:
    """Records ((fingerprint, lot), text, id, payload, n) of one text each; of each text only those of the least id are left, n counting equal ones.

    Texts of one key stand in a chain and are compared whole, so equal
    fingerprints of different texts do no harm. As soon as an id is known not to
    be its text's least, its record is emitted as (True, record), and those that are left
    at the end as (False, record). With `held`, the chains are given up as left
    whenever their texts exceed so many characters.
    """
    chains: dict[tuple, list[list]] = {}
    size = 0

    def left() -> Iterator[tuple]:
        for key, chain in chains.items():
            for text, least, payloads in chain:
                for payload, n in payloads.items():
                    yield False, (key, text, least, payload, n)

    for key, text, at, payload, n in records:
        for entry in (chain := chains.setdefault(key, [])):
            if entry[0] == text:
                break
        else:
            chain.append([text, at, Counter({payload: n})])
            size += len(text) + 200
            if held is not None and size > held:
                yield from left()
                chains.clear()
                size = 0
            continue
        if at > entry[1]:
            yield True, (key, text, at, payload, n)
        elif at == entry[1]:
            entry[2][payload] += n
        else:
            for old, k in entry[2].items():
                yield True, (key, text, entry[1], old, k)
            entry[1:] = [at, Counter({payload: n})]
    yield from left()


def _route(records: RDD, parts: int) -> RDD:
    """(lost, record) of all records: copies within a task are dropped, then the rest meets in the partition of its fingerprint and lot.

    What a task has lost needs no chain: it goes along without its text, dealt by its id.
    """

    def near(it: Iterator[tuple]) -> Iterator[tuple]:
        for lost, (key, text, *rest) in _chains(it, HELD):
            yield ((key[0] + rest[0], -1), (None, *rest)) if lost else (key, (text, *rest))

    def far(it: Iterator[tuple]) -> Iterator[tuple]:
        passed: list[tuple] = []

        def mine() -> Iterator[tuple]:
            for key, value in it:
                if key[1] >= 0:
                    yield key, *value
                else:
                    passed.append((key, *value))

        for lost, (key, text, *rest) in _chains(mine()):
            yield lost, (key, None if lost else text, *rest)
            while passed:
                yield True, passed.pop()
        yield from ((True, r) for r in passed)

    return records.mapPartitions(near).partitionBy(parts, lambda key: key[0] ^ (key[1] * 0x9E3779B1)).mapPartitions(far)


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", payload: dict[str, Column] | None = None) -> DataFrame:
    """(key, the payload's columns, copy, n): whether a smaller key has the same text, of rows counted by equal values.

    A text's fingerprint is its xxhash64. Only rows whose fingerprint occurs
    with another key are routed: as records to the partition of their fingerprint, where
    chains hold each different text whole with its least key. What a task has in
    copies of one text it drops before anything moves, and texts of over COPIES
    copies are dealt in lots first, whose least meet again. Rows with a null key
    are no copies and make none; a null text is empty; rows of equal key and
    text are no copies of each other. The result lies in the shared folder.
    """
    spark, payload = docs.sparkSession, payload or {}
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    at, fingerprint = F.col(key).cast("long").alias("__id"), F.xxhash64(whole).alias("__print")
    extra = [c.alias(name) for name, c in payload.items()]
    prints = materialize(docs.select(at, fingerprint, F.octet_length(whole).cast("long").alias("__size"), *extra), "prints")
    again = prints.where("__id is not null").groupBy("__print").agg(F.count("*").alias("__n"), F.sum("__size").alias("size"), F.min("__id").alias("a"), F.max("__id").alias("b"))
    again = materialize(again.where("a < b").select("__print", "__n", "size"), "repeated")
    most, total, size = again.agg(F.coalesce(F.max("__n"), F.lit(0)), F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    few = small_side(again.select("__print", "__n"))
    out = [F.col("__id").alias(key), *payload, F.lit(False).alias("copy"), F.lit(1).cast("long").alias("n")]
    alone = prints.where("__id is not null").join(few, "__print", "left_anti").select(*out).unionByName(prints.where("__id is null").select(*out))
    if not total:
        return materialize(alone, "marked")
    # The payload is made after the join, for what is routed alone.
    lots = F.ceil(F.col("__n") / COPIES).cast("int")
    routed = docs.withColumn("__print", fingerprint).join(few, "__print").where(F.col(key).isNotNull())
    routed = routed.select("__print", F.pmod(F.xxhash64(F.col(key).cast("long")), lots).cast("int").alias("__lot"), whole.alias("__text"), at, *extra)
    parts = max(-(-total // ROUTED), -(-size // ROUTED_BYTES), spark.sparkContext.defaultParallelism)
    found = _route(routed.rdd.map(lambda r: ((r[0], r[1]), r[2], r[3], tuple(r[4:]), 1)), parts)
    lost = []
    while most > COPIES:
        # Of each text and lot the records of one id are left: these meet in fewer lots, at last in one.
        most = -(-most // COPIES)
        count = -(-most // COPIES)
        lost.append(found.filter(lambda x: x[0]))
        found = _route(found.filter(lambda x: not x[0]).map(lambda x, k=count: ((x[1][0][0], x[1][0][1] % k), *x[1][1:])), parts)
    every = spark.sparkContext.union([*lost, found]).map(lambda x: (x[1][2], *x[1][3], x[0], x[1][4]))
    marked = materialize(alone.unionByName(spark.createDataFrame(every, alone.schema, verifySchema=False)), "marked")
    discard(prints, again)
    return marked


def _steps(names: str, part: str, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """All orders' steps from the counts by failure mask of one part."""
    mask = np.arange(len(n))
    fails = [(mask >> i & 1).astype(bool) for i in range(len(names))]
    rows = []
    shares: Counter[int] = Counter()
    for order in permutations(range(len(names))):
        alive = np.ones(len(n), bool)
        for step, f in enumerate(order, 1):
            here, earlier = alive & fails[f], ~alive & fails[f]
            alive = alive & ~fails[f]
            removed = int(n[here].sum())
            shares[f] += removed
            counts = int(n[alive].sum()), removed, int(n[earlier].sum()), int(n[1 << f]), int(good[here].sum()), int(toxic[here].sum())
            rows.append((part, "".join(names[i] for i in order), step, f, counts))
    for part_, order_, step, f, counts in rows:
        yield (part_, order_, step, *counts, shares[f])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str = "E", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the filters in every part.

    filters are failure conditions over docs (doc_id, text, part, ...) by a
    letter each; null conditions don't fail. Filter `copies` is failed by a row whose text equals that
    of any smaller doc_id. Each part's rows are counted by the mask of
    filters that they fail; the vectors of these counts are merged by
    combineByKey, and all orders are worked out of them. labels are (doc_id,
    quality, toxic): a document is good or toxic if any row of its id says so.

    A null part is the empty string, a null text is empty, a null doc_id has no
    smaller one and no label. Repeated rows count each; an empty table gives no
    rows; other columns do nothing; texts of any length are read whole.
    """
    ship(docs.sparkSession)
    names = "".join(filters) + copies
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.withColumn("text", text)
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))
    marked = mark_copies(whole, payload={"__part": F.coalesce(F.col(part).cast("string"), F.lit("")), "__mask": mask})
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"__{c}")
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = materialize(known.agg(flag("quality"), flag("toxic")), "label_flags")
    marked = marked.join(small_side(known), "doc_id", "left")
    marked = marked.select(
        "__part",
        (F.col("__mask") + F.when(F.col("copy"), 1 << len(filters)).otherwise(0)).alias("mask"),
        F.coalesce("__quality", F.lit(0)).alias("good"),
        F.coalesce("__toxic", F.lit(0)).alias("toxic"),
        "n",
    )
    size = 1 << len(names)

    def add(vector: np.ndarray, row: tuple) -> np.ndarray:
        at, good, toxic, n = row
        vector[:, at] += (n, n * good, n * toxic)
        return vector

    vectors = marked.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add(np.zeros((3, size), np.int64), row), add, lambda a, b: a + b)
    steps = vectors.flatMap(lambda kv: _steps(names, kv[0], *kv[1]))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(steps, schema, verifySchema=False)

