"""Near duplicates by HyperMinHash sketches, confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm._components import connected_components
from tallywright.llm._store import discard, materialize, small_side
from tallywright.llm._words import WHITE, blocks, give_back, mix, word_hashes

WORDS = 5
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Buckets of a sketch, BANDS bands of ROWS. Two sets of similarity 0.75 share no
#: band with a chance of (1 - 0.75 ** 4) ** 40, 3 in 10 million.
ROWS, BANDS = 4, 40
BUCKETS = ROWS * BANDS
#: Bits of a register's mantissa; the leading-zero count stands above them.
MANTISSA = 10
EMPTY = 0xFFFF
#: Two registers that differ in their minimum agree with a chance of 0.1699 * 2 ** -MANTISSA.
COLLISION = 0.169919487159739 * 2.0**-MANTISSA
#: Sets of at most SMALL shingles fill too few buckets: these meet in the least
#: hashes of their sets instead, which lose no link; so do sets of up to SMALL / 0.75.
SMALL = 12
#: Characters of texts that are confirmed together.
VERIFY = 4 << 20
#: A bucket of documents is compared in blocks of so many, or of sets of so many shingles together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: A bucket that takes more pairs of blocks, and has more documents outside its largest component, is told apart by its documents' rarest shingles instead.
MOST_BLOCKS, MOST_OTHERS = 4, 64
#: Shingles that so many documents of such buckets have are ordered by their number, at most so many of them; all others come before, by their hash.
FREQUENT, FREQUENT_ROWS = 8, 1_000_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: all sets' shingle hashes (sorted in each set), the text of each, word hashes, and words a text.

    Shingles are 5 words in a row; a text of 1 to 4 words has one, the whole of it.
    """
    w, n = word_hashes(texts, WHITE)
    of = np.repeat(np.arange(len(texts)), n)
    runs = max(0, len(w) - WORDS + 1)
    s = sum((w[j : j + runs] * _ODD[j] for j in range(WORDS)), np.zeros(runs, np.uint64))
    whole = of[: len(s)] == of[WORDS - 1 :] if len(s) else np.zeros(0, bool)
    s, owner = mix(s[whole]), of[: len(s)][whole]
    start = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < WORDS))
    few = [mix(np.array([sum(int(w[start[i] + j]) * int(_ODD[j]) for j in range(n[i])) + int(n[i]) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] for i in short]
    s, owner = np.concatenate([s, np.array(few, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], owner[new], w, n


def registers(shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """HyperMinHash sketches, n x BUCKETS of 16 bits: each bucket's least 32-bit value as leading zeros and the next MANTISSA bits."""
    v = mix(shingles ^ _ODD[0])
    bucket = ((v >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    least = np.full(n * BUCKETS, 1 << 32, np.int64)
    np.minimum.at(least, owner * BUCKETS + bucket.astype(np.int64), (v & np.uint64(0xFFFFFFFF)).astype(np.int64))
    bits = np.frexp(least.astype(np.float64))[1]  # 0 has none
    zeros = 32 - bits
    rest = (least << np.minimum(zeros + 1, 32)) & 0xFFFFFFFF
    out = (zeros << MANTISSA) | (rest >> (32 - MANTISSA))
    return np.where(least == 1 << 32, EMPTY, out).astype(np.uint16).reshape(n, BUCKETS)


def similarity_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of sketches (row by row, or broadcast), without chance agreements, and buckets that either fills."""
    filled = (a != EMPTY) | (b != EMPTY)
    used = filled.sum(axis=-1)
    same = ((a == b) & filled).sum(axis=-1)
    share = same / np.maximum(used, 1)
    return np.clip((share - COLLISION) / (1 - COLLISION), 0, 1), used


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the estimate is within 6 standard deviations of the threshold or above."""
    t = PERCENT / 100
    estimate, used = similarity_of(a, b)
    return estimate >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, n_shingles, registers, least) of documents (doc_id, text).

    d1 and d2 are a digest of the word sequence, null without words; least are
    the hashes by which small sets meet, null for others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in blocks(batches):
            block = [t.encode() if t else b"" for t in texts]
            s, owner, w, n = shingle_sets(block)
            size = np.bincount(owner, minlength=len(block))
            regs = registers(s, owner, len(block))
            at, end = np.cumsum(n) - n, np.cumsum(size)
            digest = [np.frombuffer(hashlib.blake2b(w[a : a + k].tobytes(), digest_size=16).digest(), np.int64).tolist() if k else [None] * 2 for a, k in zip(at, n, strict=True)]
            least = [
                s[e - k : e - k + k - -(-PERCENT * k // 100) + 1].view(np.int64).tolist() if 0 < k <= SMALL * 100 // PERCENT else None
                for k, e in zip(size.tolist(), end.tolist(), strict=True)
            ]
            columns = [*[pa.array([d[i] for d in digest], pa.int64()) for i in (0, 1)], pa.array(size, pa.int64())]
            columns += [pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "d1", "d2", "n_shingles", "registers", "least"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, d1 long, d2 long, n_shingles long, registers binary, least array<long>")


def _band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch."""
    r = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    band = r[..., 0] | r[..., 1] << np.uint64(16) | r[..., 2] << np.uint64(32) | r[..., 3] << np.uint64(48)
    return mix(mix(band) ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, id): one for each band that isn't empty, and for each of the least hashes of a small set."""
    for batch in batches:
        large = batch[batch["n_shingles"] > SMALL]
        if len(large):
            regs = np.frombuffer(b"".join(large["registers"]), np.uint16).reshape(-1, BUCKETS)
            filled = (regs != EMPTY).reshape(-1, BANDS, ROWS).any(axis=2)
            ids = np.broadcast_to(large["id"].to_numpy(np.int64)[:, None], filled.shape)
            yield pd.DataFrame({"key": _band_keys(regs)[filled].view(np.int64), "id": ids[filled]})
        few = batch[batch["least"].notna()]
        if len(few):
            yield pd.DataFrame({"key": few["least"], "id": few["id"]}).explode("key").astype({"key": "int64"})
    give_back()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those rows (a, b, text_a, text_b) whose full sets link, as (a, b); a few texts at a time are in memory as sets."""
    for batch in batches:
        ends = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in (2, 3)).cumsum()
        first = 0
        while first < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + VERIFY)) + 1
            part = batch.slice(first, stop - first)
            first = stop
            texts: dict[str, int] = {}
            a, b = ([texts.setdefault(t, len(texts)) for t in part.column(c).to_pylist()] for c in (2, 3))
            s, owner, _, _ = shingle_sets([t.encode() for t in texts])
            sets = np.split(s, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
            good = pa.array([_links(sets[i], sets[j]) for i, j in zip(a, b, strict=True)], pa.bool_())
            yield part.select([0, 1]).filter(good)
    give_back()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids whose full sets link.

    Only the texts of documents in pairs are moved, once for each pair.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "star_ids")
    texts = texts.join(small_side(ids), "id", "left_semi")
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(first, "a").join(second, "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Rows sorted by (key, lo, hi), with the ranges of whole groups of more than one row."""
    held: pd.DataFrame | None = None
    for batch in chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        group = rows[["key", "lo", "hi"]].to_numpy()
        cuts = (np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist()
        if batch is not None:
            held = rows.iloc[cuts[-1] if cuts else 0 :].reset_index(drop=True)
            rows = rows.iloc[: cuts[-1] if cuts else 0]
            cuts = cuts[:-1]
        if len(rows):
            yield rows, [(x, y) for x, y in zip([0, *cuts], [*cuts, len(rows)], strict=True) if y - x > 1]


def _candidates(rows: pd.DataFrame, a: int, b: int, regs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of a group, rows and those others of different components that they may link with.

    A pair meets in every band that it shares, or in every shingle that both have
    among their rarest; only the first one counts.
    """
    comp, own, size = rows["comp"].to_numpy()[a:b], rows["own"].to_numpy()[a:b], rows["n"].to_numpy()[a:b]
    inside = rows["lo"].iat[a] == rows["hi"].iat[a]
    names, counts = np.unique(comp, return_counts=True)
    main = comp == names[counts.argmax()]
    part, key = regs[a:b], rows["key"].iat[a]
    rare = [_unpacked(x) for x in rows["rare"].iloc[a:b]]
    mine = np.flatnonzero(_band_keys(part[:1])[0].view(np.int64) == key) if rare[0] is None else []
    order = np.lexsort((rows["id"].to_numpy()[a:b], size)).argsort()
    # Every pair across components has a row outside the largest one.
    for i in np.flatnonzero(~main):
        other = (comp != comp[i]) & (main | (np.arange(b - a) > i)) & (inside | (own != own[i]))
        other &= 100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i])
        at = np.flatnonzero(other)
        if len(at):
            at = at[may_link(part[i], part[at])]
        if len(at) and len(mine):
            same = (part[i] == part[at]).reshape(len(at), BANDS, ROWS).all(axis=2) & (part[i] != EMPTY).reshape(BANDS, ROWS).any(axis=1)
            at = at[same.argmax(axis=1) == mine[0]]
        elif len(at) and rare[i] is not None:
            at = np.array([j for j in at.tolist() if _first_met(rare, *((i, j) if order[i] < order[j] else (j, i))) == key], np.int64)
        if len(at):
            yield a + int(i), a + at


def _unpacked(rare: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """A document's keys as the smaller set of a pair, and as the larger one."""
    if rare is None:
        return None
    x = np.frombuffer(rare, np.int64)
    return x[1 : 1 + x[0]], x[1 + x[0] :]


def _first_met(rare: list, small: int, large: int) -> int | None:
    """The least key in which a pair meets."""
    if rare[small] is None or rare[large] is None:
        return None
    both = np.intersect1d(rare[small][0], rare[large][1], assume_unique=True)
    return int(both[0]) if len(both) else None


def _involved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each group that have a candidate."""
    for rows, groups in _grouped(batches):
        regs = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(-1, BUCKETS)
        some = np.zeros(len(rows), bool)
        for a, b in groups:
            for i, at in _candidates(rows, a, b, regs):
                some[i] = some[at] = True
        yield rows.loc[some]
    give_back()


def _joining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the involved rows with sets, links that join components: each candidate pair whose sets link, unless it is joined already."""
    for rows, groups in _grouped(batches):
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        regs = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(-1, BUCKETS)
        ids, comp = rows["id"].tolist(), rows["comp"].tolist()
        out = []
        for a, b in groups:
            root: dict[int, int] = {}

            def find(c: int, root: dict[int, int] = root) -> int:
                while c in root:
                    c = root[c]
                return c

            pairs = [(i, j) for i, at in _candidates(rows, a, b, regs) for j in at.tolist()]
            if not pairs:
                continue
            x, y = np.array(pairs).T
            likely = np.concatenate([similarity_of(regs[x[k : k + 4096]], regs[y[k : k + 4096]])[0] for k in range(0, len(x), 4096)])
            for k in np.argsort(-likely, kind="stable"):
                i, j = pairs[k]
                ci, cj = find(comp[i]), find(comp[j])
                if ci != cj and _links(sets[i], sets[j]):
                    root[max(ci, cj)] = min(ci, cj)
                    out.append((ids[i], ids[j]))
        yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    give_back()


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)) or not len(x):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _blocks(members: DataFrame) -> DataFrame:
    """(key, main, by_role, quiet_blocks, blocks, others) of members (key, comp, n, leads): in how many blocks each bucket is dealt.

    A bucket's quiet documents don't meet each other: those of its largest
    component, or, where that leaves fewer pairs, those that don't lead any.
    """
    each = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("size"), F.count_if("leads").alias("leading"), F.coalesce(F.sum(F.when(F.col("leads"), F.col("n"))), F.lit(0)).alias("leading_size"))
    each = each.groupBy("key").agg(F.max(F.struct("n", "comp", "size")).alias("m"), *[F.sum(c).alias(c) for c in ("n", "size", "leading", "leading_size")])
    by_role = F.col("leading") < F.col("n") - F.col("m.n")
    loud, loud_size = F.when(by_role, F.col("leading")).otherwise(F.col("n") - F.col("m.n")), F.when(by_role, F.col("leading_size")).otherwise(F.col("size") - F.col("m.size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    return each.select("key", F.col("m.comp").alias("main"), by_role.alias("by_role"), blocks(F.col("n") - loud, F.col("size") - loud_size).alias("quiet_blocks"), blocks(loud, loud_size).alias("blocks"), loud.alias("others"))


def _dealt(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members in pairs of blocks (key, lo, hi): quiet ones, in blocks from -1 down, meet the others, from 0 up, and not each other."""
    rows = members.join(small_side(sizes), "key")
    quiet = F.when(F.col("by_role"), ~F.col("leads")).otherwise(F.col("comp") == F.col("main"))
    at = F.xxhash64("id")
    rows = rows.withColumn("own", F.when(quiet, -1 - F.pmod(at, F.col("quiet_blocks"))).otherwise(F.pmod(at, F.col("blocks"))).cast("int"))
    # Blocks from 0 up meet all, negative ones only those.
    rows = rows.where("blocks > 0").withColumn("other", F.explode(F.sequence(F.when(quiet, 0).otherwise(-F.col("quiet_blocks")), F.col("blocks") - 1)))
    return rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "comp", "n", "registers", "rare")


def shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles): the sorted shingle hashes of the documents whose ids are in ids, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, texts in blocks(batches):
            s, owner, _, _ = shingle_sets([t.encode() if t else b"" for t in texts])
            sets = np.split(s, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
            mark = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets]
            yield pa.RecordBatch.from_arrays([at, pa.array(mark, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "mark", "shingles"])
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(small_side(ids), "id", "left_semi")
    return texts.mapInArrow(run, "id long, mark long, shingles binary").dropDuplicates(["id", "mark"]).select("id", "shingles")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that FREQUENT sets or more have, and in how many; where these are over FREQUENT_ROWS, the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], ["shingle", "n"])

    counts = materialize(sets.select("shingles").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    least = [FREQUENT << k for k in range(40)]
    have = counts.agg(*[F.count_if(F.col("n") >= n) for n in least]).first()
    cut = next(n for n, k in zip(least, have, strict=True) if k <= FREQUENT_ROWS)
    got = counts.where(F.col("n") >= cut).orderBy("shingle").toArrow()
    discard(counts)
    return got.column("shingle").to_numpy(), got.column("n").to_numpy()


def _rarest(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(key, id, comp, n, registers, leads, rare) of members (id, comp, n, registers): the shingles by which documents of sets (id, shingles) can meet one of another component that they link with.

    Two sets that link share a shingle that is among the first n - ceil(2 t / (1 + t) n) + 1
    of the smaller, which leads there, and among the first n - ceil(t n) + 1 of
    the larger, whatever the order, if it is one for all (t the similarity, n a set's size). It runs from rare to frequent, so
    passages that many have in common come last and bring nobody together; shingles
    of one component alone, or where nobody leads, are dropped. rare has all keys of a document, those where
    it leads first.
    """
    frequent = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        for batch in batches:
            keys, owner, leads = [], [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                s = np.frombuffer(x, np.int64)
                at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                n = np.where(known[at] == s, times[at], 0) if len(known) else np.zeros(len(s), np.int64)
                first = len(s) - -(-PERCENT * len(s) // 100) + 1
                keys.append(s[np.lexsort((s, n))[:first]])
                owner.append(np.full(len(keys[-1]), i))
                leads.append(np.arange(len(keys[-1])) <= len(s) - -(-2 * PERCENT * len(s) // (100 + PERCENT)))
            if keys:
                columns = [batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(leads))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "leads"])
        give_back()

    comps = members.select("id", "comp").distinct()
    keys = materialize(sets.select("id", "shingles").mapInArrow(run, "id long, key long, leads boolean"), "rare_keys")
    ends = keys.join(small_side(materialize(comps, "comps")), "id").groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.bool_or("leads").alias("leads"))
    open_keys = materialize(ends.where("c0 < c1 and leads").select("key"), "rare_open")
    met = materialize(keys.join(small_side(open_keys), "key", "left_semi").groupBy("id", "key").agg(F.bool_or("leads").alias("leads")), "rare_met")
    packed = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("key", "leads"))).alias("keys"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = []
            for k in batch.column(1).to_pylist():
                leading = [x["key"] for x in k if x["leads"]]
                rare.append(np.array([len(leading), *leading, *(x["key"] for x in k)], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rare, pa.binary()), batch.column(1)], ["id", "rare", "keys"])

    each = packed.mapInArrow(pack, "id long, rare binary, keys array<struct<key:long,leads:boolean>>").join(members, "id")
    out = materialize(each.select(F.inline("keys"), "id", "comp", "n", "registers", "rare"), "rare_members")
    discard(keys, open_keys, met)
    return out


def _shared_ids(real: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): representatives that stand for different texts under one doc_id."""
    digest = F.struct("d1", "d2")
    several = real.groupBy("doc_id").agg(F.min(digest).alias("x"), F.max(digest).alias("y")).where("x <> y").select("doc_id")
    several = materialize(several, "several")
    owned = real.join(small_side(several), "doc_id").select("doc_id", "d1", "d2").distinct().join(reps.select("d1", "d2", "id"), ["d1", "d2"]).select("doc_id", "id").distinct()
    root = owned.groupBy("doc_id").agg(F.min("id").alias("b"))
    return owned.join(root, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of documents (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set are its distinct 5-word shingles, of fewer words the one of
    all. Documents link when their sets' similarity is at least PERCENT / 100;
    component_id is the smallest doc_id reachable and kept marks it. Documents
    without words (null, empty or blank) link with nothing. Rows with one doc_id
    are one document: if their texts differ, these are linked, each row has the
    n_shingles of its own text, and other documents link by any of the texts. Rows
    without an id are kept and link with nothing; every row is returned. Texts of any
    length are read whole. Other columns are ignored.

    Equal word sequences collapse to one representative first. Sketches meet in
    buckets, one for each band (sets too small for bands meet in their least
    hashes). Each member of a bucket is first confirmed against the bucket's
    center, the document that meets the most others, which joins most copies;
    after that only pairs of different components in a bucket are left. Sketches
    compare these in blocks of BLOCK documents, where the blocks of a bucket's
    largest component meet those of the others and not each other. A bucket of
    over MOST_BLOCKS pairs of blocks holds documents that are alike without linking, by
    a passage that many have: its documents meet in their rarest shingles
    instead, of which documents that link share one, so what brings them together
    is what sets them apart from others. What may link is confirmed on its full sets,
    which are made once and moved to where its candidates are, so that a task emits the
    links that join components and no pairs. No pair across components is left out.
    """
    sig = materialize(sketch(docs), "sketches")
    real = sig.where("doc_id is not null and d1 is not null")
    reps = materialize(
        real.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("least").alias("least")),
        "representatives",
    )
    keys = materialize(reps.select("id", "n_shingles", "registers", "least").mapInPandas(_keys, "key long, id long"), "keys")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = materialize(keys.join(small_side(shared), "key"), "members")
    discard(keys, shared)
    # What most others resemble meets them in the most buckets, and becomes the center of its buckets.
    central = met.groupBy("id").agg(F.sum("n").alias("weight"))
    center = met.join(central, "id").groupBy("key").agg(F.max_by(F.struct("id", "weight"), F.struct("weight", -F.col("id"))).alias("c"))
    star = met.join(center.select("key", F.col("c.id").alias("center"), "c.weight"), "key").where("id <> center")
    star = star.groupBy("id", "center").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    star = star.groupBy(F.col("id").alias("a")).agg(F.max_by("center", F.struct("n", "weight", -F.col("center"))).alias("b"))
    star = materialize(star, "stars")
    links = materialize(verified(star, docs).unionByName(_shared_ids(real, reps)), "links")
    discard(star)
    joined = materialize(connected_components(links), "joined")
    members = met.select("key", "id").join(small_side(joined.withColumnRenamed("node", "id")), "id", "left")
    members = materialize(members.select("key", "id", F.coalesce("component", "id").alias("comp")), "members")
    discard(met, joined)
    open_keys = members.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    open_keys = materialize(open_keys, "open")
    own = reps.select("id", F.col("n_shingles").alias("n"), "registers")
    left = materialize(members.join(small_side(open_keys), "key").join(own.drop("registers"), "id").withColumn("leads", F.lit(True)), "left")
    discard(members, open_keys)
    sizes = materialize(_blocks(left), "blocks")
    work = (F.col("quiet_blocks") + F.col("blocks")).cast("long") * F.col("blocks")
    many = (work > MOST_BLOCKS) & (F.col("others") > MOST_OTHERS)
    near = left.join(small_side(sizes.where(~many).select("key")), "key", "left_semi").join(own.drop("n"), "id")
    dealt = _dealt(near.withColumn("rare", F.lit(None).cast("binary")), sizes.where(~many))
    alike = materialize(left.join(small_side(sizes.where(many).select("key")), "key", "left_semi").select("id", "comp").distinct(), "alike")
    held: list[DataFrame] = []
    if not alike.isEmpty():
        sets = materialize(shingles_of(docs, alike.select("id")), "alike_sets")
        rare = _rarest(sets, alike.join(own, "id"))
        lots = materialize(_blocks(rare), "rare_blocks")
        dealt = dealt.unionByName(_dealt(rare, lots))
        held = [sets, rare, lots]
    group = ["key", "lo", "hi"]
    schema = "key long, lo int, hi int, own int, id long, comp long, n long, registers binary, rare binary"
    involved = materialize(dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(_involved, schema), "involved")
    ids = materialize(involved.select("id").distinct(), "ids")
    found = involved.join(shingles_of(docs, ids), "id").select(*involved.columns, "shingles").repartition(*group).sortWithinPartitions(*group)
    found = materialize(links.unionByName(found.mapInPandas(_joining, "a long, b long")), "all_links")
    discard(left, sizes, alike, involved, ids, links, *held)
    component = connected_components(found)
    discard(found)
    rows = sig.select("doc_id", "d1", "d2", "n_shingles").join(reps.select("d1", "d2", "id"), ["d1", "d2"], "left")
    rows = rows.join(component.withColumnRenamed("node", "id"), "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
