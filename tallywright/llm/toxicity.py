"""Toxicity of texts by two class-conditional Kneser-Ney models."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm._store import discard, materialize
from tallywright.llm._words import NOT_ALNUM, blocks, give_back, in_blocks, mix, word_hashes

#: Labelled rows that the models are fitted on, of each class: those of the
#: smallest hashes. A quarter of them sets the two numbers of the final scale.
PER_CLASS = 6000
#: Rows of the model that the driver takes at most. Where the sample gives more, what
#: has the least evidence goes to the backoff whole, as single counts always do.
MODEL_ROWS = 8_000_000
#: What Kneser-Ney smoothing takes off a count; a count of one goes to the shared
#: backoff whole.
DISCOUNT = 0.75
#: How many shared counts stand against a class's own ones of a word or stem, and of a
#: pair of words: of the powers of 2 from 1/4 to 4 and from 1 to 32, those of the least
#: log-loss, both classes of one weight, on the quarter of the labels learned from that sets the scale (sf0.1).
WORD_BACKOFF, PAIR_BACKOFF = 1.0, 4.0
#: What most words of a text say counts as its language or subject; so many
#: words of a prior that says nothing stand against it, and it is at most so much
#: towards toxic. Evidence that a short or densely toxic text repeats thus stays.
USUAL_PRIOR, USUAL_MOST = 20.0, 0.5

#: Rare words back off to their first bytes, these many, the longer ones first.
STEMS = (6, 4)

_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Shares(NamedTuple):
    """Sorted hashes, their shared probability, and what each class (ordinary, toxic) makes of it."""

    keys: np.ndarray
    shared: np.ndarray
    by_class: np.ndarray


class Model(NamedTuple):
    """Two Kneser-Ney models over pairs of words, and a logistic curve.

    P(w | v) of a class is (A * B + L * P(w)) / Z: A, the discounted share of the
    pair among the pairs of history v, and L, what the discounts left, are counts
    of both classes; B leans A to the class. P(w) is a product over the word's
    first bytes, more of them, and the whole word, each again a shared share
    (from continuation counts) leaned to the class; Z makes every history sum to
    1. `levels` hold, for a known word, for an unknown word of a known longer
    stem, and of a known shorter stem, the shared P(w) and the classes' factor
    to it; `unknown` is that of all other words.
    """

    levels: tuple[Shares, ...]
    unknown: np.ndarray
    pairs: Shares  # A and B
    histories: Shares  # L and Z
    curve: np.ndarray  # the weight of features(), then the offset


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; so are rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _tokens(texts, most: int = 1 << 20) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Of each run of texts: its first place, its length, and of the different word pairs of each text: words, stems, pairs and the words before (0 at a text's start), and the text.

    A pair that a text repeats counts once, so that a repeated line doesn't outvote the rest.
    """
    for first, block in in_blocks(texts, most):
        w, n, *stems = word_hashes(block, NOT_ALNUM, STEMS)
        of = np.repeat(np.arange(len(block)), n)
        follows = np.zeros(len(w), bool)
        follows[1:] = of[1:] == of[:-1]
        before = np.zeros(len(w), np.uint64)
        before[1:] = np.where(follows[1:], w[:-1], np.uint64(0))
        pair = mix(before * _PAIR + w)
        order = np.lexsort((pair, of))
        new = np.ones(len(w), bool)
        new[1:] = (pair[order][1:] != pair[order][:-1]) | (of[order][1:] != of[order][:-1])
        at = np.sort(order[new])
        yield first, len(block), [x[at] for x in (w, *stems, pair, before)], of[at]


#: Pairs of words with the stems of the second one and their counts in ordinary and toxic texts.
_PAIRS = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "last", "long", "short", "n0", "n1")])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled texts (toxic, text), counts of word pairs, summed over each run of texts."""
    for _, labels, texts in blocks(batches, 2 << 20):
        toxic = labels.to_numpy(zero_copy_only=False).astype(np.int64)
        for first, _, (w, *stems, pair, before), of in _tokens(texts, 4 << 20):
            _, at, group = np.unique(pair, return_index=True, return_inverse=True)
            label = toxic[first + of]
            count = [np.bincount(group[label == c], minlength=len(at)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (*[x[at] for x in (before, w, *stems)], *count)], _PAIRS.names)
    give_back()


def sample_labels(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, toxic, calibrate): at most per_class labelled rows of each class, those of the smallest hashes of their ids."""
    known = _known(labels).withColumn("at", F.xxhash64("doc_id"))
    top = [known.where(F.col("toxic") == c).orderBy("at", "doc_id").limit(per_class) for c in (0, 1)]
    return top[0].unionByName(top[1]).select("doc_id", "toxic", (F.shiftright("at", 20) % 4 == 0).alias("calibrate"))


def _known(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return known.where(~held_out(F.col("doc_id")))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """The models of documents (doc_id, text) and labels (doc_id, toxic); None if a class has no text to learn from.

    Counts are made by the executors over the whole texts of the sample, whose
    bound is per_class. A pair, word or stem of a single count passes it whole
    to what it backs off to, where the counts include it, so only others are
    rows of the model: these reach the driver, and one number for each document
    that sets the curve. If there are over MODEL_ROWS of them, the count that
    passes whole is doubled until there aren't; every history still sums to 1. Null labels and ids are
    ignored; of several labels of one document the higher counts.
    """
    chosen = materialize(sample_labels(labels, per_class), "sample")
    share = dict(_known(labels).groupBy("toxic").count().collect())
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    n = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    stems = [F.first("long").alias("long"), F.first("short").alias("short")]
    pairs = materialize(texts.where("not calibrate").select("toxic", "text").mapInArrow(_grams, _PAIRS).groupBy("first", "last").agg(*n, *stems), "pairs")
    # How many different words a word follows, in either class, is its continuation count.
    words = materialize(pairs.groupBy("last").agg(*n, F.count("*").alias("follows"), *stems), "words")
    total = [*n, F.sum("follows").alias("follows")]
    root = words.agg(*total).first()
    if not root["n0"] or not root["n1"]:
        discard(pairs, words, chosen)
        return None
    long = words.groupBy("long").agg(*total, F.first("short").alias("short"))
    tables = {
        "words": words.withColumn("evidence", F.col("follows")),
        "long": long.withColumn("evidence", F.col("follows")),
        "short": words.groupBy("short").agg(*total).withColumn("evidence", F.col("follows")),
        "pairs": pairs.withColumn("evidence", F.col("n0") + F.col("n1")),
        "histories": pairs.groupBy("first").agg(*n, F.max(F.col("n0") + F.col("n1")).alias("evidence")),
    }
    passed = [1 << k for k in range(40)]
    rows = [t.agg(*[F.count_if(F.col("evidence") > k) for k in passed]).first() for t in tables.values()]
    least = next(k for k, sizes in zip(passed, zip(*rows, strict=True), strict=True) if sum(sizes) <= MODEL_ROWS)
    tables = {k: t.where(F.col("evidence") > least).drop("evidence") for k, t in tables.items()}
    held = {k: {c: x.to_numpy() for c, x in zip(t.columns, t.toArrow().itercolumns(), strict=True)} for k, t in tables.items()}
    model = _model(np.array([root[c] for c in ("n0", "n1", "follows")], float), **held)
    seen = features_of(texts.where("calibrate").select("toxic", "text"), model).toArrow()
    discard(pairs, words, chosen)
    y = seen["toxic"].to_numpy().astype(float)
    size = np.array([max(1, (y == c).sum()) for c in (0, 1)])
    weight = np.array([share.get(c, 0) for c in (0, 1)])[y.astype(int)] / size[y.astype(int)]
    return model._replace(curve=_curve(seen["feature"].to_numpy().reshape(-1, 1), y, weight))


def _sorted(table: dict[str, np.ndarray], by: str) -> dict[str, np.ndarray]:
    """The table in the order of a column of hashes, which are unsigned from here on."""
    table = {c: x.view(np.uint64) if c in ("first", "last", "long", "short", "key") else x.astype(float) for c, x in table.items()}
    order = np.argsort(table[by])
    return {c: x[order] for c, x in table.items()}


def _leaned(shared, n, expected, parent, parents, lean, backoff) -> tuple[np.ndarray, np.ndarray]:
    """Each class's factor to a shared share, and what all of a parent's children come to with it, the unknown ones included.

    shared is the child's share of its parent; n are its counts by class,
    expected those of a class like all others, `backoff` of which stand beside
    them, leaned as `lean` says.
    """
    factor = (n + backoff * lean) / (expected + backoff)
    rest = 1 - np.bincount(parent, shared, parents)
    whole = np.column_stack([np.bincount(parent, shared * factor[:, c], parents) + rest for c in (0, 1)])
    return factor, whole


def _model(root: np.ndarray, words: dict, long: dict, short: dict, pairs: dict, histories: dict) -> Model:
    """The model of counts: n0 and n1 by class, and follows, of how many pairs a word or stem is the second."""
    by_class = lambda t: np.column_stack([t["n0"], t["n1"]])
    words, long, short = _sorted(words, "last"), _sorted(long, "long"), _sorted(short, "short")
    pairs, histories = _sorted(pairs, "last"), _sorted(histories, "first")
    above = {"n": root[None, :2], "follows": root[2:], "shared": np.ones(1), "factor": np.ones((1, 2))}
    levels, unknown = [], None
    for table, parent in ((short, np.zeros(len(short["n0"]), np.int64)), (long, _find(short["short"], long["short"])), (words, _find(long["long"], words["long"]))):
        n = by_class(table)
        share = (table["follows"] - DISCOUNT) / above["follows"][parent]
        expected = above["n"][parent] * (n.sum(axis=1) / above["n"][parent].sum(axis=1))[:, None]
        factor, whole = _leaned(share, n, expected, parent, len(above["n"]), 1.0, WORD_BACKOFF)
        rest = 1 - np.bincount(parent, share, len(above["n"]))
        # An unknown child has what the known ones leave; a stem's only unknown child is any word of it.
        lost = above["shared"] * rest, above["factor"] / whole
        if unknown is None:
            unknown = np.concatenate([lost[0], lost[1][0]])
        else:
            levels.append(Shares(above["keys"], *lost))
        above = {"n": n, "follows": table["follows"], "shared": above["shared"][parent] * share, "factor": above["factor"][parent] * factor / whole[parent]}
        above["keys"] = table[("short", "long", "last")[len(levels)]]
    levels.append(Shares(above["keys"], above["shared"], above["factor"]))
    levels = tuple(levels[::-1])
    of, n = _find(histories["first"], pairs["first"]), by_class(pairs)
    whole_n = by_class(histories)
    share = (n.sum(axis=1) - DISCOUNT) / whole_n.sum(axis=1)[of]
    expected = whole_n[of] * (n.sum(axis=1) / whole_n.sum(axis=1)[of])[:, None]
    _, lean = _word_shares(levels, unknown, (pairs["last"], pairs["long"], pairs["short"]))
    factor, whole = _leaned(share, n, expected, of, len(whole_n), lean, PAIR_BACKOFF)
    key = mix(pairs["first"] * _PAIR + pairs["last"])
    order = np.argsort(key)
    left = 1 - np.bincount(of, share, len(whole_n))
    return Model(levels, unknown, Shares(key[order], share[order], factor[order]), Shares(histories["first"], left, whole), np.array([1.0, -1.0]))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A logistic curve through the features, by Newton's method with a slight pull to 0: their weights, then the offset.

    More evidence never lowers a score: a feature whose weight would be negative is left out.
    """
    if len(x) == 0 or len(set(y.tolist())) < 2:
        return np.array([1.0] * x.shape[1] + [-1.0])
    weight = weight * len(x) / weight.sum()
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    used = list(range(x.shape[1]))
    while True:
        beta = _newton(np.column_stack([x[:, used] / spread[used], np.ones(len(x))]), y, weight)
        if not used or beta[:-1].min() >= 0:
            break
        del used[int(beta[:-1].argmin())]
    out = np.zeros(x.shape[1] + 1)
    out[used], out[-1] = beta[:-1] / spread[used], beta[-1]
    return out


def _newton(a: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the columns of a; the last column is the offset, which isn't pulled."""
    n = a.shape[1]
    pull = np.diag([0.05] * (n - 1) + [0.0])
    beta = np.zeros(n)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + pull + 1e-9 * np.eye(n), a.T @ (weight * (y - p)) - pull @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in sorted keys; len(keys), the unseen row, where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys))


def _word_shares(levels: tuple[Shares, ...], unknown: np.ndarray, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The shared P(w) of words, longer and shorter stems, and each class's factor to it."""
    shared, factor = np.full(len(keys[0]), unknown[0]), np.tile(unknown[1:], (len(keys[0]), 1))
    todo = np.arange(len(keys[0]))
    for level, key in zip(levels, keys, strict=True):
        at = _find(level.keys, key[todo])
        known = at < len(level.keys)
        shared[todo[known]], factor[todo[known]] = level.shared[at[known]], level.by_class[at[known]]
        todo = todo[~known]
    return shared, factor


def likelihoods(m: Model, words: tuple[np.ndarray, ...], before: np.ndarray) -> np.ndarray:
    """P(w | v) in the ordinary and in the toxic model, of words (with their longer and shorter stems) and the words before them."""
    shared, factor = _word_shares(m.levels, m.unknown, words)
    at = _find(m.histories.keys, before)
    left, whole = np.append(m.histories.shared, 1.0)[at], np.vstack([m.histories.by_class, np.ones((1, 2))])[at]
    pair = _find(m.pairs.keys, mix(before * _PAIR + words[0]))
    own, lean = np.append(m.pairs.shared, 0.0)[pair], np.vstack([m.pairs.by_class, np.ones((1, 2))])[pair]
    return (own[:, None] * lean + (left * shared)[:, None] * factor) / whole


def features(texts, m: Model) -> np.ndarray:
    """Of each text, toxic less ordinary log-likelihood, both normalised by the root of the number of word pairs; 0 without words."""
    out = np.zeros(len(texts))
    for first, n, (w, *stems, _, before), of in _tokens(texts):
        if not len(w):
            continue
        p = np.log(likelihoods(m, (w, *stems), before))
        words = np.bincount(of, minlength=n)
        root = np.sqrt(np.maximum(words, 1))
        ordinary, toxic = (np.bincount(of, p[:, c], n) / root for c in (0, 1))
        some = np.flatnonzero(words)
        first_of, n_of = (np.cumsum(words) - words)[some], words[some]
        # What most words of a text have in common is its language or its subject, as far as they are enough to tell.
        ratio = p[:, 1] - p[:, 0]
        ranked = ratio[np.lexsort((ratio, of))]
        median = (ranked[first_of + (n_of - 1) // 2] + ranked[first_of + n_of // 2]) / 2
        usual = np.zeros(n)
        usual[some] = np.minimum(median * n_of / (n_of + USUAL_PRIOR), USUAL_MOST)
        out[first : first + n] = toxic - ordinary - usual * words / root
    return out


def _features(texts: pa.Array, m: Model) -> np.ndarray:
    """features() of an Arrow array, a run of texts at a time."""
    both = pa.RecordBatch.from_arrays([texts, texts], ["at", "text"])
    return np.concatenate([np.zeros(0), *(features(run, m) for _, _, run in blocks([both]))])


def features_of(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column feature in place of text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("text")
    schema = T.StructType([*rest.schema.fields, T.StructField("feature", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*kept, pa.array(_features(texts, held.value))], schema.names)
        give_back()

    return docs.select(*rest.columns, "text").mapInArrow(run, schema)


def score_of(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """The score of each row's text, 0 to 1, as a column of docs."""
    if model is None:
        return F.lit(0.0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            z = _features(texts, held.value) * held.value.curve[0] + held.value.curve[1]
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        give_back()

    return score(F.col(f"`{text}`").cast("string"))


def flag(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """1 where the score is 0.5 or more, else 0."""
    return (score_of(docs, model, text) >= 0.5).cast("int")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) of documents (doc_id, text), from the text alone.

    score is 0 to 1, higher the likelier toxic; predicted is 1 from 0.5 on. Null
    and empty texts score what a text without evidence does. Without a model
    every score is 0. Whole texts count, however long; every row stays, with or
    without doc_id and repeated or not, and an empty table gives none. Other
    columns are left out, whatever their names.
    """
    scored = docs.select("doc_id", score_of(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
