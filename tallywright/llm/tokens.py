"""Exact token counts for every context limit, from one histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.bpe import CACHE, PIECE, pieces, read_ranks

_lengths: dict[tuple[str, str], tuple] = {}


def _counter(path: str, pattern: str) -> tuple:
    """This worker's encoder of a rank file and pattern, and the lengths of the pieces that it has met, at most CACHE of them."""
    if (path, pattern) not in _lengths:
        _lengths.clear()
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        _lengths[path, pattern] = e, {}
    return _lengths[path, pattern]


def encoded_length(text: str, path: str, pattern: str) -> int:
    """How many ids a text has; it is cut at spaces where no match reaches across, so a text of any length is encoded by pieces."""
    e, known = _counter(path, pattern)
    total = 0
    for i, x in enumerate(pieces(text)):
        x = " " + x if i else x
        if (n := known.get(x)) is None:
            n = len(e.encode_ordinary(x))
            if len(x) <= PIECE and len(known) < CACHE:
                known[x] = n
        total += n
    return total


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(n_tokens) of each row of docs; null and empty texts have 0.

    Repeated rows count each, equal texts alike; texts of any length are
    counted whole; an empty table gives no rows. Other columns are left out, one named
    n_tokens too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n_tokens": [encoded_length(t, path, pattern) if t else 0 for t in batch["text"]]})

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInPandas(run, "n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """Of (n_tokens): one row for each length that occurs, with sums over all shorter and longer documents.

    n_docs have this length; docs_le and tokens_le count documents up to it,
    docs_gt and tokens_gt those beyond; truncated_total is what all documents
    hold when each is cut at this length; quantile is docs_le over all. Between
    two lengths that occur the sums don't change, so these rows answer every
    context limit exactly (truncated_at). An empty table gives no rows.

    Documents are counted by length before anything moves. What is sorted in
    one place is the histogram, whose rows are bounded by the longest document.
    """
    h = counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("n_docs") * F.col("n_tokens")
    h = h.select(
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(up).alias("docs_le"),
        F.sum(mass).over(up).alias("tokens_le"),
        F.sum("n_docs").over(every).alias("all_docs"),
        F.sum(mass).over(every).alias("all_tokens"),
    )
    docs_gt = F.col("all_docs") - F.col("docs_le")
    return h.select(
        "n_tokens",
        "n_docs",
        "docs_le",
        "tokens_le",
        docs_gt.alias("docs_gt"),
        (F.col("all_tokens") - F.col("tokens_le")).alias("tokens_gt"),
        (F.col("tokens_le") + docs_gt * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_le") / F.col("all_docs")).alias("quantile"),
    )


def truncated_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that fit, their tokens, documents cut, tokens kept in all; 0 over an empty histogram."""

    def sums(limit: int) -> Column:
        fits = F.col("n_tokens") <= limit
        total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
        return F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            total(F.when(fits, F.col("n_docs"))).alias("docs_whole"),
            total(F.when(fits, F.col("n_docs") * F.col("n_tokens"))).alias("tokens_whole"),
            total(F.when(~fits, F.col("n_docs"))).alias("docs_cut"),
        )

    got = histogram.agg(F.array(*map(sums, limits)).alias("x")).select(F.inline("x"))
    return got.withColumn("truncated_total", F.col("tokens_whole") + F.col("docs_cut") * F.col("context_limit"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length up to which at least each share of the documents lies."""
    aggs = [F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))) for s in shares]
    return histogram.agg(F.array(*[F.struct(F.lit(s).alias("share"), a.alias("n_tokens")) for s, a in zip(shares, aggs, strict=True)]).alias("x")).select(
        F.inline("x")
    )
