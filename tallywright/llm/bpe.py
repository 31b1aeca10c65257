"""Byte-level BPE: ids of texts by merge replay over many words at once, and back."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm._words import blocks

#: A worker remembers the ids of so many pieces of text of at most so many characters.
CACHE, PIECE = 400_000, 40
#: Texts are encoded together up to so many characters.
TOGETHER = 6 << 20

#: A single space between two other characters that are not white space begins a
#: match of the pattern whatever surrounds it, so texts can be cut there first.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r" \s|\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def uneven(text: str) -> bool:
    """Whether a space has other white space beside it."""
    return _UNEVEN.search(text) is not None


def pieces(text: str, plain: bool | None = None) -> list[str]:
    """The text in pieces whose matches of the pattern are those of the whole; each but the first lacks its leading space."""
    return text.split(" ") if plain or (plain is None and not uneven(text)) else _CUT.split(text)


class MergeReplay:
    """Encodes many words at a time by replaying the merges in rank order.

    All symbols of all words stand in one row. An inverted index leads from the
    rank that a pair of neighbours would merge into to the pair's positions; a
    heap gives the lowest rank that has any. All positions of that rank merge at
    once, and only the pairs with their two neighbours get new ranks and are
    indexed under those. Words don't touch each other, so each sees its own
    lowest pair merged first, the left one of equal pairs, as if it were encoded
    alone. Where a merge makes a pair of a lower rank than its own, its word
    takes one merge at a time, the leftmost, and its others wait in the index.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[t[:k]] << 32 | ranks[t[k:]], r)
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        keys, merged = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.merged = np.append(keys[order], np.iinfo(np.int64).max), np.append(merged[order], -1)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that a and b merge into, -1 where there is none or no neighbour."""
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.merged[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        size = np.array([len(w) for w in words], np.int64)
        size[whole >= 0] = 1
        width = size + 1  # words don't touch
        begin = np.cumsum(width) - width + 1
        n = int(width.sum()) + 1
        sym = np.full(n, -1, np.int64)
        split = np.flatnonzero(whole < 0)
        text = np.frombuffer(b"".join([words[i] for i in split]), np.uint8)
        if len(text):
            shift = begin[split] - (np.cumsum(size[split]) - size[split])
            sym[np.repeat(shift, size[split]) + np.arange(len(text))] = self.byte[text]
        kept = begin[whole >= 0]
        sym[kept] = whole[whole >= 0]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1], before[0] = n - 1, 0
        due = np.append(self.pair(sym[:-1], sym[1:]), -1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Index positions by the rank that is due there."""
            at = at[due[at] >= 0]
            if len(at):
                r = due[at]
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cut = np.flatnonzero(r[1:] != r[:-1]) + 1
                for rank, part in zip(r[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
                    if rank in index:
                        index[rank].append(part)
                    else:
                        index[rank] = [part]
                        heapq.heappush(heap, rank)

        enter(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            p = np.concatenate(index.pop(rank))
            p = np.unique(p[due[p] == rank])
            if not len(p):
                continue
            # Of pairs that overlap in a chain, the first, third, ... merge.
            linked = np.concatenate(([False], after[p[:-1]] == p[1:]))
            if linked.any():
                i = np.arange(len(p))
                p = p[(i - np.maximum.accumulate(np.where(linked, 0, i))) % 2 == 0]
            q = after[p]
            own = np.full(len(p), rank)
            lower = np.minimum.reduce([np.where(x >= 0, x, rank) for x in (self.pair(own, sym[after[q]]), self.pair(sym[before[p]], own), self.pair(own, own))])
            if (lower < rank).any():
                word = np.searchsorted(begin, p, "right")
                first = np.concatenate(([True], word[1:] != word[:-1]))
                now = first | ~np.isin(word, word[lower < rank])
                index[rank] = [p[~now]]
                heapq.heappush(heap, rank)
                p, q = p[now], q[now]
            nxt = after[q]
            sym[p], sym[q], due[q] = rank, -2, -1
            after[p], before[nxt] = nxt, p
            prev = before[p]
            due[p] = self.pair(sym[p], sym[nxt])
            due[prev] = self.pair(sym[prev], sym[p])
            enter(np.concatenate((p, np.setdiff1d(prev, p, assume_unique=True))))
            if (lower < rank).any():  # chains that waited may overlap otherwise now
                rest = np.flatnonzero(due == rank)
                index[rank] = [rest]
        live = sym >= 0
        count = np.zeros(len(words) + 1, np.int64)
        np.add.at(count, np.searchsorted(begin, np.flatnonzero(live), "right"), 1)
        return sym[live], count[1:]


class Encoder:
    """Texts to ids, as decimal strings joined by spaces, and ids back to bytes."""

    def __init__(self, path: str, pattern: str):
        self.replay = MergeReplay(read_ranks(path))
        self.matches = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.name = [str(i) for i in range(max(self.replay.bytes_of) + 1)]
        self.token = {str(r): b for r, b in self.replay.bytes_of.items()}

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text. The words that no earlier text had are replayed together."""
        seen: set[str] = set()
        firsts: dict[str, str] = {}
        plain = [not uneven(t) for t in texts]
        for t, p in zip(texts, plain, strict=True):
            first, *rest = pieces(t, p)
            seen.update(rest)
            firsts[first] = ""
        known = self.known
        new = list(seen.difference(known))
        del seen
        words_of = [self.matches(" " + x) for x in new]
        words_at = [self.matches(x) for x in firsts]
        words = list({w for ws in chain(words_of, words_at) for w in ws})
        flat, count = self.replay.encode([w.encode() for w in words])
        names, end = [self.name[i] for i in flat.tolist()], np.cumsum(count)
        ids = {w: " ".join(names[a:b]) for w, a, b in zip(words, (end - count).tolist(), end.tolist(), strict=True)}
        fresh = {x: " ".join([ids[w] for w in ws]) for x, ws in zip(new, words_of, strict=True)}
        firsts = {x: " ".join([ids[w] for w in ws]) for x, ws in zip(firsts, words_at, strict=True)}
        known.update(fresh)
        out = []
        for t, p in zip(texts, plain, strict=True):
            first, *rest = pieces(t, p)
            all_ids = " ".join(map(known.__getitem__, rest))
            out.append(f"{firsts[first]} {all_ids}" if all_ids and first else all_ids or firsts[first])
        full = len(known) > CACHE
        for x in fresh:
            if full or len(x) > PIECE:
                del known[x]
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(" "))) if ids else b""


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder; it outlives a task, and so do the words that it knows."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with a column token_ids, the ids as decimals joined by single spaces, in place of the texts.

    With `decoded`, a binary column of that name has the bytes that the ids
    decode to, made in the same pass, so a task needs one Python worker.

    Each match of `pattern` is encoded separately, without special tokens; a
    word that is a token is that token, others are merged from bytes in rank
    order. Null and empty texts have no ids (an empty string). Rows and other
    columns stay as they are, null, repeated or large ids too; columns token_ids
    and decoded are replaced, and an empty table gives none.

    The corpus is encoded where it lies: each run of about 6 million characters
    of a partition is cut into its distinct words, whose merges are replayed
    together; a worker keeps the words it knows for later tasks, up to a bound
    past which words are just encoded again. No word list is gathered or sent,
    so nothing is shuffled and no memory grows with the corpus.
    """
    rest = [c for c in docs.columns if c not in (text, "token_ids", "decoded")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(None).cast("int").alias("rest"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["rest"], T.StructField("token_ids", T.StringType()), *[T.StructField("decoded", T.BinaryType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for _, kept, texts in blocks(batches, TOGETHER):
            ids = e.encode([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([kept, pa.array(ids, pa.string()), *[pa.array([e.decode(i) for i in ids], pa.binary())] * decoded], schema.names)

    return rows.mapInArrow(run, schema).select(*["rest.*"] * bool(rest), *schema.names[1:])
