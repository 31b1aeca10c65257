"""Vectorised word hashing: the words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space and \t \n \v \f \r.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_SEED, _PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], gaps: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words, A-Z lower-cased, text after text, and each text's count of words; then hashes of the words' first bytes, for each length in `stems`."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64) for _ in stems]
    joined = (b" ".join(texts) + b" ").translate(_LOWER)
    buf = np.frombuffer(joined, np.uint8)
    gap = gaps[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    h = np.full(len(at), _SEED, np.uint64)
    short: dict[int, np.ndarray] = {}
    for j in range(min(int(size[0]), _LONG) if len(size) else 0):
        m = np.searchsorted(-size, -j)  # words longer than j come first
        h[:m] = (h[:m] ^ _RANDOM[buf[at[:m] + j]]) * _PRIME
        if j + 1 in stems:
            short[j + 1] = h.copy()
    for i in range(int(np.searchsorted(-size, -_LONG))):
        word = joined[at[i] : at[i] + size[i]]
        h[i] = np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
    out, *stem = hashes = [np.empty_like(h) for _ in range(1 + len(stems))]
    for x, into in zip([h, *[short.get(k, h) ^ np.uint64(k) for k in stems]], hashes, strict=True):
        into[order] = mix(x)
    stop = np.cumsum([len(t) + 1 for t in texts])
    return out, np.bincount(np.searchsorted(stop, start, "right"), minlength=len(texts)), *stem


def in_blocks(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes, each with the place of its first; null is empty."""
    block: list[bytes] = []
    first = total = 0
    for i, text in enumerate(texts):
        if total > most:
            yield first, block
            first, block, total = i, [], 0
        block.append(text.encode("utf-8", "replace") if text else b"")
        total += len(block[-1])
    if block:
        yield first, block


def blocks(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[int, pa.Array, list[str | None]]]:
    """Runs of rows (id, text) of about `most` characters: the first row's place in its batch, the ids, the texts.

    Ids stay Arrow arrays, so neither nulls nor large numbers change them, and
    the texts of a batch, which Spark bounds by bytes, become Python's a run at a time.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
        first = 0
        while first < batch.num_rows:
            stop = int(np.searchsorted(size, (size[first - 1] if first else 0) + most)) + 1
            yield first, ids.slice(first, stop - first), texts.slice(first, stop - first).to_pylist()
            first = stop


def give_back() -> None:
    """Return freed memory to the system at a task's end; idle workers would hold it while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
