"""Token sequences of bounded length from documents: best fit, then a swap-based local search."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallywright.llm._store import materialize
from tallywright.llm._words import blocks, give_back

#: Pieces that one task packs together. Every group ends in at most a few bins
#: that are not full, so larger groups waste less; this many take some 50 MB.
GROUP = 100_000
#: Past so many words a worker forgets all but those of its last run of texts; longer words than WORD aren't remembered.
CACHE, WORD = 200_000, 40
#: Words that the tokenizer encodes at a time, and characters of texts that are cut at a time.
AT_ONCE, TOGETHER = 4096, 2 << 20

#: White space as the tokenizer's patterns have it; no match reaches across it.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Words of visible ASCII and of Latin letters that NFC leaves alone and whose
#: lower case is one letter for one; others are left to the library.
_EVEN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+").fullmatch
_EVEN_TEXT = re.compile("[\t-\r !-~\u00a1-\u012f\u0131-\u017f]*").fullmatch
#: Stands for a word's end in the bytes of a token; no word that _EVEN takes has it.
_END = "\x01"
#: What the tokenizer's file has to say for words to be encoded without the library.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

PIECES = T.StructType([T.StructField(c, T.IntegerType() if c == "piece" else T.LongType()) for c in ("doc_id", "piece", "start", "length", "ids_crc32")])


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


def read_ranks(path: str) -> dict[bytes, int] | None:
    """The ranks of a tokenizer's file with word ends, if merging by ranks gives what its list of merges does; else None.

    Ranks merge any two neighbours that make a token, the file's list only those
    that it names. Whenever two neighbours make token t, nothing has merged
    across t's ends yet, so its inside went as if t stood alone, with tokens of
    lower rank; both ways agree if the lower ranks alone bring every t to the
    two parts that the list names. That is what is checked here, for each token
    that has another way to be split.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    cut = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    if told.get("normalizer") != _NORMAL or split[0] != cut or split[1:] != [_BYTES] or told.get("post_processor"):
        return None
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("ignore_merges"):
        return None
    byte, end = _byte_of(), "</w>"
    ranks = {}
    for token, i in model["vocab"].items():
        word, last = (token[: -len(end)], _END.encode()) if token.endswith(end) and token != end else (token, b"")
        if any(c not in byte for c in word):
            return None
        ranks[bytes(byte[c] for c in word) + last] = i
    raw = lambda t: bytes(byte[c] for c in t.removesuffix(end)) + (_END.encode() if t.endswith(end) else b"")
    pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if len(ranks) != len(model["vocab"]) or [ranks.get(a + b) for a, b in pairs] != list(range(512, 512 + len(pairs))):
        return None
    symbols = lambda t: [t[i : i + 1] for i in range(len(t) - 2)] + [t[-2:]] if t.endswith(_END.encode()) else [t[i : i + 1] for i in range(len(t))]
    for a, b in pairs:
        own, parts = ranks[a + b], symbols(a + b)
        while len(parts) > 2:
            due = [ranks.get(x + y, own) for x, y in zip(parts, parts[1:])]
            k = due.index(min(due))
            if due[k] == own:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if parts != [a, b]:
            return None
    return ranks


_matches = regex.compile(_PATTERN).findall


def _parts(word: str) -> list[str] | tuple[str, ...]:
    """The pattern's matches in a word; most words are letters, with a mark behind or not."""
    if word.isalpha():
        return (word,)
    if word[:-1].isalpha() and not word[-1].isalnum():
        return word[:-1], word[-1]
    return _matches(word)


class WordTokenizer:
    """A tokenizer's ids by words; words are encoded once and remembered, up to CACHE of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.engine = None
        if ranks := read_ranks(path):
            self.engine = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(max(ranks.values()) + 1, bool)
            self.ends[[i for t, i in ranks.items() if len(t) > 1 and t.endswith(_END.encode())]] = True

    def _merged(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, all of them merged in one call for thousands."""
        out: list[bytes] = []
        for k in range(0, len(parts), 8 * AT_ONCE):
            run = parts[k : k + 8 * AT_ONCE]
            ids = np.asarray(self.engine.encode_ordinary(_END.join(run) + _END), "<u4")
            data, stops = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            out += [data[at:stop] for at, stop in zip([0, *stops], stops)]
        if len(out) != len(parts):
            raise AssertionError("ids don't end where words do")
        return out

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't known yet."""
        even = list(filter(_EVEN, words)) if self.engine else []
        # Most are letters alone, which the pattern leaves whole.
        plain = [w for w in even if w.isalpha()]
        out = dict(zip(plain, self._merged([w.lower() for w in plain]), strict=True))
        if len(plain) < len(even):
            mixed = [w for w in even if not w.isalpha()]
            parts_of = [_parts(w.lower()) for w in mixed]
            parts = list(set().union(*parts_of))
            of_part = dict(zip(parts, self._merged(parts), strict=True))
            out.update((w, b"".join(map(of_part.__getitem__, x))) for w, x in zip(mixed, parts_of, strict=True))
        rest = [w for w in words if w not in out] if len(out) < len(words) else []
        for k in range(0, len(rest), AT_ONCE):
            run = rest[k : k + AT_ONCE]
            out.update((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(run, self.library.encode_batch_fast(run, add_special_tokens=False), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        cut = [_SPACE.split(x) if _ODD.search(x) else (x.lower() if _EVEN_TEXT(x) else x).split() for x in texts]
        words = set().union(*cut)
        known, new = self.known, list(words.difference(self.known))
        known.update(self._encoded(new))
        out = [b"".join(map(known.__getitem__, one)) for one in cut]
        if len(known) > CACHE:
            self.known = {w: known[w] for w in words if len(w) <= WORD}
        else:
            for w in new:
                if len(w) > WORD:
                    del known[w]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer; it outlives a task, and so do the words that it knows."""
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_pieces(docs: DataFrame, path: str, end: int = 1, limit: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of documents (doc_id, text), each ended by the id `end`.

    Documents of at most `limit` ids are one piece; longer ones are cut into
    pieces of `limit` ids, the last one shorter or not. Null texts are empty
    and have the end id alone. Rows without doc_id and repeated rows have pieces
    of their own; other columns are left out, an empty table gives none.
    """
    tail = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, ids, texts in blocks(batches, TOGETHER):
            rows = []
            for k, data in enumerate(tokenizer(path).encode([x or "" for x in texts])):
                data += tail
                for at in range(0, len(data), 4 * limit):
                    part = data[at : at + 4 * limit]
                    rows.append((k, at // (4 * limit), at // 4, len(part) // 4, zlib.crc32(part)))
            of, *columns = np.array(rows, np.int64).T
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], PIECES.names)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class _Bins:
    """Bins of lengths, found by the room they have left and, while they are underfull, by what they hold.

    Bins are grouped by room. A bin's lengths, and its sums of two, are bits of
    a number; each group keeps all its bins' bits together, so one look tells
    whether any bin of that room has a partner for an exchange.
    """

    def __init__(self, limit: int, sizes: list[int]):
        self.limit, self.sizes, self.mask = limit, sizes, 0
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, set[int]] = defaultdict(set)
        self.bits: dict[int, tuple[int, int]] = {}
        self.together: dict[int, tuple[int, int]] = {}

    def _place(self, b: int) -> None:
        self.by_room[self.room[b]].add(b)
        self.mask |= 1 << self.room[b]

    def _lift(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].discard(b)
        self.bits.pop(b, None)
        self.together.pop(r, None)
        if not self.by_room[r]:
            self.mask &= ~(1 << r)

    def tightest(self, length: int, but: int = -1) -> int:
        """The bin with the least room that takes `length`, -1 if none does."""
        m = self.mask >> length
        while m:
            r = length + (m & -m).bit_length() - 1
            for b in self.by_room[r]:
                if b != but:
                    return b
            m &= m - 1
        return -1

    def new(self) -> int:
        self.items.append([])
        self.room.append(self.limit)
        self._place(len(self.items) - 1)
        return len(self.items) - 1

    def change(self, b: int, out: list[int] = [], into: list[int] = []) -> None:  # noqa: B006
        """Take items out of a bin and put others into it."""
        self._lift(b)
        for i in out:
            self.items[b].remove(i)
        self.items[b] += into
        self.room[b] += sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in into)
        self.together.pop(self.room[b], None)
        if self.items[b]:
            self._place(b)

    def held(self, b: int) -> tuple[int, int]:
        """A bin's lengths and sums of two as bits."""
        if b not in self.bits:
            one = two = 0
            for i in self.items[b]:
                two |= one << self.sizes[i]
                one |= 1 << self.sizes[i]
            self.bits[b] = one, two
        return self.bits[b]

    def exchange(self, source: int, item: int) -> tuple[int, list[int]] | None:
        """A bin at least as full as the source, and one or two items of it, that leave most of its room filled once `item` takes their place."""
        x, best, found = self.sizes[item], 0, None
        m = self.mask & ((2 << self.room[source]) - 2)
        while m:
            r = (m & -m).bit_length() - 1
            m &= m - 1
            if r not in self.together:
                one = two = 0
                for b in self.by_room[r]:
                    a, c = self.held(b)
                    one, two = one | a, two | c
                self.together[r] = one, two
            # Only what gains more than the best so far, at most the room and less than the item.
            low, high = max(1, x - r), x - best - 1
            if high < low:
                continue
            window = ((1 << (high - low + 1)) - 1) << low
            for k, bits in enumerate(self.together[r]):
                while hit := bits & window:
                    y = (hit & -hit).bit_length() - 1
                    b = next((b for b in self.by_room[r] if b != source and self.held(b)[k] >> y & 1), -1)
                    if b >= 0:
                        if x - y > best:
                            best, found = x - y, (b, k, y)
                        break
                    bits &= ~(1 << y)  # only the source has it
        if not found:
            return None
        b, k, y = found
        return b, self._of_sum(b, k, y)

    def _of_sum(self, b: int, k: int, y: int) -> list[int]:
        own = self.items[b]
        if not k:
            return [next(i for i in own if self.sizes[i] == y)]
        first: dict[int, int] = {}
        for i in own:
            if y - self.sizes[i] in first:
                return [first[y - self.sizes[i]], i]
            first.setdefault(self.sizes[i], i)
        raise AssertionError("a bin's bits don't agree with its items")


def pack(lengths: np.ndarray, limit: int, search: bool = True) -> list[list[int]]:
    """Bins of items so that no bin is over `limit`, in as few bins as the search finds.

    Best fit, longest first; then, with `search`, while there are more bins than the sum of
    lengths needs, every underfull bin is worked on, the emptiest first: an item
    moves to the tightest other bin with room, or is exchanged for one shorter
    item, or for two, of a bin at least as full, whichever fills most of that
    bin's room; all underfull bins are looked at. Each step raises the sum of
    squared fills, so the search ends; a bin that is empty is gone. It goes on until a round
    over all underfull bins changes nothing, or no fewer bins could hold the items.
    """
    sizes = lengths.tolist()
    bins = _Bins(limit, sizes)
    for i in np.argsort(-lengths, kind="stable").tolist():
        b = bins.tightest(sizes[i])
        bins.change(b if b >= 0 else bins.new(), into=[i])
    least = -(-sum(sizes) // limit)
    count = len(bins.items)
    while search:
        under = sorted((b for b, x in enumerate(bins.items) if x and bins.room[b]), key=lambda b: (-bins.room[b], b))
        changed, stuck = False, set()
        for source in under:
            if count <= least:
                break
            # Bins of equal lengths fail alike until something changes.
            look = tuple(sorted(sizes[i] for i in bins.items[source]))
            if not look or not bins.room[source] or look in stuck:
                continue
            if _improve(bins, source):
                changed, stuck = True, set()
                count -= not bins.items[source]
            else:
                stuck.add(look)
        if not changed:
            break
    return [x for x in bins.items if x]


def _improve(bins: _Bins, source: int) -> bool:
    """Move or exchange items of `source` until none of them makes a fuller bin fuller."""
    done = again = False
    while again or not done:
        again = False
        for item in sorted(bins.items[source], key=lambda i: -bins.sizes[i]):
            x = bins.sizes[item]
            b = bins.tightest(x, but=source)
            if b >= 0 and bins.room[b] - x < bins.room[source]:
                bins.change(source, out=[item])
                bins.change(b, into=[item])
            elif swap := bins.exchange(source, item):
                b, others = swap
                bins.change(source, out=[item], into=others)
                bins.change(b, out=others, into=[item])
            else:
                continue
            done = again = True
            break
        if not again:
            break
    return done


def pack_pieces(pieces: DataFrame, limit: int = 4096, group: int = GROUP) -> DataFrame:
    """pieces (of cut_pieces) with sequence_id and offset, the place in the sequence.

    Pieces are dealt evenly to groups of about `group`, each packed by one task
    (pack); a group's last bins are all that packing in groups can waste, some
    1 in 10,000. No key decides where a piece goes, so none can be hot.
    sequence_id holds the group's number in its upper bits. Repeated rows and
    rows without doc_id are pieces like others; ties in length go by doc_id and
    piece; an empty table gives none. Other columns are left out.
    """
    pieces = materialize(pieces.select(*PIECES.names), "pieces")
    groups = max(1, round(pieces.count() / group))
    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [], None) if (batches := list(batches)) else None
        if not rows:
            return
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        lengths = rows["length"].to_numpy()
        bins = pack(lengths, limit)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(rows))
        sizes = np.fromiter(map(len, bins), np.int64, len(bins))
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        begins = np.cumsum(lengths[order]) - lengths[order]
        out = rows.take(pa.array(order))
        number = (TaskContext.get().partitionId() << 32) + np.repeat(np.arange(len(bins)), sizes)
        out = out.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(begins - begins[first], pa.int64()))
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)
        give_back()

    return pieces.repartition(groups).mapInArrow(run, schema)
