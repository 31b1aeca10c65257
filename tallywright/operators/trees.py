"""How much of one labelled tree is left in another: their largest common part, within a budget of steps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.shipping import ship

#: What share of the query is covered, and what share of the candidate that is, for each grade.
CONTAINS, RETAINED, PARTIAL, WEAK = 1.0, 0.75, 0.5, 0.25
SHARE, PARTIAL_SHARE = 0.5, 0.35

#: Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

Tree = tuple[list[str], list[list[int]]]


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__()
        self.labels, self.parents, self.open = ["#"], [-1], [0]

    def handle_starttag(self, tag, attrs):
        self.labels.append(tag)
        self.parents.append(self.open[-1])
        if tag not in _VOID:
            self.open.append(len(self.labels) - 1)

    def handle_startendtag(self, tag, attrs):
        self.labels.append(tag)
        self.parents.append(self.open[-1])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.labels[self.open[i]] == tag:
                del self.open[i:]
                return


def element_tree(html: str) -> tuple[list[str], list[int]]:
    """Labels and parents of a page's elements, in the order of the page, under a root `#`; what isn't closed ends with its parent."""
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    return parser.labels, parser.parents


def tree_of(labels: list[str], parents: list[int]) -> Tree:
    """Labels and children; a node's parent comes before it."""
    children: list[list[int]] = [[] for _ in labels]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    return labels, children


class _Search:
    """The largest common part of two trees, rooted wherever labels agree, by branch and bound over which children go together."""

    def __init__(self, a: Tree, b: Tree, budget: int):
        (self.la, self.ca), (self.lb, self.cb) = a, b
        self.budget, self.steps, self.cut = budget, 0, False
        self.held: dict[tuple[int, int], int] = {}
        self.count_a, self.count_b = self._counts(self.la, self.ca), self._counts(self.lb, self.cb)

    @staticmethod
    def _counts(labels: list[str], children: list[list[int]]) -> list[Counter]:
        """How often each label occurs below and at each node."""
        out: list[Counter] = [Counter()] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            own = Counter({labels[i]: 1})
            for c in children[i]:
                own.update(out[c])
            out[i] = own
        return out

    def bound(self, i: int, j: int) -> int:
        """At most so many nodes are common: labels that both have."""
        if self.la[i] != self.lb[j]:
            return 0
        x, y = self.count_a[i], self.count_b[j]
        return sum(min(n, y[k]) for k, n in x.items() if k in y)

    def best(self) -> int:
        """The largest part over all pairs of roots, those of the highest bounds first."""
        pairs = sorted(((self.bound(i, j), -i, -j) for i in range(len(self.la)) for j in range(len(self.lb)) if self.la[i] == self.lb[j]), reverse=True)
        most = 0
        for bound, i, j in pairs:
            if bound <= most:
                break
            most = max(most, self.common(-i, -j))
        return most

    def common(self, i: int, j: int) -> int:
        """Nodes of the largest common part with i and j as its roots; a lower bound of it once the budget is used up."""
        if self.la[i] != self.lb[j]:
            return 0
        if (i, j) not in self.held:
            # Children of one kind, by what each could bring.
            mine = sorted(self.ca[i], key=lambda c: -sum(self.count_a[c].values()))
            self.held[i, j] = 1 + self._assign(mine, self.cb[j])
        return self.held[i, j]

    def _assign(self, mine: list[int], theirs: list[int]) -> int:
        if not mine or not theirs:
            return 0
        upper = [[self.bound(c, d) for d in theirs] for c in mine]
        rest = [0] * (len(mine) + 1)
        for k in range(len(mine) - 1, -1, -1):
            rest[k] = rest[k + 1] + max(upper[k])
        best = 0

        def walk(k: int, taken: frozenset, so_far: int) -> None:
            nonlocal best
            best = max(best, so_far)
            if k == len(mine) or so_far + rest[k] <= best:
                return
            self.steps += 1
            if self.steps > self.budget:
                self.cut = True
            seen = set()
            for at in sorted(range(len(theirs)), key=lambda d: (-upper[k][d], d)):
                if at in taken or not upper[k][at]:
                    continue
                d = theirs[at]
                # Children that are alike, tree for tree, bring the same.
                kind = self.shape(d)
                if kind in seen:
                    continue
                seen.add(kind)
                walk(k + 1, taken | {at}, so_far + self.common(mine[k], d))
                if self.cut or so_far + rest[k] <= best:
                    return
            walk(k + 1, taken, so_far)

        walk(0, frozenset(), 0)
        return best

    def shape(self, j: int, held: dict | None = None) -> object:
        """Equal for subtrees of b that are the same but for the order of children."""
        if not hasattr(self, "shapes"):
            self.shapes: list = [None] * len(self.lb)
            names: dict = {}
            for k in range(len(self.lb) - 1, -1, -1):
                key = self.lb[k], tuple(sorted(self.shapes[c] for c in self.cb[k]))
                self.shapes[k] = names.setdefault(key, len(names))
        return self.shapes[j]


def retention(a: Tree, b: Tree, budget: int) -> tuple[str, int, bool]:
    """(grade, matched, exact): how much of the query a its largest common part with b covers, after `budget` steps of the search at most.

    A budget is counted in steps, not seconds, so the same trees give the same
    answer anywhere. A search that it cut short has found `matched` nodes at least; exact is then false.
    """
    na, nb = len(a[0]), len(b[0])
    if not na or not nb:
        return "unknown", 0, True
    search = _Search(a, b, budget)
    matched = search.best()
    coverage, share = matched / na, matched / nb
    if matched == na == nb:
        grade = "identical"
    elif coverage >= CONTAINS and share < SHARE:
        grade = "embedded"
    elif coverage >= CONTAINS:
        grade = "contains"
    elif coverage >= RETAINED and share >= SHARE:
        grade = "retained"
    elif coverage >= PARTIAL:
        grade = "partial" if share >= PARTIAL_SHARE else "embedded"
    else:
        grade = "weak" if coverage >= WEAK else "different"
    return grade, matched, not search.cut


def trees_of(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tree): each page's elements as text, a label and its parent's number each; equal text, equal trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [" ".join(f"{label} {parent}" for label, parent in zip(*element_tree(x), strict=True)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [key, "tree"])

    ship(df.sparkSession)
    return df.select(key, html).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, tree string")


def read_tree(text: str) -> Tree:
    """The tree that trees_of() wrote; no label has white space in it."""
    parts = text.split(" ")
    return tree_of(parts[::2], [int(p) for p in parts[1::2]])


def tree_retention(pairs: DataFrame, a: str, b: str, budget: int = 20_000) -> DataFrame:
    """core_retention() of trees that trees_of() wrote, in place of pages."""
    return _retained(pairs, a, b, budget, read_tree)


def core_retention(pairs: DataFrame, a: str, b: str, budget: int = 20_000) -> DataFrame:
    """pairs with grade, matched, coverage, share and exact, of the pages in columns a (the query) and b (the candidate), which are left out.

    Null pages are their root alone. Pairs are searched where they lie; one takes `budget` steps at most.
    """
    return _retained(pairs, a, b, budget, lambda html: tree_of(*element_tree(html)))


def _retained(pairs: DataFrame, a: str, b: str, budget: int, tree: Callable[[str], Tree]) -> DataFrame:
    keys = [c for c in pairs.columns if c not in (a, b)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                one, two = tree(x), tree(y)
                grade, matched, exact = retention(one, two, budget)
                rows.append((grade, matched, round(matched / len(one[0]), 3), round(matched / len(two[0]), 3), exact))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], [*keys, "grade", "matched", "coverage", "share", "exact"])

    ship(pairs.sparkSession)
    return pairs.select(*keys, a, b).mapInArrow(run, ", ".join([*fields, "grade string, matched long, coverage double, share double, exact boolean"]))


def tag_runs(html: Column, length: int = 4) -> Column:
    """Hashes of the different runs of so many opening tags of a page, an array that pages alike share much of; fewer tags are one run, none are none."""
    tags = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.xxhash64(F.lower(t)))

    def runs(tags: Column) -> Column:
        starts = F.when(F.size(tags) >= length, F.sequence(F.lit(1), F.size(tags) - length + 1)).otherwise(F.array().cast("array<int>"))
        few = F.size(tags).between(1, length - 1)
        return F.when(few, F.array(F.xxhash64(tags))).otherwise(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(tags, i, length)))))

    # As the element of an array the tags are found once; named in a lambda, they would be found again for every run.
    return F.get(F.transform(F.array(tags), runs), F.lit(0))
