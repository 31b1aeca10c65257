"""The largest common part of trees against trying everything, and what a budget does."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tallywright import suite
from tallywright.operators import trees
from tallywright.operators.trees import core_retention, element_tree, retention, tree_of
from tests.conftest import SF


def plain(a, b):
    """All ways to put children together, from all pairs of roots."""
    (la, ca), (lb, cb) = a, b

    def common(i, j):
        if la[i] != lb[j]:
            return 0
        few, many, turn = (ca[i], cb[j], False) if len(ca[i]) <= len(cb[j]) else (cb[j], ca[i], True)
        return 1 + max((sum(common(y, x) if turn else common(x, y) for x, y in zip(few, p)) for p in permutations(many, len(few))), default=0)

    return max(common(i, j) for i in range(len(la)) for j in range(len(lb)))


def grown(rng, n, labels="abc"):
    return tree_of([labels[int(rng.integers(0, len(labels)))] for _ in range(n)], [-1, *(int(rng.integers(max(0, i - 4), i)) for i in range(1, n))])


def test_common_parts_are_exact():
    rng = np.random.default_rng(6)
    for labels in ("a", "ab", "abc"):
        for _ in range(60):
            a, b = grown(rng, int(rng.integers(1, 9)), labels), grown(rng, int(rng.integers(1, 9)), labels)
            _, matched, exact = retention(a, b, 10**6)
            assert exact and matched == plain(a, b)


def test_grades():
    chain = lambda n: tree_of(["x"] * n, [-1, *range(n - 1)])
    grade = lambda a, b, **k: retention(a, b, k.get("budget", 1000))
    assert grade(chain(4), chain(4)) == ("identical", 4, True)
    assert grade(chain(4), chain(6)) == ("contains", 4, True)
    assert grade(chain(4), chain(9)) == ("embedded", 4, True)
    assert grade(chain(8), chain(6)) == ("retained", 6, True)
    assert grade(chain(8), chain(4)) == ("partial", 4, True)
    assert grade(chain(8), chain(2)) == ("weak", 2, True)
    assert grade(chain(8), tree_of(["y"], [-1])) == ("different", 0, True)
    assert grade(tree_of([], []), chain(2))[0] == "unknown"


def test_a_budget_is_told():
    rng = np.random.default_rng(9)
    a, b = grown(rng, 60, "ab"), grown(rng, 60, "ab")
    whole, few = retention(a, b, 10**5), retention(a, b, 5)
    assert few == retention(a, b, 5) and not few[2] and 0 < few[1] <= whole[1]


def test_element_trees():
    labels, parents = element_tree("<html><p>a<br><b>x</p><img/><ul><li>1<li>2</ul></unopened><p>")
    assert labels == ["#", "html", "p", "br", "b", "img", "ul", "li", "li", "p"]
    assert parents == [-1, 0, 1, 2, 2, 1, 1, 6, 7, 1]
    assert element_tree(None) == (["#"], [-1])


def test_pages(spark):
    df = spark.createDataFrame([(1, "<p><b>x</b></p>", "<p><i></i><b></b></p>"), (2, None, "<p>"), (3, None, None)], "id long, x string, y string")
    assert sorted(map(tuple, core_retention(df, "x", "y").collect())) == [(1, "contains", 3, 1.0, 0.75, True), (2, "contains", 1, 1.0, 0.5, True), (3, "identical", 1, 1.0, 1.0, True)]
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = suite.queries()["page_retention"](spark, SF).collect()
    assert len(rows) > 30 and all(r["page_id"] != r["other"] for r in rows)
    for r in rows[:10]:
        a, b = (tree_of(*element_tree(pages[r[c]])) for c in ("page_id", "other"))
        assert (r["grade"], r["matched"], r["exact"]) == retention(a, b, 20_000)


def test_pages_are_parsed_once_and_equal_trees_searched_once(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "<p x a=1><B><b/></p><x-y:z></ul>")], pages.schema)
    for r in trees.trees_of(pages.unionByName(odd), "page_id", "html").join(pages.unionByName(odd), "page_id").collect():
        assert trees.read_tree(r["tree"]) == tree_of(*element_tree(r["html"]))
    # Tags are found once a page, not once for each run of them.
    plan = pages.select(trees.tag_runs(F.col("html")).alias("runs"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    shown = suite.queries()["page_retention"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in shown


def test_pages_lose_no_link(spark, tmp_path):
    """Classes in a chain of links, short pages, pages without tags and one alone, against all pairs."""
    html = lambda tags, text: "".join(f"<{t}>{text}" for t in tags)
    rng = np.random.default_rng(15)
    base = [f"t{i}" for i in rng.permutation(30)]
    made = [base, base[:24], base[:19], base[:12], base[6:], [f"x{i}" for i in range(9)], ["p", "b"], ["i"], ["p", "b", "i"], []]
    pages = [(int(k), f"u{k}", html(made[i % 5] if i < 14 else made[i % 10], str(k))) for i, k in enumerate(rng.permutation(40))] + [(90, "u", None), (91, "u", html(["q"] * 5, ""))]
    path = str(tmp_path / "sf")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")

    def runs(text):
        tags = re.findall("<([a-z][a-z0-9]*)", text or "")
        return {tuple(tags[i : i + 4]) for i in range(max(len(tags) - 3, min(len(tags), 1)))}

    sets = {k: runs(text) for k, _, text in pages}
    links = {(a, b) for a in sets for b in sets if a != b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b]))}
    rows = suite.queries()["page_retention"](spark, path).collect()
    of = {r["page_id"]: r["class_id"] for r in rows}
    assert of == {a: min(b for b in sets if sets[b] == sets[a]) for a in sets}
    assert {(r["page_id"], r["n_links"]) for r in rows} == {(a, sum(x == a for x, _ in links)) for a in sets}
    # Links between pages, from the rows alone: within a class, and as between the first pages of classes.
    pairs = {(r["page_id"], r["other"]) for r in rows if r["other"] is not None}
    assert len(pairs) + sum(r["other"] is None for r in rows) == len(rows) and pairs <= links
    assert {(a, b) for a in of for b in of if a != b and (of[a] == of[b] or (of[a], of[b]) in pairs)} == links
    assert {a for a, _ in pairs} == {a for a, _ in links} and [r["page_id"] for r in rows if r["other"] is None] == [91]
    text = {k: text for k, _, text in pages}
    for r in rows:
        if r["other"] is None:
            assert (r["n_links"], r["jaccard"], r["grade"], r["matched"]) == (0, None, None, None)
            continue
        x, y = sets[r["page_id"]], sets[r["other"]]
        assert r["jaccard"] == (round(len(x & y) / len(x | y), 6) if x else 1)
        assert (r["grade"], r["matched"], r["exact"]) == retention(*(tree_of(*element_tree(text[r[c]])) for c in ("page_id", "other")), 20_000)


def test_searches_are_dealt_by_their_number(spark, tmp_path):
    """24 classes that are all linked have 552 pairs of trees, whose few bytes went to one task."""
    tags = lambda k: [f"x{k}" if i == 7 else f"t{i}" for i in range(40)]
    pages = [(k, "u", "".join(f"<{t}>" for t in tags(k))) for k in range(24)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    rows = suite.queries()["page_retention"](spark, path)
    assert "RepartitionByExpression [sx" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 24 * 23
