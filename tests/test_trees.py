"""Extremely randomised trees against a plain grower over Python lists."""

import random
from collections import Counter

import pytest

from fleetcraft.operators import trees

FEATURES = ("a", "b", "c", "d")


def rows_of(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = rnd.randint(0, 9) / 2, rnd.random(), rnd.gauss(0, 1)
        out.append(("x" if a > 2 else "y" if c > 0.3 else "z", a, b, c, 1.0))
    return out


def gini(rows):
    return 1 - sum((v / len(rows)) ** 2 for v in Counter(r[0] for r in rows).values()) if rows else 0.0


def plain_trees(rows, n_trees, depth):
    out = {}

    def grow(tree, node, here, level):
        if level == depth or len({r[0] for r in here}) < 2:
            return
        columns = [[r[1 + i] for r in here] for i in range(len(FEATURES))]
        found = trees._candidates(42, tree, node, FEATURES, [min(c) for c in columns], [max(c) for c in columns], 2)
        tried = []
        for i, at in found:
            left, right = [r for r in here if r[1 + i] <= at], [r for r in here if r[1 + i] > at]
            tried.append((gini(here) - (len(left) * gini(left) + len(right) * gini(right)) / len(here), i, at, left, right))
        if not tried:
            return
        gain, i, at, left, right = max(tried, key=lambda t: t[0])
        out[tree, node] = (FEATURES[i], at, len(here), len(left), gain)
        grow(tree, 2 * node, left, level + 1)
        grow(tree, 2 * node + 1, right, level + 1)

    for tree in range(n_trees):
        grow(tree, 1, rows, 0)
    return out


def test_trees_match_plain_growth_in_any_partitioning(spark):
    rows = rows_of(300)
    want = plain_trees(rows, 7, 4)
    data = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0), ("x", None, 1.0, 1.0, 1.0),
                                         ("x", float("nan"), 1.0, 1.0, 1.0)], "label string, a double, b double, c double, d double")
    for parts in (1, 6):
        splits = trees.fit_extra_trees(data.repartition(parts), FEATURES, "label", trees=7, depth=4)
        got = {(s.tree, s.node): (s.feature, s.threshold, s.n, s.n_left, s.gain) for s in splits}
        assert got.keys() == want.keys()
        assert all(got[k][:4] == want[k][:4] and abs(got[k][4] - want[k][4]) < 1e-12 for k in want)
    found = {r["feature"]: r["importance"] for r in trees.importance(spark, splits, FEATURES).collect()}
    assert sum(found.values()) == pytest.approx(1) and found["d"] == 0 and found["a"] > found["b"] and found["c"] > found["b"]


def test_nothing_to_split(spark):
    schema = "label string, a double, b double, c double, d double"
    for rows in ([], [("x", 1.0, 2.0, 3.0, 4.0)] * 5, [("x", 1.0, 1.0, 1.0, 1.0), ("y", 1.0, 1.0, 1.0, 1.0)]):
        assert trees.fit_extra_trees(spark.createDataFrame(rows, schema), FEATURES, "label", trees=3) == []
    assert {r["importance"] for r in trees.importance(spark, [], FEATURES).collect()} == {0.0}
