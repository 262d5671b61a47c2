"""Extremely randomised trees, grown level by level with one pass a level for all trees.

Each node of each tree draws a few features that vary there and for each one
threshold, evenly between its least and greatest value, and splits at the one
with the greatest Gini decrease. A task walks its rows down every tree and
counts, for each candidate and side, the rows of every class and the range of
every feature (from which the next level draws); Spark adds the partial counts
up. Rows per pass on the driver: two for each candidate of the open nodes, so
their number follows ``trees`` and ``depth`` and not the data.

Draws are hashes of (seed, tree, node, feature) and the counts are exact, so
the trees do not depend on how the data are partitioned. Rows with a NULL or
NaN in a feature or without a label are left out; ties go to the feature drawn
first; no rows, one class or constant features give trees without splits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcraft.sources.tables import materialise


@dataclass(frozen=True)
class Split:
    """A node (the root is 1, the children of i are 2i and 2i + 1) and its split: left where feature <= threshold."""

    tree: int
    node: int
    feature: str
    threshold: float
    n: int
    n_left: int
    gain: float


def _hex(seed: int, tree: int, node: int, feature: str, use: str) -> str:
    return hashlib.md5(f"{seed}:{tree}:{node}:{feature}:{use}".encode()).hexdigest()


def _candidates(seed: int, tree: int, node: int, features: Sequence[str], low, high, many: int) -> list[tuple[int, float]]:
    """The features a node tries, in drawn order, each with its threshold."""
    vary = [i for i in range(len(features)) if high[i] > low[i]]
    vary.sort(key=lambda i: _hex(seed, tree, node, features[i], "pick"))
    out = []
    for i in vary[:many]:
        u = int(_hex(seed, tree, node, features[i], "at")[:8], 16) / 4294967296
        at = low[i] + u * (high[i] - low[i])
        out.append((i, float(at if at < high[i] else low[i])))
    return out


def _gini(counts: np.ndarray) -> float:
    n = int(counts.sum())
    return 1 - int((counts * counts).sum()) / (n * n) if n else 0.0


def _level(data: DataFrame, taken: dict, tried: dict, trees: int, level: int, many: int, classes: int,
           features: Sequence[str]) -> DataFrame:
    """``tree, slot, c0.., low0.., high0..``: classes and ranges on both sides of every candidate of a level."""
    first, width, n_features = 1 << level, 1 << level, len(features)
    shared = data.sparkSession.sparkContext.broadcast((taken, tried))

    def tables():
        splits, candidates = shared.value
        feature = np.full((trees, first + width), -1, dtype=np.int32)
        at = np.zeros((trees, first + width))
        for (tree, node), (i, threshold) in splits.items():
            feature[tree, node], at[tree, node] = i, threshold
        trial = np.full((trees, width, many), -1, dtype=np.int32)
        trial_at = np.zeros((trees, width, many))
        for (tree, node), found in candidates.items():
            for k, (i, threshold) in enumerate(found):
                trial[tree, node - first, k], trial_at[tree, node - first, k] = i, threshold
        return feature, at, trial, trial_at

    names = ["tree", "slot", "counts", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, at, trial, trial_at = tables()
        slots = width * many * 2
        counts = np.zeros((trees, slots * classes), dtype=np.int64)
        low, high = np.full((trees, slots, n_features), np.inf), np.full((trees, slots, n_features), -np.inf)
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.column_stack([batch.column(1 + i).to_numpy() for i in range(n_features)])
            for tree in range(trees):
                node, rows = np.ones(len(y), dtype=np.int64), np.arange(len(y))
                for _ in range(level):
                    f = feature[tree, node]
                    rows, node, f = rows[f >= 0], node[f >= 0], f[f >= 0]
                    node = 2 * node + (x[rows, f] > at[tree, node])
                for k in range(many):
                    f = trial[tree, node - first, k]
                    here, open_node, f = rows[f >= 0], node[f >= 0] - first, f[f >= 0]
                    if not len(here):
                        continue
                    right = x[here, f] > trial_at[tree, open_node, k]
                    slot = (open_node * many + k) * 2 + right
                    counts[tree] += np.bincount(slot * classes + y[here], minlength=slots * classes)
                    order = np.argsort(slot, kind="stable")
                    held, starts = np.unique(slot[order], return_index=True)
                    values = x[here[order]]
                    low[tree, held] = np.minimum(low[tree, held], np.minimum.reduceat(values, starts))
                    high[tree, held] = np.maximum(high[tree, held], np.maximum.reduceat(values, starts))
        by_slot = counts.reshape(trees, slots, classes)
        for tree in range(trees):
            held = np.flatnonzero(by_slot[tree].sum(axis=1))
            if len(held):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(held), tree), pa.int32()), pa.array(held, pa.int32()),
                     pa.array(by_slot[tree, held].tolist(), pa.list_(pa.int64())),
                     pa.array(low[tree, held].tolist(), pa.list_(pa.float64())),
                     pa.array(high[tree, held].tolist(), pa.list_(pa.float64()))], names)

    part = data.mapInArrow(run, "tree int, slot int, counts array<long>, low array<double>, high array<double>")
    return part.groupBy("tree", "slot").agg(
        F.array(*[F.sum(F.col("counts")[j]) for j in range(classes)]).alias("counts"),
        F.array(*[F.min(F.col("low")[i]) for i in range(n_features)]).alias("low"),
        F.array(*[F.max(F.col("high")[i]) for i in range(n_features)]).alias("high"))


def fit_extra_trees(labelled: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 8,
                    seed: int = 42) -> list[Split]:
    """The splits of ``trees`` trees of at most ``depth`` levels that tell ``label`` apart (few classes) by ``features``."""
    columns = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    data = labelled.select(F.col(label).cast("string").alias("label"), *columns).na.drop()
    data = materialise(data, "trees-input")
    root = data.groupBy("label").agg(F.count("*").alias("n"), *[F.min(f"f{i}").alias(f"low{i}") for i in range(len(features))],
                                     *[F.max(f"f{i}").alias(f"high{i}") for i in range(len(features))]).orderBy("label").collect()
    if not root:
        return []
    place = F.array_position(F.array(*[F.lit(r["label"]) for r in root]), F.col("label")).cast("int") - 1
    data = data.select(place.alias("y"), *[f"f{i}" for i in range(len(features))])
    many = max(1, math.isqrt(len(features)))
    whole = (np.array([r["n"] for r in root], dtype=np.int64), [min(r[f"low{i}"] for r in root) for i in range(len(features))],
             [max(r[f"high{i}"] for r in root) for i in range(len(features))])
    open_nodes = {(tree, 1): whole for tree in range(trees)}
    taken: dict[tuple[int, int], tuple[int, float]] = {}
    out: list[Split] = []
    for level in range(depth):
        tried = {at: found for at, (counts, low, high) in open_nodes.items() if np.count_nonzero(counts) > 1
                 and (found := _candidates(seed, *at, features, low, high, many))}
        if not tried:
            break
        sides = {(r["tree"], r["slot"]): (np.array(r["counts"], dtype=np.int64), r["low"], r["high"])
                 for r in _level(data, taken, tried, trees, level, many, len(root), features).collect()}
        following = {}
        for (tree, node), found in tried.items():
            counts = open_nodes[tree, node][0]
            n, best = int(counts.sum()), None
            for k in range(len(found)):
                slot = ((node - (1 << level)) * many + k) * 2
                left, right = sides[tree, slot], sides[tree, slot + 1]
                n_left, n_right = int(left[0].sum()), int(right[0].sum())
                gain = _gini(counts) - (n_left * _gini(left[0]) + n_right * _gini(right[0])) / n
                if best is None or gain > best[0]:
                    best = (gain, k, left, right, n_left)
            gain, k, left, right, n_left = best
            taken[tree, node] = found[k]
            out.append(Split(tree, node, features[found[k][0]], found[k][1], n, n_left, gain))
            following[tree, 2 * node], following[tree, 2 * node + 1] = left, right
        open_nodes = following
    return out


def splits_table(spark, splits: Sequence[Split]) -> DataFrame:
    """The splits as data."""
    rows = [(s.tree, s.node, s.feature, s.threshold, s.n, s.n_left, s.gain) for s in splits]
    return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, n long, n_left long, gain double")


def importance(spark, splits: Sequence[Split], features: Sequence[str], top: int = 12) -> DataFrame:
    """``feature, importance``: each tree's Gini decreases by feature, as shares of the tree, averaged over trees."""
    total = {f: 0.0 for f in features}
    trees = sorted({s.tree for s in splits})
    for tree in trees:
        own = [s for s in splits if s.tree == tree]
        whole = math.fsum(s.n * s.gain for s in own)
        for f in features:
            if whole > 0:
                total[f] += math.fsum(s.n * s.gain for s in own if s.feature == f) / whole / len(trees)
    rows = spark.createDataFrame(list(total.items()), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)
