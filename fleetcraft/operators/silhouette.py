"""Euclidean silhouette of points in the plane, linear in rows, with an error bound per row.

The mean distance of a point to a cluster needs all pairs. Here the cluster is
a quadtree: a cell holds, for each cluster, how many of its points lie there,
their mean, and their mean square distance from it. The distance to a cell's
points is taken to their mean. That errs by v at most, the root of the mean
square distance v^2, and, away from the cell, by v^2 / 2d at most for a least
distance d to the cell (the linear term is none at the mean). A cell of equal
points is exact.

The tree is grown level by level, one aggregate a level: the cells with the
largest n v are split until all are exact or ``cells`` are reached. The
finished cells, bounded by that, are shipped to the tasks, which compare each
point with all of them. No pairs of points are formed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of the finished tree, at most; levels; and children of a cell along each side, so that few levels do.
CELLS, LEVELS, FAN = 4096, 20, 4
#: Points of a task that meet all cells at a time.
ROWS = 256


def quadtree(points: DataFrame, cells: int = CELLS, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Cells over ``c1, c2, cluster``. First array, a row each: cluster, n, mean x, mean y, v^2, and the cell's box
    (least x, least y, greatest x, greatest y of the points). Second array: the clusters, ascending."""
    box = points.agg(F.min("c1"), F.min("c2"), F.max("c1"), F.max("c2")).first()
    if box[0] is None:
        return np.zeros((0, 9)), np.zeros(0)
    wide = max(box[2] - box[0], box[3] - box[1]) or 1.0
    unit = points.select("c1", "c2", "cluster", ((F.col("c1") - box[0]) / wide).alias("u"), ((F.col("c2") - box[1]) / wide).alias("w"))
    done: list[tuple] = []
    n_done = 0
    open_cells: list[tuple[int, int]] = [(0, 0)]
    for level in range(levels + 1):
        side = float(FAN) ** level
        at = [F.least(F.floor(F.col(c) * side), F.lit(side - 1)).cast("long").alias(n) for c, n in (("u", "i"), ("w", "j"))]
        wanted = points.sparkSession.createDataFrame(open_cells, "i long, j long")
        inside = unit.select("*", *at).join(F.broadcast(wanted), ["i", "j"], "left_semi")
        # moments about the cell's corner: the cell is small where its variance is
        x, y = (F.col(c) - (F.col(n) / side * wide + low) for c, n, low in (("c1", "i", box[0]), ("c2", "j", box[1])))
        stats = inside.groupBy("i", "j", "cluster").agg(
            F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"),
            (F.var_pop(x) + F.var_pop(y)).alias("v"), F.min("c1"), F.min("c2"), F.max("c1"), F.max("c2")).collect()
        by_cell: dict[tuple[int, int], list] = {}
        for r in stats:
            equal = r[7] == r[9] and r[8] == r[10]
            mean = (r[7], r[8]) if equal else (r["x"] + r["i"] / side * wide + box[0], r["y"] + r["j"] / side * wide + box[1])
            by_cell.setdefault((r["i"], r["j"]), []).append(
                (r["cluster"], r["n"], *mean, 0.0 if equal else max(0.0, r["v"]), r[7], r[8], r[9], r[10]))
        weight = {c: sum(n * v ** 0.5 for _, n, _, _, v, *_ in rows) for c, rows in by_cell.items()}
        split = sorted((c for c in by_cell if weight[c] > 0), key=lambda c: (-weight[c], c))
        room = cells - n_done - len(by_cell)
        split = split[:max(0, room // (FAN * FAN - 1))] if level < levels else []
        for c in set(by_cell) - set(split):
            done += by_cell[c]
            n_done += 1
        open_cells = [(FAN * i + a, FAN * j + b) for i, j in split for a in range(FAN) for b in range(FAN)]
        if not open_cells:
            break
    tree = np.array(sorted(done), dtype=np.float64)
    return tree, np.unique(tree[:, 0])


def _apart(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Root of the summed squares, written over the first."""
    dx *= dx
    dy *= dy
    dx += dy
    return np.sqrt(dx, out=dx)


def mean_distances(x: np.ndarray, tree: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of distances of each point to each cluster's points, and how far it may be off."""
    n, v = tree[:, 1], tree[:, 4]
    # a column per cluster: how many of its points lie in each cell
    held = np.where(tree[:, :1] == clusters, n[:, None], 0.0)
    total = _apart(x[:, 0:1] - tree[:, 2], x[:, 1:2] - tree[:, 3]) @ held
    # an exact cell errs by nothing, so only the others are measured
    loose = np.flatnonzero(v > 0)
    low, high, v = tree[loose, 5:7], tree[loose, 7:9], v[loose]
    gap = _apart(*(x[:, k:k + 1] - np.clip(x[:, k:k + 1], low[:, k], high[:, k]) for k in (0, 1)))
    with np.errstate(divide="ignore"):
        off = np.divide(v / 2, gap, out=gap)
    error = np.minimum(off, np.sqrt(v), out=off) @ held[loose]
    return total, error


def scores(x: np.ndarray, own: np.ndarray, tree: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Silhouette of each point, and its error bound."""
    sizes = np.array([tree[tree[:, 0] == c, 1].sum() for c in clusters])
    total, error = mean_distances(x, tree, clusters)
    at = np.searchsorted(clusters, own)
    rows = np.arange(len(x))
    if len(clusters) < 2:
        return np.zeros(len(x)), np.zeros(len(x))
    others = np.maximum(1, sizes[at] - 1)
    a, a_off = total[rows, at] / others, error[rows, at] / others
    mean, off = total / sizes, error / sizes
    mean[rows, at] = np.inf
    b = mean.min(axis=1)
    off[rows, at] = 0
    b_off = off.max(axis=1)
    top = np.maximum(a, b)
    score = np.where((sizes[at] <= 1) | (top <= 0), 0.0, (b - a) / np.where(top > 0, top, 1))
    # s = (b - a) / max(a, b) changes by (da + db) / max(a, b) at most along the way, and never by more than 2
    least = top - np.maximum(a_off, b_off)
    bound = np.where(least > 0, np.minimum(2.0, (a_off + b_off) / np.where(least > 0, least, 1)), 2.0)
    return score, np.where((sizes[at] <= 1) | (a_off + b_off <= 0), 0.0, bound)


def euclidean_silhouette(assigned: DataFrame, keep: Sequence[str], dims: Sequence[str] = ("c1", "c2"), out: str = "cluster",
                         cells: int = CELLS) -> DataFrame:
    """``keep`` columns, the cluster, ``silhouette`` and ``error_bound`` of each row with both coordinates and a cluster.

    A point alone in its cluster scores 0, and so do all points of a single
    cluster. ``assigned`` is read once a level: give a stored table.
    """
    rows = assigned.na.drop(subset=[*dims, out])
    tree, clusters = quadtree(rows.select(*[F.col(d).cast("double").alias(n) for d, n in zip(dims, ("c1", "c2"))],
                                          F.col(out).cast("double").alias("cluster")), cells)
    shared = assigned.sparkSession.sparkContext.broadcast((tree, clusters))
    source = rows.select(*keep, *([out] if out not in keep else []), *[F.col(d).cast("double").alias(f"__{d}") for d in dims],
                         F.col(out).cast("double").alias("__own"))
    kept = source.columns[:-3]
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField("silhouette", T.DoubleType()),
                                                              T.StructField("error_bound", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, y, own = (part.column(len(kept) + k).to_numpy() for k in range(3))
                score, bound = scores(np.stack([x, y], axis=1), own, *shared.value)
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(arrow.field(i).type) for i in range(len(kept))],
                                                  pa.array(score), pa.array(bound)], schema=arrow)

    return source.mapInArrow(run, schema)
