"""K-means for many starts and many k at once.

All runs, one per (k, seed), share their passes over the points. A pass maps
every batch of points against the centres of all runs in numpy and returns one
small row per run and cluster; Spark adds them up. Seeding is k-means++: the
next centre of a run is drawn with a chance in proportion to the squared
distance to its nearest centre, by an exponential race whose random numbers
come from a hash of the point's key, so a pass needs one minimum per run and a
repeated task draws alike. Lloyd rounds stop, run by run, when no centre moves
by more than ``tol``.

What reaches the driver is runs x k x dimensions numbers a pass.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a task that meet all centres at a time.
ROWS = 2048


@dataclass
class Run:
    """One start: its centres, the sum of squared distances to them, and whether they still move."""

    k: int
    seed: int
    centers: np.ndarray
    cost: float = np.inf
    rounds: int = 0
    moving: bool = True


def _chance(keys: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number over 0 and at most 1 for each key, from a hash of key, seed and step."""
    z = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 1) / 2 ** 53


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, point by centre: one plane a coordinate, added up in order.

    Each centre's distances lie together, as do each coordinate's values: a run has few centres and a batch many points.
    """
    total, apart = np.zeros((len(centers), len(x))), np.empty((len(centers), len(x)))
    for j in range(x.shape[1]):
        np.subtract(x[:, j], centers[:, j:j + 1], out=apart)
        apart *= apart
        total += apart
    return total.T


def _nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point, of equals the first, and its squared distance."""
    near, least = np.zeros(len(distances), dtype=np.intp), distances[:, 0].copy()
    for k in range(1, distances.shape[1]):
        near[distances[:, k] < least] = k
        np.minimum(least, distances[:, k], out=least)
    return near, least


def _points(points: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """Hash of the key and coordinates; rows with a missing coordinate are not points."""
    return (points.na.drop(subset=list(dims))
            .select(F.xxhash64(F.col(key).cast("string")).alias("h"), *[F.col(d).cast("double").alias(d) for d in dims]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        for at in range(0, batch.num_rows, ROWS):
            yield columns[0][at:at + ROWS].astype(np.int64), np.stack([c[at:at + ROWS] for c in columns[1:]]).T


def _draw(source: DataFrame, dims: Sequence[str], runs: list[Run], step: int) -> dict[int, list[float]]:
    """For each run the point that wins the race; none where every point lies on a centre."""
    states = [(i, r.seed, r.centers) for i, r in enumerate(runs)]
    schema = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("time", T.DoubleType()),
                           *[T.StructField(d, T.DoubleType()) for d in dims]])

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, ...]] = {}
        for keys, x in _batches(batches):
            for i, seed, centers in states:
                weight = _distances(x, centers).min(axis=1) if len(centers) else np.ones(len(x))
                with np.errstate(divide="ignore", invalid="ignore"):
                    time = np.where(weight > 0, -np.log(_chance(keys, seed, step)) / weight, np.inf)
                at = int(time.argmin())
                if np.isfinite(time[at]):
                    best[i] = min(best.get(i, (np.inf,)), (float(time[at]), *map(float, x[at])))
        rows = [(i, *b) for i, b in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema),
                                                                              to_arrow_schema(schema))],
                                         schema=to_arrow_schema(schema))

    found = source.mapInArrow(race, schema).groupBy("run").agg(F.min(F.struct("time", *dims)).alias("best"))
    return {r["run"]: [r["best"][d] for d in dims] for r in found.collect()}


def assignment_sums(source: DataFrame, dims: Sequence[str], centers: Sequence[np.ndarray]) -> DataFrame:
    """One Lloyd pass: ``run, cluster, n``, the sum of each coordinate, and ``cost``, over the points nearest to each
    centre of each run (of equals the first). ``source`` is a key hash followed by the coordinates."""
    sums = [f"s_{d}" for d in dims]
    schema = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
                           T.StructField("n", T.LongType()), *[T.StructField(s, T.DoubleType()) for s in sums],
                           T.StructField("cost", T.DoubleType())])
    states = [np.asarray(c, dtype=np.float64) for c in centers]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(c), len(dims) + 2)) for c in states]
        for _, x in _batches(batches):
            for c, total in zip(states, totals):
                near, least = _nearest(_distances(x, c))
                total[:, 0] += np.bincount(near, minlength=len(c))
                for j in range(len(dims)):
                    total[:, 1 + j] += np.bincount(near, weights=x[:, j], minlength=len(c))
                total[:, -1] += np.bincount(near, weights=least, minlength=len(c))
        rows = [(i, k, int(row[0]), *map(float, row[1:])) for i, total in enumerate(totals)
                for k, row in enumerate(total) if row[0]]
        arrow = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), arrow)],
                                         schema=arrow)

    return (source.mapInArrow(add, schema).groupBy("run", "cluster")
            .agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums], F.sum("cost").alias("cost")))


def lloyd_round(points: DataFrame, centers: Sequence[Sequence[float]], key: str, dims: Sequence[str]) -> DataFrame:
    """One round from given centres: ``cluster, n``, the new centre under the names of ``dims``, and ``cost`` at the old one."""
    sums = assignment_sums(_points(points, key, dims), dims, [np.array(centers)])
    return sums.select("cluster", "n", *[(F.col(f"s_{d}") / F.col("n")).alias(d) for d in dims], "cost")


def fit_many(points: DataFrame, ks: Sequence[int], seeds: Sequence[int], key: str, dims: Sequence[str],
             max_iter: int = 300, tol: float = 1e-4) -> list[Run]:
    """All runs, fitted together. ``points`` is read once a pass: give a stored table.

    A run that finds fewer different points than k keeps the centres it found.
    A cluster that loses all its points keeps its centre. No points: no centres
    and a cost of 0.
    """
    source = _points(points, key, dims)
    runs = [Run(k, s, np.zeros((0, len(dims)))) for k in ks for s in seeds]
    for step in range(max(ks, default=0)):
        open_runs = [r for r in runs if r.k > step]
        found = _draw(source, dims, open_runs, step)
        for i, center in found.items():
            open_runs[i].centers = np.vstack([open_runs[i].centers, center])
    for r in runs:
        if not len(r.centers):
            r.cost, r.moving = 0.0, False
    for _ in range(max_iter + 1):
        moving = [r for r in runs if r.moving]
        if not moving:
            break
        costs = np.zeros(len(moving))
        fresh = [r.centers.copy() for r in moving]
        for row in assignment_sums(source, dims, [r.centers for r in moving]).collect():
            costs[row["run"]] += row["cost"]
            fresh[row["run"]][row["cluster"]] = [row[f"s_{d}"] / row["n"] for d in dims]
        for r, cost, centers in zip(moving, costs, fresh):
            r.cost = float(cost)
            shift = float(np.sqrt(((centers - r.centers) ** 2).sum(axis=1)).max())
            if shift <= tol or r.rounds >= max_iter:
                # the cost belongs to the centres it was measured at
                r.moving = False
            else:
                r.centers, r.rounds = centers, r.rounds + 1
    return runs
