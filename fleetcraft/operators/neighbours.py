"""Cosine neighbour graph and a non-linear layout over it.

The graph is found by neighbour descent, with bounded lists throughout. Rows of
the same direction are merged first. Each point starts with the nearest of a
few small groups it is dealt to; in each round it asks the points on its list
(its neighbours, and a hashed sample of those that list it) for their lists and
keeps the ``k`` nearest of all it has heard of. A round is one grouped aggregate
and one join; no stage forms all pairs, and a point that many others list is
one row that many ask for, which AQE splits. The graph is approximate; tests
and ``recall`` measure it against brute force.

The layout takes the leading eigenvectors of the graph's random walk (a
diffusion map) by subspace iteration: a pass is one join of edges with
coordinates and one grouped aggregate. New rows are placed by their nearest
landmarks, which are stored with the layout.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcraft.functions.joins import with_one_row
from fleetcraft.sources.tables import materialise

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Neighbours of a point; those a point remembers that list it; rounds at most; a round that changes fewer rows ends it.
NEIGHBOURS, LISTED_BY, ROUNDS, STILL = 9, 18, 12, 0.001
#: Points of a starting group, and groups each point starts in.
GROUP, STARTS = 32, 4
#: Points of a block that measuring queries meet at a time, and queries that meet it together.
BLOCK, ASKED = 4096, 1024
#: Distances are whole multiples of this, so equal ones tie however they were added up.
GRAIN = 1e-12


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def directions(rows: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``id`` (the smallest key of a direction), ``v`` (unit vector), ``key`` of each row with all features and not all zero."""
    x = [F.col(f).cast("double") for f in features]
    norm = F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0]))
    unit = (rows.na.drop(subset=list(features)).select(F.col(key).alias("key"), F.array(*x).alias("x"), norm.alias("norm"))
            .where("norm > 0").select("key", F.transform("x", lambda v: F.round(v / F.col("norm"), 12)).alias("v")))
    return unit.join(unit.groupBy("v").agg(F.min("key").alias("id")), "v").select("id", "v", "key")


def _nearest(own: Column, v: Column, others: Column, k: int) -> Column:
    """The k nearest of some points (structs of id and v) to one, as structs of distance, id and v, without itself."""
    apart = F.filter(others, lambda o: o["id"] != own)
    near = F.transform(apart, lambda o: F.struct(
        (F.round((F.lit(1.0) - _dot(v, o["v"])) / GRAIN) * GRAIN).alias("d"), o["id"].alias("id"), o["v"].alias("v")))
    return F.slice(_sorted_once(near), 1, k)


def _sorted_once(items: Column) -> Column:
    """The different items in order. Equal ones meet by the sort: ``array_distinct`` compares structs pair by pair."""
    # an array of one array names the sorted one, so that it is sorted once
    kept = F.transform(F.array(F.sort_array(items)), lambda a: F.filter(
        a, lambda o, i: (i == 0) | (o != F.get(a, i - 1))))
    return kept[0]


def _start(points: DataFrame, k: int) -> DataFrame:
    """First lists: the nearest in small groups. A group is a stretch of the directions on one side of some fixed
    planes, dealt by hash into parts of about GROUP points."""
    width = len(points.first()["v"])
    n = points.count()
    bits = max(0, int(np.log2(max(1, n / GROUP))))
    out = None
    for t in range(STARTS):
        planes = np.random.default_rng(100 + t).normal(size=(min(bits, 16), width))
        # the first start is by hash alone, so that far parts of the graph hear of each other
        code = F.concat_ws("", *[F.when(_dot(F.col("v"), F.array(*map(F.lit, map(float, p)))) > 0, "1").otherwise("0")
                                 for p in planes]) if t and bits else F.lit("")
        coded = points.withColumn("code", code)
        sizes = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
        dealt = coded.join(sizes, "code").withColumn("part", F.pmod(F.xxhash64("id", F.lit(t)), F.col("parts")))
        groups = dealt.groupBy("code", "part").agg(F.collect_list(F.struct("id", "v")).alias("all"))
        found = groups.select(F.explode("all").alias("p"), "all").select("p.id", "p.v", _nearest(F.col("p.id"), F.col("p.v"), F.col("all"), k).alias("near"))
        out = found if out is None else out.unionByName(found)
    merged = out.groupBy("id", "v").agg(F.flatten(F.collect_list("near")).alias("all"))
    return merged.select("id", "v", F.slice(F.array_sort(F.array_distinct("all")), 1, k).alias("near"))


def _round(graph: DataFrame, k: int, step: int) -> DataFrame:
    """One round: who lists whom, what their lists say, and the k nearest of it."""
    edges = graph.select("id", "v", F.explode("near").alias("to"))
    slot = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(LISTED_BY)).alias("slot")
    # one lister a slot: a partial aggregate, however many list the point
    back = (edges.select(F.col("to.id").alias("of"), slot, F.struct(F.xxhash64("id", F.lit(step + 1000)).alias("h"), "id", "v").alias("who"))
            .groupBy("of", "slot").agg(F.min("who").alias("who"))
            .groupBy("of").agg(F.collect_list(F.struct("who.id", "who.v")).alias("back")))
    known = F.transform("near", lambda o: F.struct(o["id"].alias("id"), o["v"].alias("v")))
    lists = materialise(graph.join(back, graph["id"] == back["of"], "left").select(
        "id", "v", "near", F.array_union(known, F.coalesce("back", F.array().cast(back.schema["back"].dataType))).alias("list")),
        "neighbour-lists")
    asked = lists.select(F.col("id").alias("me"), F.explode(F.transform("list", lambda o: o["id"])).alias("id"))
    told = (asked.join(lists.select("id", "list"), "id").groupBy("me")
            .agg(F.flatten(F.collect_list("list")).alias("heard")))
    met = lists.join(told, lists["id"] == told["me"], "left")
    # what is heard twice is dropped once it is sorted by distance
    every = F.concat("list", F.coalesce("heard", "list"))
    return met.select("id", "v", _nearest(F.col("id"), F.col("v"), every, k).alias("near"),
                      F.col("near").alias("before"))


def neighbour_graph(points: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, still: float = STILL) -> DataFrame:
    """``id, v, near`` over the different directions (``id``, ``v``): the k nearest others as structs ``d, id, v``,
    by cosine distance, then id. Fewer than k others: all of them. Stored, so it can be read many times."""
    nodes = materialise(points.select("id", "v").distinct(), "directions")
    n = nodes.count()
    if not n:
        return nodes.select("id", "v", F.array().cast("array<struct<d:double,id:string,v:array<double>>>").alias("near"))
    graph = materialise(_start(nodes, k), "neighbours")
    for step in range(rounds):
        fresh = materialise(_round(graph, k, step), "neighbours")
        changed = fresh.agg(F.count_if(F.transform("near", lambda o: o["id"]) != F.transform("before", lambda o: o["id"]))).first()[0]
        graph = fresh.drop("before")
        if changed <= still * n:
            break
    return graph


def edge_rows(graph: DataFrame) -> DataFrame:
    """``id, rank, neighbour, distance``: a row per edge, rank from 1."""
    return graph.select("id", F.posexplode("near").alias("at", "to")).select(
        "id", (F.col("at") + 1).alias("rank"), F.col("to.id").alias("neighbour"), F.col("to.d").alias("distance"))


def _block_distances(rows: pa.Table) -> pa.Table:
    """The least distances of a group's asking points to its other points: ``id, v, found``."""
    rows = rows.combine_chunks()
    asks = rows["asks"].to_numpy()
    v = rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    number = np.unique(rows["id"].to_numpy().astype(str), return_inverse=True)[1]
    d = np.rint((1 - v[asks] @ v[~asks].T) / GRAIN) * GRAIN
    d[number[asks][:, None] == number[~asks]] = np.inf
    d = np.sort(np.partition(d, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS] if d.shape[1] > NEIGHBOURS else d, axis=1)
    found = [row[np.isfinite(row)].tolist() for row in d]
    asking = rows.filter(rows["asks"])
    return pa.table({"id": asking["id"], "v": asking["v"], "found": pa.array(found, pa.list_(pa.float64()))})


def recall(graph: DataFrame, of: int = 50) -> DataFrame:
    """One row: ``queries``, ``recall``. A set of points (hash divisible by ``of``) against all points, brute force;
    the share of their k nearest, by distance, that the graph has.

    All pairs of queries and points are measured, a block of each at a time, so a task holds two blocks at most."""
    graph = graph.where("id IS NOT NULL")
    asked = graph.where(F.pmod(F.xxhash64("id"), F.lit(of)) == 0)
    n, n_asked = graph.agg(F.count(F.lit(1)), F.count_if(F.pmod(F.xxhash64("id"), F.lit(of)) == 0)).first()
    parts, groups = max(1, -(-n // BLOCK)), max(1, -(-n_asked // ASKED))

    def dealt(count: int) -> Column:
        # not the hash that picks the queries
        return F.pmod(F.xxhash64("id", F.lit(count)), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    met = (asked.select(every(parts).alias("block"), dealt(groups).alias("group"), "id", "v", F.lit(True).alias("asks"))
           .unionByName(graph.select(dealt(parts).alias("block"), every(groups).alias("group"), "id", "v", F.lit(False).alias("asks"))))
    part = met.groupBy("block", "group").applyInArrow(_block_distances, "id string, v array<double>, found array<double>")
    least = part.groupBy("id", "v").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("all"))
    best = asked.where(F.size("near") > 0).join(least, ["id", "v"]).select("near", F.slice("all", 1, F.size("near")).alias("want"))
    farthest = F.element_at("want", -1)
    hit = F.size(F.filter("near", lambda o: o["d"] <= farthest + 1e-9))
    return best.where(F.size("want") > 0).agg(F.count(F.lit(1)).alias("queries"), (F.sum(hit) / F.sum(F.size("want"))).alias("recall"))


# ---------------------------------------------------------------------------
# Layout
# ---------------------------------------------------------------------------

#: Coordinates, passes of subspace iteration, and points that place new rows.
DIMENSIONS, PASSES, LANDMARKS = 2, 16, 512


def _walk(graph: DataFrame) -> DataFrame:
    """Symmetric weights of the graph's edges, scaled by the roots of both ends' sums: ``i, j, w``, with ``i = j`` too."""
    width = F.greatest(F.element_at("near", -1)["d"], F.lit(1e-9))
    one = graph.where(F.size("near") > 0).select("id", F.explode("near").alias("to"), width.alias("s")).select(
        F.col("id").alias("i"), F.col("to.id").alias("j"), F.exp(-F.col("to.d") / F.col("s")).alias("w"))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    edges = both.groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))
    loops = graph.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w"))
    edges = materialise(edges.unionByName(loops), "edges")
    sums = materialise(edges.groupBy("i").agg(F.sum("w").alias("s")), "degrees")
    scaled = (edges.join(sums, "i").withColumnRenamed("s", "si")
              .join(sums.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j"))
    return scaled.select("i", "j", (F.col("w") / F.sqrt(F.col("si") * F.col("sj"))).alias("w"), F.col("si").alias("s"))


def layout(graph: DataFrame, dims: int = DIMENSIONS, passes: int = PASSES, seed: int = 42) -> DataFrame:
    """``id, v, c1..``: the leading eigenvectors of the walk after the constant one, each divided by that one, length 1
    over the points before, and its largest entry positive.

    Starting values come from a hash of the id, and the block is made
    orthonormal each pass by its own small product matrix, which alone reaches
    the driver. Coordinates do not depend on partitioning beyond rounding. A
    graph of several parts has as many leading vectors that are constant on them.
    """
    walk = materialise(_walk(graph), "walk")
    size = dims + 2
    names = [f"x{k}" for k in range(size)]
    start = [F.sqrt("s").alias("x0")] + [(F.xxhash64("i", F.lit(seed + k)) / F.lit(2.0 ** 63)).alias(f"x{k}") for k in range(1, size)]
    now = walk.where("i = j").select("i", *start)

    def gram(a: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
        row = a.agg(*[F.sum(F.col(p) * F.col(q)) for p in left for q in right]).first()
        return np.array([x or 0.0 for x in row], dtype=np.float64).reshape(len(left), len(right))

    def turned(a: DataFrame, turn: np.ndarray) -> DataFrame:
        return a.select("i", *[sum((F.col(p) * float(turn[r, c]) for r, p in enumerate(names)), F.lit(0.0)).alias(f"x{c}")
                               for c in range(size)])

    def orthonormal(a: DataFrame) -> DataFrame:
        matrix = gram(a, names, names)
        scale = 1 / np.sqrt(np.maximum(np.diag(matrix), 1e-300))
        values, vectors = np.linalg.eigh(matrix * scale * scale[:, None])
        return materialise(turned(a, scale[:, None] * vectors / np.sqrt(np.maximum(values, 1e-12))), "layout")

    now = orthonormal(now)
    for last in [False] * passes + [True]:
        # half a step stays where it is, so that no eigenvalue is negative
        moved = (walk.join(now.withColumnRenamed("i", "j"), "j").groupBy("i")
                 .agg(*[F.sum(F.col("w") * F.col(c)).alias(f"y{c[1:]}") for c in names]))
        step = now.join(moved, "i")
        if last:
            small = gram(materialise(step, "layout-step"), names, [f"y{k}" for k in range(size)])
            values, turn = np.linalg.eigh((small + small.T) / 2)
            now = materialise(turned(now, turn[:, ::-1]), "layout")
        else:
            now = orthonormal(step.select("i", *[((F.col(f"x{k}") + F.col(f"y{k}")) / 2).alias(f"x{k}") for k in range(size)]))
    coordinates = [(F.col(f"x{k}") / F.col("x0")).alias(f"c{k}") for k in range(1, dims + 1)]
    placed = materialise(now.select(F.col("i").alias("id"), *coordinates), "coordinates")
    heads = placed.agg(*[F.max(F.struct(F.round(F.abs(f"c{k}"), 9).alias("a"), "id", F.col(f"c{k}").alias("c"))).alias(f"c{k}")
                         for k in range(1, dims + 1)]).first()
    signs = {k: -1.0 if heads and heads[f"c{k}"] is not None and heads[f"c{k}"]["c"] < 0 else 1.0 for k in range(1, dims + 1)}
    signed = placed.select("id", *[(F.col(f"c{k}") * signs[k]).alias(f"c{k}") for k in range(1, dims + 1)])
    return graph.select("id", "v").join(signed, "id")


def landmarks(placed: DataFrame, n: int = LANDMARKS) -> DataFrame:
    """The points of a layout that are kept to place new rows: the n with the smallest hash of the id."""
    return placed.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(n).drop("h")


def place(points: DataFrame, marks: DataFrame, k: int = 5, dims: int = DIMENSIONS) -> DataFrame:
    """``id, v, c1..`` of new directions: the mean of their k nearest landmarks' coordinates, weighted by nearness; one
    of a landmark's own direction lands on it. The landmarks are LANDMARKS rows at most, so they are shipped as one row."""
    held = marks.agg(F.collect_list(F.struct("id", "v", *[f"c{i}" for i in range(1, dims + 1)])).alias("marks"))
    near = F.slice(F.sort_array(F.transform("marks", lambda o: F.struct(
        (F.round((F.lit(1.0) - _dot(F.col("v"), o["v"])) / GRAIN) * GRAIN).alias("d"), o["id"].alias("id"),
        *[o[f"c{i}"].alias(f"c{i}") for i in range(1, dims + 1)]))), 1, k)
    met = with_one_row(points.select("id", "v").distinct(), held).select("id", "v", near.alias("near"))

    def weight(o: Column) -> Column:
        return F.lit(1.0) / F.greatest(o["d"], F.lit(1e-12))

    def weighted(name: str) -> Column:
        return F.aggregate("near", F.lit(0.0), lambda t, o: t + weight(o) * o[name])

    total = F.aggregate("near", F.lit(0.0), lambda t, o: t + weight(o))
    return met.select("id", "v", *[(weighted(f"c{i}") / total).alias(f"c{i}") for i in range(1, dims + 1)])
