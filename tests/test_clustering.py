"""Batched k-means, Euclidean silhouette, neighbour graph and layout against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcraft.operators import kmeans, neighbours, segment
from fleetcraft.operators import silhouette as sil
from fleetcraft.sources.tables import materialise

FEATURES = ["f0", "f1", "f2", "f3"]


def blobs(seed, n=240):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [4, 1], [1, 5], [6, 6]])
    return np.round(centers[rng.integers(0, 4, n)] + rng.normal(size=(n, 2)), 6)


def plane(spark, x, parts=3):
    return materialise(spark.createDataFrame([(f"d{i}", float(a), float(b)) for i, (a, b) in enumerate(x)],
                                             "driver_uuid string, c1 double, c2 double").repartition(parts), "plane")


def test_fits_match_plain_lloyd_from_the_same_starts(spark):
    x = blobs(1)
    runs = kmeans.fit_many(plane(spark, x), [1, 3, 4], [5, 6], "driver_uuid", ["c1", "c2"])
    assert [(r.k, r.seed) for r in runs] == [(k, s) for k in (1, 3, 4) for s in (5, 6)]
    for r in runs:
        d = ((x[:, None] - r.centers[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert r.cost == pytest.approx(d.min(axis=1).sum()) and not r.moving
        for k in range(r.k):
            assert np.abs(x[near == k].mean(axis=0) - r.centers[k]).max() <= 1e-4
    assert min(r.cost for r in runs if r.k == 4) <= min(r.cost for r in runs if r.k == 3)


def test_starts_do_not_depend_on_partitioning_and_favour_far_points(spark):
    x = np.vstack([np.zeros((300, 2)), [[100.0, 0.0]], [[0.0, 90.0]]])
    found = []
    for parts in (1, 6):
        runs = kmeans.fit_many(plane(spark, x, parts), [3], range(4), "driver_uuid", ["c1", "c2"], max_iter=0)
        found.append([sorted(map(tuple, r.centers.tolist())) for r in runs])
    assert found[0] == found[1]
    assert all(c == [(0.0, 0.0), (0.0, 90.0), (100.0, 0.0)] for c in found[0])


def test_fewer_points_than_centres_and_none(spark):
    few = kmeans.fit_many(plane(spark, [[1, 1], [1, 1], [2, 2]]), [4], [1], "driver_uuid", ["c1", "c2"])[0]
    assert sorted(map(tuple, few.centers.tolist())) == [(1.0, 1.0), (2.0, 2.0)] and few.cost == 0
    none = plane(spark, [[1, 1]]).where("c1 > 5")
    assert kmeans.fit_many(none, [2], [1], "driver_uuid", ["c1", "c2"])[0].cost == 0


def plain_silhouette(x, own):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = np.zeros(len(x))
    for i in range(len(x)):
        mine = own == own[i]
        if mine.sum() == 1 or len(set(own.tolist())) == 1:
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, own == c].mean() for c in set(own.tolist()) - {own[i]})
        out[i] = 0 if max(a, b) == 0 else (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("cells", [4096, 64, 1])
def test_silhouette_is_within_its_bound_of_brute_force(spark, cells):
    x = blobs(2)
    x = np.vstack([x, np.repeat(x[:5], 40, axis=0), [[50.0, 50.0]]])
    own = (x[:, 0] > 3).astype(int) + 2 * (x[:, 1] > 3)
    own[-1] = 9
    rows = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, own))]
    df = materialise(spark.createDataFrame(rows, "i int, c1 double, c2 double, cluster int").repartition(3), "points")
    got = {r["i"]: r for r in sil.euclidean_silhouette(df, ["i"], cells=cells).collect()}
    want = plain_silhouette(x, own)
    assert len(got) == len(rows) and all(0 <= r["error_bound"] <= 2 for r in got.values())
    assert all(abs(got[i]["silhouette"] - want[i]) <= got[i]["error_bound"] + 1e-9 for i in got)
    if cells == 4096:
        assert max(r["error_bound"] for r in got.values()) < 1e-9


def test_silhouette_of_one_cluster_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 1.0, 1.0, 1), (3, None, 1.0, 1), (4, 1.0, 1.0, None)],
                               "i int, c1 double, c2 double, cluster int")
    assert [(r["i"], r["silhouette"]) for r in sil.euclidean_silhouette(df, ["i"]).orderBy("i").collect()] == [(1, 0.0), (2, 0.0)]
    assert sil.euclidean_silhouette(df.where("i > 9"), ["i"]).count() == 0


def cloud(seed, n):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(n, 4))) * rng.uniform(0.2, 1.5, size=4) + np.eye(4)[rng.integers(0, 4, n)]
    return np.vstack([x, np.repeat(x[:1], n // 4, axis=0) * 3])   # a hot direction


def vectors(spark, x, parts=3):
    return spark.createDataFrame([(f"d{i:05d}", *map(float, r)) for i, r in enumerate(x)],
                                 "key string, " + ", ".join(f"{f} double" for f in FEATURES)).repartition(parts)


@pytest.fixture(scope="module")
def graph(spark):
    x = cloud(3, 800)
    return x, neighbours.neighbour_graph(neighbours.directions(vectors(spark, x), "key", FEATURES))


def test_graph_finds_the_nearest(spark, graph):
    x, found = graph
    rows = found.collect()
    assert len(rows) == 800   # the copies of a direction are one point
    ids = {r["id"]: k for k, r in enumerate(rows)}
    v = np.array([r["v"] for r in rows])
    d = 1 - v @ v.T
    np.fill_diagonal(d, np.inf)
    hits = 0
    for k, r in enumerate(rows):
        assert [o["d"] for o in r["near"]] == sorted(o["d"] for o in r["near"]) and len(r["near"]) == 9
        assert all(abs(d[k, ids[o["id"]]] - o["d"]) < 1e-9 for o in r["near"])
        hits += len({o["id"] for o in r["near"]} & {rows[j]["id"] for j in np.argsort(d[k])[:9]})
    assert hits / (9 * len(rows)) >= 0.9
    measured = neighbours.recall(found, 10).first()
    assert measured["queries"] > 40 and measured["recall"] >= 0.9


def test_small_and_empty_graphs(spark):
    few = neighbours.neighbour_graph(neighbours.directions(vectors(spark, cloud(4, 3)), "key", FEATURES))
    assert sorted(len(r["near"]) for r in few.collect()) == [2, 2, 2]
    none = neighbours.directions(vectors(spark, [[0, 0, 0, 0]]), "key", FEATURES)
    assert neighbours.neighbour_graph(none).count() == 0


def test_layout_keeps_neighbours_and_is_the_same_however_dealt(spark, graph):
    x, found = graph
    a = {r["id"]: (r["c1"], r["c2"]) for r in neighbours.layout(found, passes=10).collect()}
    b = {r["id"]: (r["c1"], r["c2"]) for r in neighbours.layout(found.repartition(7), passes=10).collect()}
    scale = max(abs(c) for p in a.values() for c in p)
    assert a.keys() == b.keys() and max(abs(p - q) for i in a for p, q in zip(a[i], b[i])) < 1e-6 * scale
    rows = found.collect()
    place = np.array([a[r["id"]] for r in rows])
    d = np.sqrt(((place[:, None] - place[None]) ** 2).sum(axis=2))
    ids = {r["id"]: k for k, r in enumerate(rows)}
    near = np.mean([d[k, ids[o["id"]]] for k, r in enumerate(rows) for o in r["near"]])
    assert near < 0.5 * d.mean()


def test_new_rows_land_by_their_landmarks(spark, graph):
    x, found = graph
    placed = neighbours.layout(found, passes=4)
    marks = materialise(neighbours.landmarks(placed, 2000), "landmarks")
    again = {r["id"]: (r["c1"], r["c2"]) for r in neighbours.place(placed.select("id", "v"), marks).collect()}
    old = {r["id"]: (r["c1"], r["c2"]) for r in marks.collect()}
    spread = max(abs(c) for p in old.values() for c in p)
    assert max(abs(p - q) for i in old for p, q in zip(old[i], again[i])) < 1e-2 * spread
    assert neighbours.landmarks(placed, 50).count() == 50
    assert neighbours.place(placed.select("id", F.col("v")).limit(0), marks).count() == 0


def test_nearest_of_a_long_list_with_repeats_is_not_searched_pair_by_pair(spark):
    import time
    n = 30_000
    one = spark.range(n).select(F.format_string("d%06d", "id").alias("id"), F.array(F.cos(F.col("id") / n), F.sin(F.col("id") / n)).alias("v"))
    heard = materialise(one.agg(F.collect_list(F.struct("id", "v")).alias("all")), "heard")
    told = F.concat("all", F.slice("all", 1, 50))
    began = time.perf_counter()
    near = heard.select(neighbours._nearest(F.lit("d000000"), F.array(F.lit(1.0), F.lit(0.0)), told, 9).alias("near")).first()["near"]
    assert [r["id"] for r in near] == [f"d{i:06d}" for i in range(1, 10)]
    # 4.5e8 pairs of structs would take minutes
    assert time.perf_counter() - began < 20


def test_distances_hold_one_plane_at_a_time():
    import tracemalloc
    rng = np.random.default_rng(8)
    x, centers = rng.normal(size=(2048, 2)), rng.normal(size=(40, 2))
    tracemalloc.start()
    got = kmeans._distances(x, centers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)).all()
    assert peak <= 2.5 * got.nbytes


def test_points_of_a_fit_and_of_a_silhouette_are_dealt_to_all_cores(spark, monkeypatch):
    x = np.random.default_rng(9).random((4 * segment.ROWS_A_TASK, 2))
    one = materialise(plane(spark, x, parts=1), "one-file")
    assert one.rdd.getNumPartitions() == 1
    cores, fit, near, seen = spark.sparkContext.defaultParallelism, kmeans.fit_many, sil.euclidean_silhouette, []

    def watched(f):
        def call(points, *a, **k):
            seen.append((points.rdd.getNumPartitions(), points.count()))
            return f(points, *a, **k)
        return call

    monkeypatch.setattr(kmeans, "fit_many", watched(fit))
    monkeypatch.setattr(sil, "euclidean_silhouette", watched(near))
    assert segment.silhouette_by_k(one, (2,), restarts=1).first()["k"] == 2
    assert len(seen) == 2 and all(parts >= min(3, cores) and rows == len(x) for parts, rows in seen)


def test_cells_are_measured_in_few_planes():
    import tracemalloc
    rng = np.random.default_rng(10)
    x, at = rng.random((256, 2)), rng.random((4096, 2))
    tree = np.column_stack([rng.integers(0, 5, 4096), rng.integers(1, 9, 4096), at, rng.integers(0, 2, 4096) * 1e-4, at - 0.01, at + 0.01])
    clusters = np.unique(tree[:, 0])
    tracemalloc.start()
    total, error = sil.mean_distances(x, tree, clusters)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = np.sqrt(((x[:, None] - at[None]) ** 2).sum(axis=2))
    out = np.maximum(0, np.maximum(tree[:, 5:7] - x[:, None], x[:, None] - tree[:, 7:9]))
    gap = np.sqrt((out ** 2).sum(axis=2))
    v = tree[:, 4]
    off = np.where(v > 0, np.minimum(np.sqrt(v), v / np.where(gap > 0, 2 * gap, 1e-300)), 0)
    for k, c in enumerate(clusters):
        mine = tree[:, 0] == c
        assert np.allclose(total[:, k], (d * tree[:, 1])[:, mine].sum(axis=1), rtol=1e-12)
        assert np.allclose(error[:, k], (off * tree[:, 1])[:, mine].sum(axis=1), rtol=1e-12)
    # a plane is a number per point and cell
    assert peak <= 4 * d.nbytes


def test_nearest_is_that_of_plain_numpy_and_of_equals_the_first():
    rng = np.random.default_rng(11)
    x, centers = rng.normal(size=(2, kmeans.ROWS)).T, rng.normal(size=(3, 2))
    d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    near, least = kmeans._nearest(kmeans._distances(x, centers))
    assert (near == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    # a centre's distances lie together, so work on them is work on whole rows
    assert kmeans._distances(x, centers)[:, 1].flags.c_contiguous
    tied = kmeans._nearest(kmeans._distances(np.array([[1.0, 0.0]]), np.array([[0.0, 0.0], [2.0, 0.0]])))
    assert tied[0].tolist() == [0] and tied[1].tolist() == [1.0]
