"""Segmentation invariants: silhouette, inertia, elbow, label stability."""

import random

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fleetcraft.operators import segment


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = random.Random(7)
    rows = []
    for i, (cx, cy) in enumerate([(0.0, 0.0), (3.0, 3.0), (0.0, 4.0)]):
        rows += [(f"d{i}-{j}", cx + rnd.gauss(0, 0.5), cy + rnd.gauss(0, 0.5)) for j in range(40)]
    return spark.createDataFrame(rows, "driver_uuid string, c1 double, c2 double")


def test_silhouette_matches_clustering_evaluator(spark, blobs):
    fit = segment.fit_kmeans(blobs, 3, restarts=3)
    scored = segment.silhouette_squared(segment.assign(blobs, fit.centers))
    ours = scored.agg(F.avg("silhouette")).first()[0]
    vec = VectorAssembler(inputCols=["c1", "c2"], outputCol="features").transform(scored)
    spark_sil = ClusteringEvaluator(predictionCol="cluster", featuresCol="features",
                                    distanceMeasure="squaredEuclidean").evaluate(vec.withColumn(
                                        "cluster", F.col("cluster").cast("double")))
    assert ours == pytest.approx(spark_sil, abs=1e-9)
    lo, hi = scored.agg(F.min("silhouette"), F.max("silhouette")).first()
    assert -1.0 <= lo <= hi <= 1.0


def test_inertia_matches_training_cost(spark, blobs):
    fit = segment.fit_kmeans(blobs, 3, restarts=3)
    total = segment.inertia(segment.assign(blobs, fit.centers)).where(F.col("cluster").isNull()).first().inertia
    assert total == pytest.approx(fit.cost, rel=1e-6)


def test_elbow_non_increasing_and_k1(spark, blobs):
    e = [r.inertia for r in segment.elbow(blobs, range(1, 5), restarts=3).orderBy("k").collect()]
    assert all(a >= b - 1e-6 for a, b in zip(e, e[1:]))
    assert e[0] == pytest.approx(segment.inertia_k1(blobs))


def test_labels_stable_under_repartition(spark, blobs):
    a = segment.label_rows(blobs, segment.fit_kmeans(blobs, 3, restarts=3))
    b_in = blobs.repartition(7, "driver_uuid")
    b = segment.label_rows(b_in, segment.fit_kmeans(b_in, 3, restarts=3))
    ja = {r.driver_uuid: r.segmentation for r in a.collect()}
    jb = {r.driver_uuid: r.segmentation for r in b.collect()}
    assert ja == jb


def test_assign_picks_nearest(spark):
    pts = spark.createDataFrame([("p", 0.9, 0.9), ("q", 0.1, 0.0)], "driver_uuid string, c1 double, c2 double")
    got = {r.driver_uuid: r.cluster for r in segment.assign(pts, [(0.0, 0.0), (1.0, 1.0)]).collect()}
    assert got == {"p": 1, "q": 0}


def test_the_feature_table_is_built_once_a_query(spark, monkeypatch):
    from fleetcraft.operators import segment, trees
    from fleetcraft.plans import queries_segment as q
    built, build = [], q.features_table
    monkeypatch.setattr(q, "features_table", lambda spark, sf: built.append(sf) or build(spark, sf))
    monkeypatch.setattr(segment, "RESTARTS", 2)
    monkeypatch.setattr(segment, "feature_importance", lambda labelled: labelled)
    monkeypatch.setattr(trees, "fit_extra_trees", lambda labelled, *_: labelled)
    monkeypatch.setattr(trees, "importance", lambda spark, labelled, *_: labelled)
    for query in (q.score_job_stored, q.priority_stored, q.feature_importance, q.extra_trees_importance):
        built.clear()
        query(spark, "/root/testdata/sf0.01")
        assert len(built) == 1, query.__name__
