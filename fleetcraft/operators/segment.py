"""Driver segmentation: embed, k-means, elbow, silhouette, labels, hierarchy,
stored models and feature importance (C1-C12, D10).

Everything heavy is a Spark ML estimator or a DataFrame aggregate over the
one-row-per-driver table. What reaches the driver process is bounded by k and
the feature count: scaler ranges, the PCA matrix, centroids and
per-cluster sums.

* C1: the reference's non-linear reducer is re-aimed as a deterministic
  linear one: L2 ``Normalizer`` (cosine geometry) + ``PCA(k=2)``, fitted once
  and re-applied to new loads (no refit, B9).
* C3: all restarts and all k are fitted together, one pass a round
  (``kmeans``), and the lowest cost wins.
* C6: silhouette in the squared-Euclidean form of ``ClusteringEvaluator``,
  computed per row from per-cluster (n, sum x, sum |x|^2), and in the Euclidean
  form over a quadtree (``silhouette``): both linear in rows, no pairs.
* C7: cluster ids are arbitrary, so clusters are ordered by their centroid
  before letters are given; the same data gives the same letters.
"""

from __future__ import annotations

import itertools
import json
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, Normalizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcraft.functions.joins import with_one_row
from fleetcraft.operators import kmeans, prepare
from fleetcraft.operators import silhouette as euclidean
from fleetcraft.sources.tables import materialise

# Fixed values of the reference: kept features, restarts, seed, and the
# priority order of the subsegments (a comment in the reference).
SEGMENT_FEATURES = ("prop_completed_routes", "days_connected", "avg_daily_critical_hours_executed",
                    "avg_special_hours_executed", "qty_recharge", "avg_recharge")
DROPPED_FEATURES = ("prop_critical_delay", "speed", "avg_total_hours_executed", "consumer_evaluation", "strikes",
                    "share_days_non_negative", "avg_daily_utr", "driver_delay_origin", "orders", "antiquity", "sla")
OUTLIER_FEATURES = ("avg_recharge", "qty_recharge", "avg_daily_critical_hours_executed", "avg_special_hours_executed")
RESTARTS = 20
SEED = 42
MAX_ITER = 300
PRIORITY = (("AA", 1), ("BC", 2), ("BA", 3), ("BD", 4), ("BB", 5), ("AB", 6))

DIMS = ("c1", "c2")


def _vec(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="skip").transform(df)


# ---------------------------------------------------------------------------
# embedding
# ---------------------------------------------------------------------------

def fit_embedding(scaled: DataFrame, features: Sequence[str] = SEGMENT_FEATURES, dims: int = 2) -> list[list[float]]:
    """Fit L2 normalisation + PCA on the scaled features; returns the loadings, a row per component.

    A component's sign is arbitrary: its largest loading is made positive, so
    repeated fits agree.
    """
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="__raw", handleInvalid="skip"),
        Normalizer(inputCol="__raw", outputCol="__unit", p=2.0),
        PCA(k=dims, inputCol="__unit", outputCol="__pca"),
    ])
    loadings = pipe.fit(scaled).stages[-1].pc.toArray().T.tolist()
    return [[-v for v in row] if max(row, key=abs) < 0 else row for row in loadings]


def embed(loadings: Sequence[Sequence[float]], scaled: DataFrame, keep: Sequence[str],
          features: Sequence[str] = SEGMENT_FEATURES) -> DataFrame:
    """Apply a fitted embedding; output columns ``keep`` + ``c1, c2``.

    Rows with a NULL feature are dropped (the reference drops NaN rows before
    reducing); a row of zeros stays at the origin. The loadings are literals,
    so this is a projection inside whole-stage codegen."""
    x = [F.col(f).cast("double") for f in features]
    norm = F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0]))

    def component(row: Sequence[float]) -> Column:
        dot = sum((v * F.lit(float(w)) for v, w in zip(x[1:], row[1:])), x[0] * F.lit(float(row[0])))
        return F.when(norm == 0, F.lit(0.0)).otherwise(F.try_divide(dot, norm))

    return (scaled.na.drop(subset=list(features))
            .select(*keep, *[component(row).alias(c) for row, c in zip(loadings, DIMS)]))


# ---------------------------------------------------------------------------
# K-means, assignment, inertia, elbow
# ---------------------------------------------------------------------------

#: Rows that are worth a task of their own, and rows of a file of stored points at most on average.
ROWS_A_TASK, ROWS_A_FILE = 4096, 1_000_000


def spread(points: DataFrame, name: str) -> DataFrame:
    """Points stored in as many files as there are cores, if there are rows for it, each read by its own task.

    A point is a few bytes that meet hundreds of centres or thousands of cells,
    so tasks sized by bytes would be far too few. Rows go by their values and
    are sorted, so the files do not depend on how they came. ``points`` is read
    twice: give a stored table.
    """
    rows, cores = points.count(), points.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-rows // ROWS_A_TASK)), -(-rows // ROWS_A_FILE))
    return materialise(points.repartition(parts, *points.columns).sortWithinPartitions(*points.columns), name)


@dataclass
class Clusterer:
    """A fitted k-means: its centres in canonical order (C7), its cost and the seed that gave it."""

    centers: list[tuple[float, ...]]
    cost: float
    seed: int

    @property
    def k(self) -> int:
        return len(self.centers)


def _canonical(centers: Sequence[Sequence[float]]) -> list[tuple[float, ...]]:
    return sorted((tuple(float(v) for v in c) for c in centers), key=lambda c: tuple(round(v, 6) for v in c))


def fit_kmeans_many(points: DataFrame, ks: Sequence[int], dims: Sequence[str] = DIMS,
                    restarts: int = RESTARTS, seed: int = SEED, max_iter: int = MAX_ITER,
                    key: str = "driver_uuid") -> dict[int, Clusterer]:
    """C3 for several k at once: all (k, seed) runs share their passes over the points (``kmeans.fit_many``),
    which are stored first and dealt to all cores; per k the lowest cost wins (of equals the lowest seed)."""
    stored = spread(materialise(points.select(key, *dims), "kmeans-points"), "kmeans-spread")
    runs = kmeans.fit_many(stored, list(ks), range(seed, seed + restarts), key, dims, max_iter)
    best = {k: min((r for r in runs if r.k == k), key=lambda r: (round(r.cost, 9), r.seed)) for k in ks}
    return {k: Clusterer(_canonical(r.centers), r.cost, r.seed) for k, r in best.items()}


def fit_kmeans(points: DataFrame, k: int, dims: Sequence[str] = DIMS, restarts: int = RESTARTS,
               seed: int = SEED, max_iter: int = MAX_ITER, key: str = "driver_uuid") -> Clusterer:
    """Best of ``restarts`` seeded runs by cost."""
    return fit_kmeans_many(points, [k], dims, restarts, seed, max_iter, key)[k]


def inertia_k1(points: DataFrame, dims: Sequence[str] = DIMS) -> float:
    """Sum of squared distances to the mean = sum over dims of n * var_pop."""
    row = points.agg(*[(F.count(d) * F.var_pop(d)).alias(d) for d in dims]).first()
    return float(sum(row[d] or 0.0 for d in dims))


def elbow(points: DataFrame, ks: Sequence[int] = range(1, 10), dims: Sequence[str] = DIMS,
          restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """Inertia of the best fit for each k (non-increasing in k up to fit noise)."""
    fits = fit_kmeans_many(points, list(ks), dims, restarts, seed)
    rows = [(int(k), fits[k].cost) for k in ks]
    return points.sparkSession.createDataFrame(rows, "k int, inertia double")


def _sqdist(center: Sequence[float], dims: Sequence[str]) -> Column:
    return sum(((F.col(d) - F.lit(float(c))) ** 2 for d, c in zip(dims, center)), F.lit(0.0))


def assign(points: DataFrame, centers: Sequence[Sequence[float]], dims: Sequence[str] = DIMS,
           out: str = "cluster") -> DataFrame:
    """C4: nearest centre (ties -> lowest index) as a column expression.

    Centres are literals (k x d numbers), so this is a projection inside
    whole-stage codegen: no join, no shuffle.
    """
    dists = [_sqdist(c, dims) for c in centers]
    best = F.least(*dists) if len(dists) > 1 else dists[0]
    pick = F.lit(None).cast("int")
    for i in reversed(range(len(dists))):
        pick = F.when(dists[i] == best, F.lit(i)).otherwise(pick)
    return points.withColumn(out, pick).withColumn(f"{out}_sqdist", best)


def inertia(assigned: DataFrame, out: str = "cluster") -> DataFrame:
    """Within-cluster sum of squares, total and per cluster (rollup row has NULL cluster)."""
    return (assigned.rollup(out)
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(f"{out}_sqdist").alias("inertia")))


def silhouette_squared(assigned: DataFrame, dims: Sequence[str] = DIMS, out: str = "cluster") -> DataFrame:
    """Per-row silhouette with squared Euclidean distance (``ClusteringEvaluator``'s measure).

    Mean squared distance from x to the n points of cluster C is
    ``|x|^2 - 2 x.S1/n + S2/n`` with S1 = sum of points, S2 = sum of |y|^2.
    Own cluster excludes x itself (factor n/(n-1)); a singleton scores 0.
    """
    norm2 = sum((F.col(d) ** 2 for d in dims), F.lit(0.0))
    sums = assigned.groupBy(out).agg(F.count(F.lit(1)).cast("double").alias("n"),
                                     *[F.sum(d).alias(f"s_{d}") for d in dims], F.sum(norm2).alias("s2"))
    # one row that holds a struct per cluster, however many there are
    held = sums.agg(F.collect_list(F.struct(F.col(out).alias("id"), "n", "s2", *[f"s_{d}" for d in dims])).alias("__all"))

    def mean_d(c: Column) -> Column:
        dot = sum((F.col(d) * c[f"s_{d}"] for d in dims), F.lit(0.0))
        return norm2 - 2 * dot / c["n"] + c["s2"] / c["n"]

    own = F.filter("__all", lambda c: c["id"] == F.col(out))[0]
    b = F.array_min(F.transform(F.filter("__all", lambda c: c["id"] != F.col(out)), mean_d))
    a = mean_d(own) * own["n"] / F.greatest(own["n"] - 1, F.lit(1.0))
    s = (F.when((F.size("__all") < 2) | (own["n"] <= 1), F.lit(0.0))
         .when(a < b, F.lit(1.0) - F.try_divide(a, b))
         .when(a > b, F.try_divide(b, a) - F.lit(1.0))
         .otherwise(F.lit(0.0)))
    return with_one_row(assigned, held).withColumn("silhouette", s).drop("__all")


def silhouette_summary(scored: DataFrame, out: str = "cluster") -> DataFrame:
    """Mean silhouette overall (NULL cluster) and per cluster."""
    return scored.rollup(out).agg(F.count(F.lit(1)).alias("rows"), F.avg("silhouette").alias("silhouette"))


# ---------------------------------------------------------------------------
# Labels, hierarchy, stored model
# ---------------------------------------------------------------------------

def letters(k: int, prefix: str = "") -> list[str]:
    """A to Z, then AA, AB and so on."""
    names, size = [], 1
    while len(names) < k:
        names += ["".join(t) for t in itertools.islice(itertools.product(string.ascii_uppercase, repeat=size),
                                                       k - len(names))]
        size += 1
    return [prefix + n for n in names]


def label_rows(points: DataFrame, clusterer: Clusterer, prefix: str = "", column: str = "segmentation",
               dims: Sequence[str] = DIMS) -> DataFrame:
    """C4 + C7: assign to the canonical centres and map index -> letter."""
    names = letters(clusterer.k, prefix)
    lab = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__cl") + 1)
    return assign(points, clusterer.centers, dims, "__cl").withColumn(column, lab).drop("__cl", "__cl_sqdist")


@dataclass
class SegmentModel:
    """Everything needed to score a new load without refitting."""

    scaler: DataFrame            # per-region registry (min/max or mean/std)
    embedding: list[list[float]]   # loadings
    clusterer: Clusterer
    prefix: str = ""
    kind: str = "minmax"


def fit_segments(prepared: DataFrame, k: int, registry: DataFrame | None = None, prefix: str = "",
                 restarts: int = RESTARTS, features: Sequence[str] = SEGMENT_FEATURES,
                 key: str = "driver_uuid", scaler: str = "minmax") -> tuple[SegmentModel, DataFrame]:
    """Scale by region, embed, cluster, label.

    ``scaler="minmax"`` (final version): the registry is extended with new
    regions only (D13) and reused. ``scaler="standard"`` (exploratory
    version): standard parameters are fitted afresh on these rows.
    """
    reg = prepare.update_registry(registry if scaler == "minmax" else None, prepared, features, kind=scaler)
    reg = materialise(reg, "scaler-registry")
    transform = prepare.transform_minmax if scaler == "minmax" else prepare.transform_standard
    scaled = transform(prepared, reg, features).na.drop(subset=list(features))
    rows = scaled.count()
    if rows < max(2, k):
        raise ValueError(f"{rows} complete rows cannot make {k} segments {prefix!r}: choose a smaller k or more rows")
    emb = fit_embedding(scaled, features)
    points = materialise(embed(emb, scaled, [key, "logistic_region"], features), "embedded")
    clusterer = fit_kmeans(points, k, restarts=restarts, key=key)
    model = SegmentModel(reg, emb, clusterer, prefix, scaler)
    return model, label_rows(points, clusterer, prefix)


def score(model: SegmentModel, prepared: DataFrame, features: Sequence[str] = SEGMENT_FEATURES,
          key: str = "driver_uuid", column: str = "segmentation", registry: DataFrame | None = None) -> DataFrame:
    """Apply stored scaler, projection and centres to a fresh load.

    Regions that the fit did not know get their parameters from the load itself
    (D13), so every complete row is scored. A part of a load is scored with the
    ``registry`` extended by the whole load.
    """
    transform = prepare.transform_minmax if model.kind == "minmax" else prepare.transform_standard
    if registry is None:
        registry = prepare.update_registry(model.scaler, prepared, features, kind=model.kind)
    scaled = transform(prepared, registry, features).na.drop(subset=list(features))
    points = embed(model.embedding, scaled, [key, "logistic_region"], features)
    return label_rows(points, model.clusterer, model.prefix, column)


def save_model(model: SegmentModel, path: str) -> None:
    """Store registry, projection and centres so that another session can score."""
    model.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    c = model.clusterer
    row = (json.dumps(model.embedding), json.dumps(c.centers), float(c.cost), int(c.seed), model.prefix, model.kind)
    model.scaler.sparkSession.createDataFrame(
        [row], "loadings string, centers string, cost double, seed int, prefix string, kind string"
    ).write.mode("overwrite").parquet(f"{path}/clusters")


def load_model(spark, path: str) -> SegmentModel:
    row = spark.read.parquet(f"{path}/clusters").first()
    centers = [tuple(c) for c in json.loads(row["centers"])]
    return SegmentModel(spark.read.parquet(f"{path}/scaler"), json.loads(row["loadings"]),
                        Clusterer(centers, row["cost"], row["seed"]), row["prefix"], row["kind"])


def fit_two_levels(data: DataFrame, top_k: int = 2, sub_k: Sequence[tuple[str, int]] = (("A", 2), ("B", 4)),
                   sub_scaler: str = "minmax", restarts: int = RESTARTS) -> tuple[DataFrame, dict[str, SegmentModel]]:
    """Segments of all complete rows, and subsegments of the parents in ``sub_k``.

    The subsegments reuse the top level's scaler registry, fit projection and
    k-means on their own rows; ``sub_scaler="standard"`` scales each subset
    afresh. A parent that ``sub_k`` does not name keeps its drivers, with no
    subsegment. ``data`` is read many times: give a stored table.
    """
    model, top = fit_segments(data, k=top_k, restarts=restarts)
    labelled = materialise(data.join(top.select("driver_uuid", "segmentation"), "driver_uuid"), "labelled")
    models, subs = {"": model}, None
    for parent, k in sub_k:
        subset = labelled.where(F.col("segmentation") == parent).drop("segmentation")
        models[parent], sub = fit_segments(subset, k=k, registry=model.scaler, prefix=parent, scaler=sub_scaler,
                                           restarts=restarts)
        sub = sub.select("driver_uuid", F.col("segmentation").alias("subsegmentation"))
        subs = sub if subs is None else subs.unionByName(sub)
    if subs is None:
        return labelled.withColumn("subsegmentation", F.lit(None).cast("string")), models
    return labelled.join(subs, "driver_uuid", "left"), models


def silhouette_by_k(points: DataFrame, ks: Sequence[int] = (2, 3, 4, 5), dims: Sequence[str] = DIMS,
                    restarts: int = RESTARTS, seed: int = SEED, key: str = "driver_uuid") -> DataFrame:
    """C6 sweep: of the best fit for each k the mean silhouette, squared and Euclidean, with the latter's mean error bound."""
    out = []
    points = spread(materialise(points.select(key, *dims), "silhouette-points"), "silhouette-spread")
    fits = fit_kmeans_many(points, list(ks), dims, restarts, seed, key=key)
    for k in ks:
        labelled = materialise(assign(points, fits[k].centers, dims), "assigned")
        mean = silhouette_squared(labelled, dims).agg(F.avg("silhouette")).first()[0]
        near = euclidean.euclidean_silhouette(labelled, [key], dims).agg(F.avg("silhouette"), F.avg("error_bound")).first()
        out.append((int(k), mean, near[0], near[1], fits[k].cost))
    return points.sparkSession.createDataFrame(
        out, "k int, silhouette double, euclidean_silhouette double, error_bound double, inertia double")


def cluster_centers(clusterer: Clusterer, spark, prefix: str = "") -> DataFrame:
    """Centres with their letters, as data."""
    names = letters(clusterer.k, prefix)
    rows = [(names[i], i, *c) for i, c in enumerate(clusterer.centers)]
    return spark.createDataFrame(rows, "label string, cluster int, c1 double, c2 double")


def priority_table(spark) -> DataFrame:
    """C11: priority of each subsegment (1 = first)."""
    return spark.createDataFrame(list(PRIORITY), "subsegmentation string, priority int")


# ---------------------------------------------------------------------------
# Feature importance
# ---------------------------------------------------------------------------

def feature_importance(labelled: DataFrame, features: Sequence[str] = SEGMENT_FEATURES,
                       label: str = "segmentation", seed: int = SEED, trees: int = 100, top: int = 12,
                       key: str = "driver_uuid", parts: int = 32) -> DataFrame:
    """Random-forest importance of each feature for predicting the segment.

    Rows are hash-partitioned by the driver key into ``parts`` (size it for the
    data; the forest depends on it) and sorted within partitions first, so the same seed gives the same forest on the same data while the
    rows stay spread over all tasks (partitioning by the label would put a
    whole segment in one task).
    """
    data = (labelled.select(key, label, *features).na.drop()
            .repartition(parts, key).sortWithinPartitions(key))
    idx = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(data)
    vec = _vec(idx.transform(data), features)
    rf = RandomForestClassifier(labelCol="__label", featuresCol="features", numTrees=trees, seed=seed).fit(vec)
    imp = rf.featureImportances.toArray().tolist()
    scores = labelled.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                                                   "feature string, importance double")
    return scores.orderBy(F.desc("importance"), "feature").limit(top)   # O2: top-n
