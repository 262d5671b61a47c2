"""Profile, preparation and segmentation queries
over the feature table, plus the write/read round trips (S3-S7)."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcraft.functions.joins import with_one_row
from fleetcraft.operators import activity, kmeans, neighbours, prepare, profile, quality, segment, trees
from fleetcraft.operators.silhouette import euclidean_silhouette
from fleetcraft.plans.settings import CODES, EVENTS_15, REGIONS, RUN_DATE, fixtures, register
from fleetcraft.plans.queries_mart import FEATURE_CTES, FEATURE_ROW_SQL, FEATURE_VIEWS, feature_row as feature_mart_row, features_table
from fleetcraft.plans.oracle_views import with_views
from fleetcraft.sources import publish, tables, workbooks

FEATS = segment.SEGMENT_FEATURES
OUTL = segment.OUTLIER_FEATURES
PROFILE_COLUMNS = FEATS + ("orders", "antiquity")
REGION_LABELS = tuple(r.capitalize() for r in REGIONS)
FIXED_CENTERS = ((0.25, 0.25), (0.75, 0.75), (0.25, 0.75))
DROP_COLUMN, DROP_THRESHOLD = "avg_daily_critical_hours_executed", 0.5
FIRST_REGIONS = REGION_LABELS[:5]


# ---------------------------------------------------------------------------
# Spark side: the segmentation input as P2 prepares it
# ---------------------------------------------------------------------------

def seg_input(spark, sf):
    """Drop unused columns, replace outliers (D5, ``>=`` 3 std), one row per driver."""
    data = features_table(spark, sf)
    data = data.select(*[c for c in data.columns if c not in segment.DROPPED_FEATURES])
    data = prepare.replace_outliers(data, OUTL, mode="std3")
    return prepare.dedup_first(data, "driver_uuid", ["date_partition", "logistic_region"])


def seg_input_stored(spark, sf):
    """The prepared input written once to the shared checkpoint folder.

    Model fitting makes many passes (PCA, every k-means restart, forests);
    reading a small written table instead of re-running the feature mart each
    time cuts the lineage, and a lost executor re-reads files, not the plan.
    """
    return tables.materialise(seg_input(spark, sf), "segment-input")


def scaled_input(spark, sf):
    return prepare.scale_minmax(seg_input(spark, sf), FEATS)


def fixed_points(spark, sf):
    """2-D points with a closed form (scaled completion share, scaled mean recharge)."""
    return scaled_input(spark, sf).select("driver_uuid", F.col("prop_completed_routes").alias("c1"),
                                          F.col("avg_recharge").alias("c2"))


# ---------------------------------------------------------------------------
# SQL side
# ---------------------------------------------------------------------------

def _feat_sql(body: str, extra=()) -> str:
    return with_views(FEATURE_VIEWS, body, extra=FEATURE_CTES + [("features", FEATURE_ROW_SQL)] + list(extra))


_KEPT = ", ".join(("driver_uuid", "logistic_region", "date_partition") + FEATS)
SEG_CTES = [
    ("kept", f"SELECT {_KEPT} FROM features"),
    ("ostats", "SELECT " + ", ".join(f"avg({c}::DECIMAL(38, 10)) AS m_{c}, stddev_samp({c}::DOUBLE) AS s_{c}" for c in OUTL)
     + " FROM kept"),
    ("outl", "SELECT driver_uuid, logistic_region, date_partition, " + ", ".join(
        f"CASE WHEN {c} >= 3 * s_{c} THEN m_{c} ELSE {c}::DOUBLE END AS {c}" if c in OUTL else f"{c}"
        for c in FEATS) + " FROM kept CROSS JOIN ostats"),
    ("seg", """SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY driver_uuid ORDER BY date_partition, logistic_region) AS rn
        FROM outl) WHERE rn = 1"""),
    ("mm", "SELECT logistic_region, " + ", ".join(
        f"min({c}::DOUBLE) AS lo_{c}, max({c}::DOUBLE) AS hi_{c}" for c in FEATS) + " FROM seg GROUP BY logistic_region"),
    ("scaled", "SELECT s.driver_uuid, s.logistic_region, s.date_partition, " + ", ".join(
        f"CASE WHEN hi_{c} = lo_{c} THEN {c} - lo_{c} ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}"
        for c in FEATS) + " FROM seg s JOIN mm USING (logistic_region)"),
    ("pts", "SELECT driver_uuid, prop_completed_routes AS c1, avg_recharge AS c2 FROM scaled"),
]


def _seg_sql(body: str, extra=()) -> str:
    return _feat_sql(body, SEG_CTES + list(extra))


def _dist(i: int) -> str:
    x, y = FIXED_CENTERS[i]
    return f"((c1 - {x}) * (c1 - {x}) + (c2 - {y}) * (c2 - {y}))"


_ASSIGN_CTE = ("assigned", f"""
    SELECT driver_uuid, c1, c2,
           CASE WHEN {_dist(0)} <= {_dist(1)} AND {_dist(0)} <= {_dist(2)} THEN 0
                WHEN {_dist(1)} <= {_dist(2)} THEN 1 ELSE 2 END AS cluster,
           least({_dist(0)}, {_dist(1)}, {_dist(2)}) AS cluster_sqdist
    FROM pts""")


# ---------------------------------------------------------------------------
# Profile (D1-D4, D8, D9, A15, A16)
# ---------------------------------------------------------------------------

@register("missing_percent", _feat_sql("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL OR isnan({c}::DOUBLE)) * 100.0 / count(*) "
    f"AS percent_missing FROM features" for c in PROFILE_COLUMNS)))
def missing_percent(spark, sf):
    return profile.missing_percent(features_table(spark, sf), PROFILE_COLUMNS)


@register("null_counts", _feat_sql("SELECT " + ", ".join(
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}" for c in PROFILE_COLUMNS + ("driver_uuid", "logistic_region"))
    + " FROM features"))
def null_counts(spark, sf):
    return profile.null_counts(features_table(spark, sf).select(*PROFILE_COLUMNS, "driver_uuid", "logistic_region"))


@register("describe", _feat_sql("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, avg({c}::DECIMAL(38, 10)) AS mean, stddev_samp({c}::DOUBLE) AS std,
               min({c}::DOUBLE) AS min, quantile_cont({c}::DOUBLE, 0.25) AS p25,
               quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75,
               max({c}::DOUBLE) AS max FROM features""" for c in PROFILE_COLUMNS)))
def describe(spark, sf):
    return profile.describe(features_table(spark, sf), PROFILE_COLUMNS)


@register("box_numbers", _feat_sql("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, q[1] AS q1, q[2] AS median, q[3] AS q3, q[3] - q[1] AS iqr,
               min(CASE WHEN x >= q[1] - 1.5 * (q[3] - q[1]) THEN x END) AS whisker_low,
               max(CASE WHEN x <= q[3] + 1.5 * (q[3] - q[1]) THEN x END) AS whisker_high,
               CAST(count_if(x < q[1] - 1.5 * (q[3] - q[1]) OR x > q[3] + 1.5 * (q[3] - q[1])) AS BIGINT) AS outliers
        FROM (SELECT {c}::DOUBLE AS x FROM features)
        CROSS JOIN (SELECT quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM features)
        GROUP BY q""" for c in FEATS)))
def box_numbers(spark, sf):
    return profile.box_numbers(features_table(spark, sf), FEATS)


def _outliers_replaced(spark, sf):
    data = features_table(spark, sf)
    data = data.select(*[c for c in data.columns if c not in segment.DROPPED_FEATURES])
    return prepare.replace_outliers(data, OUTL, mode="std3")


@register("describe_after_outliers", _seg_sql("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, avg({c}::DECIMAL(38, 10)) AS mean, stddev_samp({c}::DOUBLE) AS std,
               min({c}::DOUBLE) AS min, quantile_cont({c}::DOUBLE, 0.25) AS p25,
               quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75,
               max({c}::DOUBLE) AS max FROM outl""" for c in FEATS)))
def describe_after_outliers(spark, sf):
    """D2 after D5, as the exploratory analysis compares both."""
    return profile.describe(_outliers_replaced(spark, sf), FEATS)


@register("box_numbers_after_outliers", _seg_sql("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, q[1] AS q1, q[2] AS median, q[3] AS q3, q[3] - q[1] AS iqr,
               min(CASE WHEN x >= q[1] - 1.5 * (q[3] - q[1]) THEN x END) AS whisker_low,
               max(CASE WHEN x <= q[3] + 1.5 * (q[3] - q[1]) THEN x END) AS whisker_high,
               CAST(count_if(x < q[1] - 1.5 * (q[3] - q[1]) OR x > q[3] + 1.5 * (q[3] - q[1])) AS BIGINT) AS outliers
        FROM (SELECT {c}::DOUBLE AS x FROM outl)
        CROSS JOIN (SELECT quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM outl)
        GROUP BY q""" for c in FEATS)))
def box_numbers_after_outliers(spark, sf):
    """D3 after D5."""
    return profile.box_numbers(_outliers_replaced(spark, sf), FEATS)


@register("skew", _feat_sql("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, skewness({c}::DOUBLE) AS skew FROM features" for c in FEATS)))
def skew(spark, sf):
    return profile.skew(features_table(spark, sf), FEATS)


@register("correlation_lower", _feat_sql("\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, abs(corr({a}::DOUBLE, {b}::DOUBLE)) AS abs_corr FROM features"
    for j, b in enumerate(FEATS) for a in FEATS[j + 1:])))
def correlation_lower(spark, sf):
    return profile.correlation_lower(features_table(spark, sf), FEATS)


@register("segment_sizes", _feat_sql(
    "SELECT logistic_region, count(*) AS count FROM features GROUP BY logistic_region"))
def segment_sizes(spark, sf):
    return profile.value_counts(features_table(spark, sf), "logistic_region")


@register("segment_means_transposed", _feat_sql("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, " + ", ".join(
        f"avg(CASE WHEN logistic_region = '{r}' THEN {c}::DOUBLE END) AS \"{r}\"" for r in REGION_LABELS)
    + " FROM features" for c in FEATS)))
def segment_means_transposed(spark, sf):
    return profile.means_transposed(features_table(spark, sf), "logistic_region", REGION_LABELS, FEATS)


# ---------------------------------------------------------------------------
# Preparation
# ---------------------------------------------------------------------------

@register("outliers_std3", _seg_sql("SELECT * FROM outl"))
def outliers_std3(spark, sf):
    return _outliers_replaced(spark, sf)


@register("drop_above_threshold", _feat_sql(
    f"SELECT * FROM features WHERE NOT ({DROP_COLUMN} >= {DROP_THRESHOLD}) OR {DROP_COLUMN} IS NULL"))
def drop_above_threshold(spark, sf):
    return prepare.drop_above(features_table(spark, sf), DROP_COLUMN, DROP_THRESHOLD)


@register("count_above_threshold", _feat_sql(
    f"SELECT CAST(count_if({DROP_COLUMN} >= {DROP_THRESHOLD}) AS BIGINT) AS rows_above, count(*) AS rows "
    f"FROM features"))
def count_above_threshold(spark, sf):
    return prepare.count_above(features_table(spark, sf), DROP_COLUMN, DROP_THRESHOLD)


@register("dedup_first", with_views(["deliveries"], """
    SELECT driver_uuid, logistic_region FROM (
        SELECT *, row_number() OVER (PARTITION BY driver_uuid ORDER BY logistic_region) AS rn FROM (
            SELECT driver_uuid, logistic_region FROM (
                SELECT *, dense_rank() OVER (PARTITION BY driver_uuid ORDER BY count_orders DESC) AS rk
                FROM region_counts) WHERE rk = 1)) WHERE rn = 1""", extra=FEATURE_CTES[:2]))
def dedup_first(spark, sf):
    from fleetcraft.operators import features as feat
    ties = feat.main_region(feat.delivery_facts(fixtures(spark, sf).deliveries(), EVENTS_15, CODES), ties="all")
    return prepare.dedup_first(ties, "driver_uuid", ["logistic_region"])


@register("scale_minmax_by_region", _seg_sql("SELECT * FROM scaled"))
def scale_minmax_by_region(spark, sf):
    return scaled_input(spark, sf)


@register("scale_minmax_global", _seg_sql(
    "SELECT s.driver_uuid, s.logistic_region, s.date_partition, " + ", ".join(
        f"CASE WHEN g.hi_{c} = g.lo_{c} THEN s.{c} - g.lo_{c} ELSE (s.{c} - g.lo_{c}) / (g.hi_{c} - g.lo_{c}) END AS {c}"
        for c in FEATS) + " FROM seg s CROSS JOIN (SELECT " + ", ".join(
        f"min({c}::DOUBLE) AS lo_{c}, max({c}::DOUBLE) AS hi_{c}" for c in FEATS) + " FROM seg) g"))
def scale_minmax_global(spark, sf):
    return prepare.scale_minmax(seg_input(spark, sf), FEATS, group=None)


@register("scale_standard_by_region", _seg_sql(
    "SELECT s.driver_uuid, s.logistic_region, s.date_partition, " + ", ".join(
        f"CASE WHEN g.sd_{c} = 0 THEN s.{c} - g.mu_{c} ELSE (s.{c} - g.mu_{c}) / g.sd_{c} END AS {c}"
        for c in FEATS) + " FROM seg s JOIN (SELECT logistic_region, " + ", ".join(
        f"avg({c}::DOUBLE) AS mu_{c}, stddev_pop({c}::DOUBLE) AS sd_{c}" for c in FEATS)
    + " FROM seg GROUP BY logistic_region) g USING (logistic_region)"))
def scale_standard_by_region(spark, sf):
    return prepare.scale_standard(seg_input(spark, sf), FEATS)


_REG_COLS = ", ".join(f"min({c}::DOUBLE) AS __min__{c}, max({c}::DOUBLE) AS __max__{c}" for c in FEATS)


@register("scale_registry_new_regions", _seg_sql(
    f"""SELECT logistic_region, {_REG_COLS} FROM seg
        WHERE logistic_region IN ({', '.join(repr(r) for r in FIRST_REGIONS)})
        GROUP BY logistic_region
        UNION ALL
        SELECT logistic_region, {_REG_COLS} FROM seg
        WHERE logistic_region NOT IN ({', '.join(repr(r) for r in FIRST_REGIONS)})
        GROUP BY logistic_region"""))
def scale_registry_new_regions(spark, sf):
    data = seg_input(spark, sf)
    first = prepare.update_registry(None, data.where(F.col("logistic_region").isin(*FIRST_REGIONS)), FEATS)
    return prepare.update_registry(first, data, FEATS)


# ---------------------------------------------------------------------------
# Segmentation with fixed centres (SQL-checkable parts of C4-C6)
# ---------------------------------------------------------------------------

@register("assign_to_centroids", _seg_sql("SELECT * FROM assigned", [_ASSIGN_CTE]))
def assign_to_centroids(spark, sf):
    return segment.assign(fixed_points(spark, sf), FIXED_CENTERS)


@register("inertia", _seg_sql("""
    SELECT cluster, count(*) AS rows, sum(cluster_sqdist) AS inertia FROM assigned GROUP BY ROLLUP (cluster)""",
                              [_ASSIGN_CTE]))
def inertia(spark, sf):
    return segment.inertia(segment.assign(fixed_points(spark, sf), FIXED_CENTERS))


_SIL_CTES = [_ASSIGN_CTE, ("cstats", """
    SELECT cluster AS cid, count(*) AS n, sum(c1) AS s1, sum(c2) AS s2, sum(c1 * c1 + c2 * c2) AS q
    FROM assigned GROUP BY cluster"""), ("pair", """
    SELECT a.driver_uuid, a.cluster, s.cid, s.n,
           (a.c1 * a.c1 + a.c2 * a.c2) - 2 * (a.c1 * s.s1 + a.c2 * s.s2) / s.n + s.q / s.n AS md
    FROM assigned a CROSS JOIN cstats s"""), ("sil", """
    SELECT driver_uuid, cluster,
           max(CASE WHEN cid = cluster THEN n END) AS own_n,
           max(CASE WHEN cid = cluster THEN md * n / greatest(n - 1, 1) END) AS a,
           min(CASE WHEN cid <> cluster THEN md END) AS b
    FROM pair GROUP BY driver_uuid, cluster""")]


@register("silhouette_squared", _seg_sql("""
    SELECT a.driver_uuid, a.c1, a.c2, a.cluster, a.cluster_sqdist,
           CASE WHEN s.own_n <= 1 THEN 0.0 WHEN s.a < s.b THEN 1.0 - s.a / s.b
                WHEN s.a > s.b THEN s.b / s.a - 1.0 ELSE 0.0 END AS silhouette
    FROM assigned a JOIN sil s ON a.driver_uuid = s.driver_uuid""", _SIL_CTES))
def silhouette_squared(spark, sf):
    return segment.silhouette_squared(segment.assign(fixed_points(spark, sf), FIXED_CENTERS))


@register("silhouette_summary", _seg_sql("""
    SELECT cluster, count(*) AS rows,
           avg(CASE WHEN own_n <= 1 THEN 0.0 WHEN a < b THEN 1.0 - a / b
                    WHEN a > b THEN b / a - 1.0 ELSE 0.0 END) AS silhouette
    FROM sil GROUP BY ROLLUP (cluster)""", _SIL_CTES))
def silhouette_summary(spark, sf):
    return segment.silhouette_summary(
        segment.silhouette_squared(segment.assign(fixed_points(spark, sf), FIXED_CENTERS)))


@register("inertia_k1", _seg_sql("SELECT count(*) * (var_pop(c1) + var_pop(c2)) AS inertia FROM pts"))
def inertia_k1(spark, sf):
    """C5 at k = 1: the closed form that the elbow starts from."""
    return spark.createDataFrame([(segment.inertia_k1(fixed_points(spark, sf)),)], "inertia double")


@register("kmeans_round", _seg_sql("""
    SELECT cluster, count(*) AS n, avg(c1) AS c1, avg(c2) AS c2, sum(cluster_sqdist) AS cost
    FROM assigned GROUP BY cluster""", [_ASSIGN_CTE]))
def kmeans_round(spark, sf):
    """One round of the batched fit from given centres."""
    return kmeans.lloyd_round(fixed_points(spark, sf), FIXED_CENTERS, "driver_uuid", segment.DIMS)


_EUCLID_CTES = [_ASSIGN_CTE, ("epair", """
    SELECT a.driver_uuid, a.cluster, b.cluster AS cid, count(*) AS n,
           sum(sqrt((a.c1 - b.c1) * (a.c1 - b.c1) + (a.c2 - b.c2) * (a.c2 - b.c2))) AS total
    FROM assigned a CROSS JOIN assigned b GROUP BY a.driver_uuid, a.cluster, b.cluster"""), ("esil", """
    SELECT driver_uuid, cluster, max(CASE WHEN cid = cluster THEN n END) AS own_n,
           max(CASE WHEN cid = cluster THEN total / greatest(n - 1, 1) END) AS a,
           min(CASE WHEN cid <> cluster THEN total / n END) AS b
    FROM epair GROUP BY driver_uuid, cluster""")]


@register("silhouette_euclidean", _seg_sql("""
    SELECT driver_uuid, cluster, CASE WHEN own_n <= 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0.0
           ELSE round((b - a) / greatest(a, b), 5) END AS silhouette
    FROM esil""", _EUCLID_CTES))
def silhouette_euclidean(spark, sf):
    """C6 in the Euclidean form; the tree's error bound must stay under what is compared."""
    labelled = tables.materialise(segment.assign(fixed_points(spark, sf), FIXED_CENTERS), "assigned")
    scored = euclidean_silhouette(labelled, ["driver_uuid"])
    exact = F.when(F.col("error_bound") < 1e-3, F.round("silhouette", 5))
    return scored.select("driver_uuid", "cluster", exact.alias("silhouette"))


# ---------------------------------------------------------------------------
# Stored models: scoring is checked apart from fitting
# ---------------------------------------------------------------------------

# Loadings and centres as a fit stores them, fixed here so that SQL can apply them.
STORED_LOADINGS = ((0.5, 0.25, 0.125, 0.5, 0.375, 0.25), (0.25, -0.5, 0.375, -0.125, 0.5, -0.25))
STORED_CENTERS = {"": ((0.25, -0.25), (0.75, 0.125)), "A": ((0.25, -0.5), (0.5, 0.0)),
                  "B": ((0.5, 0.0), (0.625, 0.25), (0.75, -0.125), (0.875, 0.125))}


def stored_models(spark, sf, data=None) -> dict:
    """The three stored models; their registry knows the first regions only."""
    known = (seg_input(spark, sf) if data is None else data).where(F.col("logistic_region").isin(*FIRST_REGIONS))
    registry = prepare.update_registry(None, known, FEATS)
    return {p: segment.SegmentModel(registry, [list(r) for r in STORED_LOADINGS],
                                    segment.Clusterer([tuple(c) for c in centers], 0.0, segment.SEED), p)
            for p, centers in STORED_CENTERS.items()}


def _nearest_sql(prefix: str) -> str:
    dist = [f"((c1 - {x}) * (c1 - {x}) + (c2 - {y}) * (c2 - {y}))" for x, y in STORED_CENTERS[prefix]]
    names = segment.letters(len(dist), prefix)
    cases = " ".join(f"WHEN {d} = least({', '.join(dist)}) THEN '{n}'" for d, n in zip(dist, names))
    return f"CASE {cases} END"


_NORM = "sqrt(" + " + ".join(f"{c} * {c}" for c in FEATS) + ")"
STORED_CTES = [("stored_pts", "SELECT driver_uuid, logistic_region, " + ", ".join(
    f"CASE WHEN {_NORM} = 0 THEN 0.0 ELSE (" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in zip(FEATS, row))
    + f") / {_NORM} END AS {d}" for row, d in zip(STORED_LOADINGS, segment.DIMS)) + " FROM scaled"),
    ("stored_top", f"SELECT *, {_nearest_sql('')} AS segmentation FROM stored_pts"),
    ("stored_sub", f"""SELECT *, CASE segmentation WHEN 'A' THEN {_nearest_sql('A')}
        ELSE {_nearest_sql('B')} END AS subsegmentation FROM stored_top""")]


@register("embed_stored", _seg_sql("SELECT * FROM stored_pts", STORED_CTES))
def embed_stored(spark, sf):
    return segment.embed(STORED_LOADINGS, scaled_input(spark, sf), ["driver_uuid", "logistic_region"], FEATS)


@register("score_stored_model", _seg_sql("SELECT * FROM stored_top", STORED_CTES))
def score_stored_model(spark, sf):
    """C9 on a load most of whose regions the stored registry does not know: every driver is scored."""
    data = seg_input_stored(spark, sf)
    return segment.score(stored_models(spark, sf, data)[""], data)


@register("model_roundtrip", _seg_sql("SELECT * FROM stored_top", STORED_CTES))
def model_roundtrip(spark, sf):
    """The same after the model was written to storage and read again."""
    data = seg_input_stored(spark, sf)
    path = tables.scratch_path(spark, "segment-model")
    segment.save_model(stored_models(spark, sf, data)[""], path)
    return segment.score(segment.load_model(spark, path), data)


def _score_job(spark, sf):
    """The feature table is built once, for the load and for the models' registry, which the job reads many times."""
    from fleetcraft.plans import jobs
    features = features_table(spark, sf)
    models = stored_models(spark, sf, jobs.prepare_segment_input(features))
    registry = tables.materialise(models[""].scaler, "stored-registry")
    return jobs.score_job(features, {p: replace(m, scaler=registry) for p, m in models.items()})


@register("score_job_stored", _seg_sql("""
    SELECT seg.*, t.segmentation, t.subsegmentation FROM seg JOIN stored_sub t USING (driver_uuid)""".replace(
    "seg.*", "driver_uuid, seg.logistic_region, seg.date_partition, " + ", ".join(f"seg.{c}" for c in FEATS)),
    STORED_CTES))
def score_job_stored(spark, sf):
    """C8 + C9: both levels of a fresh load through the job itself."""
    return _score_job(spark, sf)


@register("priority_stored", _seg_sql(f"""
    SELECT t.driver_uuid, t.subsegmentation, p.priority FROM stored_sub t
    LEFT JOIN (VALUES {', '.join(f"('{n}', {k})" for n, k in segment.PRIORITY)}) p(name, priority)
    ON t.subsegmentation = p.name""", STORED_CTES))
def priority_stored(spark, sf):
    segs = _score_job(spark, sf)
    return segs.join(segment.priority_table(spark), "subsegmentation", "left").select(
        "driver_uuid", "subsegmentation", "priority")


_ACTIVE = dict(gap_days=6, recent_days=20, strong_days=3)
_ACTIVITY_CTES = [("days", f"""SELECT DISTINCT driver_uuid, date_partition AS d FROM deliveries
        WHERE date_partition <= DATE '{RUN_DATE}' AND driver_uuid IS NOT NULL"""),
    ("begun", f"""SELECT *, CASE WHEN d - lag(d) OVER w <= {_ACTIVE['gap_days']} THEN 0 ELSE 1 END AS begins
        FROM days WINDOW w AS (PARTITION BY driver_uuid ORDER BY d)"""),
    ("stretched", "SELECT *, sum(begins) OVER (PARTITION BY driver_uuid ORDER BY d) AS stretch FROM begun"),
    ("stretches", "SELECT driver_uuid, stretch, min(d) AS b, count(*) AS n FROM stretched GROUP BY driver_uuid, stretch"),
    ("activity", f"""SELECT driver_uuid, min(b) AS first_day, max(b) AS back_day, CAST(max(stretch) AS BIGINT) AS stretches,
        arg_max(n, stretch) AS stretch_days,
        CASE WHEN min(b) > DATE '{RUN_DATE}' - {_ACTIVE['recent_days']} THEN 'new'
             WHEN max(stretch) > 1 AND max(b) > DATE '{RUN_DATE}' - {_ACTIVE['recent_days']}
             THEN CASE WHEN arg_max(n, stretch) >= {_ACTIVE['strong_days']} THEN 'reactivated_strong' ELSE 'reactivated_weak' END
             ELSE 'regular' END AS status FROM stretches GROUP BY driver_uuid""")]


def _activity(spark, sf):
    return activity.activity_status(fixtures(spark, sf).deliveries(), RUN_DATE, **_ACTIVE)


@register("activity_status", with_views(["deliveries"], "SELECT * FROM activity", extra=_ACTIVITY_CTES))
def activity_status(spark, sf):
    """C11: new and reactivated drivers by the gaps between their active days."""
    return _activity(spark, sf)


def _order_sql(column, order):
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in order.items()) + " END"


@register("priority_with_activity", _seg_sql(f"""
    SELECT driver_uuid, t.subsegmentation, a.status,
           coalesce({_order_sql('a.status', activity.FIRST_STATUS)}, {_order_sql('t.subsegmentation', activity.FIRST_ORDER)}) AS priority
    FROM stored_sub t FULL JOIN activity a USING (driver_uuid)""", STORED_CTES + _ACTIVITY_CTES))
def priority_with_activity(spark, sf):
    """C11: the calling order with new and reactivated drivers."""
    return activity.prioritise(_score_job(spark, sf), _activity(spark, sf))


@register("priority_second_order", _seg_sql(f"""
    SELECT driver_uuid, subsegmentation, {_order_sql('subsegmentation', activity.SECOND_ORDER)} AS priority FROM stored_sub""",
                                            STORED_CTES))
def priority_second_order(spark, sf):
    return activity.prioritise(_score_job(spark, sf), order=activity.SECOND_ORDER)


@register("subsegment_sizes_stored", _seg_sql(
    "SELECT subsegmentation, count(*) AS count FROM stored_sub GROUP BY subsegmentation", STORED_CTES))
def subsegment_sizes_stored(spark, sf):
    return profile.value_counts(_score_job(spark, sf), "subsegmentation")


_NAN_SQL = "SELECT CASE WHEN qty_recharge % 2 = 0 THEN NULL ELSE avg_recharge::DOUBLE END AS x FROM features"


@register("describe_with_nan", _feat_sql("""
    SELECT 'x' AS column_name, count(x) AS count, avg(x::DECIMAL(38, 10)) AS mean, stddev_samp(x) AS std, min(x) AS min,
           quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max
    FROM nans""", [("nans", _NAN_SQL)]))
def describe_with_nan(spark, sf):
    """NaN counts as missing in every number of a profile."""
    x = F.when(F.col("qty_recharge") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("avg_recharge").cast("double"))
    return profile.describe(features_table(spark, sf).select(x.alias("x")), ["x"])


def _with_nan(spark, sf):
    """The features with NaN for every second recharge count's mean; the count itself stays."""
    x = F.when(F.col("qty_recharge") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("avg_recharge").cast("double"))
    return features_table(spark, sf).select("driver_uuid", "days_connected", x.alias("x"))


_NAN_ROWS = ("nan_rows", """SELECT driver_uuid, days_connected,
    CASE WHEN qty_recharge % 2 = 0 THEN NULL ELSE avg_recharge::DOUBLE END AS x FROM features""")


@register("drop_above_with_nan", _feat_sql("""
    SELECT driver_uuid, x, count_if(x >= 4000) OVER () AS rows_above FROM nan_rows
    QUALIFY x IS NULL OR x < 4000""", [_NAN_ROWS]))
def drop_above_with_nan(spark, sf):
    """D15 where NaN is missing: such rows stay and are not counted."""
    data = _with_nan(spark, sf)
    above = prepare.count_above(data, "x", 4000.0).select("rows_above")
    return with_one_row(prepare.drop_above(data, "x", 4000.0), above).select(
        "driver_uuid", F.nanvl("x", F.lit(None).cast("double")).alias("x"), "rows_above")


@register("correlation_with_nan", _feat_sql("""
    SELECT 'x' AS feature_a, 'days_connected' AS feature_b, abs(corr(x, days_connected::DOUBLE)) AS abs_corr
    FROM nan_rows""", [_NAN_ROWS]))
def correlation_with_nan(spark, sf):
    """D9 over the rows in which neither number is missing."""
    return profile.correlation_lower(_with_nan(spark, sf), ["days_connected", "x"])


# ---------------------------------------------------------------------------
# Fitted models (rows-only checks): embedding, k-means, hierarchy, scoring
# ---------------------------------------------------------------------------

def _embedded(spark, sf):
    scaled = prepare.scale_minmax(seg_input_stored(spark, sf), FEATS).na.drop(subset=list(FEATS))
    model = segment.fit_embedding(scaled)
    return segment.embed(model, scaled, ["driver_uuid", "logistic_region"])


@register("embed_2d")
def embed_2d(spark, sf):
    return _embedded(spark, sf)


@register("elbow_k1_9")
def elbow_k1_9(spark, sf):
    return segment.elbow(_embedded(spark, sf), range(1, 10))


def _top(spark, sf, restarts=segment.RESTARTS, data=None):
    return segment.fit_segments(seg_input_stored(spark, sf) if data is None else data, k=2, restarts=restarts)


def _top_rows(spark, sf):
    """The prepared input, stored once for the fit and the join, with its segments."""
    data = seg_input_stored(spark, sf)
    return _top(spark, sf, data=data)[1].join(data, "driver_uuid").drop("c1", "c2")


@register("kmeans_segments")
def kmeans_segments(spark, sf):
    return _top(spark, sf)[1]


@register("cluster_centers")
def cluster_centers(spark, sf):
    model, _ = _top(spark, sf)
    return segment.cluster_centers(model.clusterer, spark)


def hierarchical(spark, sf, sub_k=(("A", 2), ("B", 4)), sub_scaler="minmax", data=None):
    """Both levels fitted on the prepared input."""
    return segment.fit_two_levels(seg_input_stored(spark, sf) if data is None else data, 2, sub_k, sub_scaler)


@register("hierarchical_segments")
def hierarchical_segments(spark, sf):
    return hierarchical(spark, sf)[0]


@register("hierarchical_segments_exploratory")
def hierarchical_segments_exploratory(spark, sf):
    """C8 (exploratory sizes): A -> 4 and B -> 3, standard scaling refitted per subset."""
    return hierarchical(spark, sf, sub_k=(("A", 4), ("B", 3)), sub_scaler="standard")[0]


@register("silhouette_k2_5")
def silhouette_k2_5(spark, sf):
    """Silhouette analysis over k = 2..5 on the embedded drivers."""
    return segment.silhouette_by_k(_embedded(spark, sf), (2, 3, 4, 5))


@register("score_new_load")
def score_new_load(spark, sf):
    """Fit on all regions but one, then score a load that holds that region too."""
    from fleetcraft.plans import jobs
    data = seg_input_stored(spark, sf)
    _, models = hierarchical(spark, sf, data=data.where(F.col("logistic_region") != REGION_LABELS[-1]))
    return jobs.score_job(features_table(spark, sf), models)


_UNIT_SQL = "round({} / " + "sqrt(" + " + ".join(f"{c} * {c}" for c in FEATS) + "), 12)"
_GRAPH_CTES = [("unit", "SELECT driver_uuid, [" + ", ".join(_UNIT_SQL.format(c) for c in FEATS) + "] AS v FROM scaled WHERE "
                + " AND ".join(f"{c} IS NOT NULL" for c in FEATS) + " AND " + " + ".join(f"{c} * {c}" for c in FEATS) + " > 0"),
               ("dirs", "SELECT min(driver_uuid) AS id, v FROM unit GROUP BY v"),
               ("apart", """SELECT a.id, b.id AS neighbour, round((1 - list_dot_product(a.v, b.v)) / 1e-12) * 1e-12 AS distance
                    FROM dirs a JOIN dirs b ON a.id <> b.id"""),
               ("ranked", """SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank,
                    neighbour, distance FROM apart""")]


def _graph(spark, sf):
    scaled = prepare.scale_minmax(seg_input_stored(spark, sf), FEATS)
    return neighbours.neighbour_graph(neighbours.directions(scaled, "driver_uuid", FEATS))


@register("neighbour_graph", _seg_sql("SELECT * FROM ranked WHERE rank <= 9", _GRAPH_CTES))
def neighbour_graph(spark, sf):
    """The nine nearest drivers of each by cosine distance, found by neighbour descent."""
    return neighbours.edge_rows(_graph(spark, sf))


@register("neighbour_recall", "SELECT true AS enough")
def neighbour_recall(spark, sf):
    """C2 measured: a fifth of the drivers against all, brute force in blocks."""
    found = neighbours.recall(_graph(spark, sf), of=5)
    return found.select((F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("enough"))


@register("embed_nonlinear")
def embed_nonlinear(spark, sf):
    """C1 in the non-linear form: a layout of the neighbour graph."""
    return neighbours.layout(_graph(spark, sf)).select("id", "c1", "c2")


@register("place_nonlinear")
def place_nonlinear(spark, sf):
    """The layout of the first regions' drivers, stored as landmarks, places every driver."""
    scaled = prepare.scale_minmax(seg_input_stored(spark, sf), FEATS)
    known = neighbours.directions(scaled.where(F.col("logistic_region").isin(*FIRST_REGIONS)), "driver_uuid", FEATS)
    marks = tables.materialise(neighbours.landmarks(neighbours.layout(neighbours.neighbour_graph(known))), "landmarks")
    return neighbours.place(neighbours.directions(scaled, "driver_uuid", FEATS), marks).select("id", "c1", "c2")


def _parent_points(spark, sf, parent):
    """The embedded drivers of one segment: projection fitted on their rows, as the subsegments' fit does it."""
    data = seg_input_stored(spark, sf)
    model, top = segment.fit_segments(data, k=2)
    subset = data.join(top.where(F.col("segmentation") == parent).select("driver_uuid"), "driver_uuid")
    scaled = prepare.transform_minmax(subset, model.scaler, FEATS).na.drop(subset=list(FEATS))
    return tables.materialise(segment.embed(segment.fit_embedding(scaled), scaled, ["driver_uuid", "logistic_region"]), "parent-points")


def _elbow_facts(found):
    """Per k whether the inertia is no larger than that of k - 1 (up to rounding), and not negative."""
    before = F.lag("inertia").over(Window.orderBy("k"))
    return found.select("k", (F.coalesce(F.col("inertia") <= before * (1 + 1e-9), F.lit(True))
                              & (F.col("inertia") >= 0)).alias("holds"))


_FACTS_SQL = "SELECT CAST(range AS INTEGER) AS k, true AS holds FROM range({}, {})"


@register("elbow_facts", _FACTS_SQL.format(1, 10))
def elbow_facts(spark, sf):
    """C5 checked: more clusters never cost more than fewer."""
    return _elbow_facts(elbow_k1_9(spark, sf))


@register("elbow_a")
def elbow_a(spark, sf):
    """C5 of the first segment's drivers."""
    return segment.elbow(_parent_points(spark, sf, "A"), range(1, 10))


@register("elbow_b")
def elbow_b(spark, sf):
    return segment.elbow(_parent_points(spark, sf, "B"), range(1, 10))


@register("silhouette_a")
def silhouette_a(spark, sf):
    """C6 of the first segment's drivers over k = 2..5, both forms."""
    return segment.silhouette_by_k(_parent_points(spark, sf, "A"), (2, 3, 4, 5))


@register("silhouette_b")
def silhouette_b(spark, sf):
    return segment.silhouette_by_k(_parent_points(spark, sf, "B"), (2, 3, 4, 5))


@register("kmeans_facts", "SELECT * FROM (VALUES ('centre is the mean', true), ('cost is the sum', true), "
          "('label is nearest', true), ('no point lost', true)) t(fact, holds)")
def kmeans_facts(spark, sf):
    """C3, C4, C7, C12 checked on a fit: each centre is the mean of its rows, the cost their summed squared
    distances, each label that of the nearest centre, and every embedded driver is labelled."""
    points = tables.materialise(_embedded(spark, sf), "embedded")
    fit = segment.fit_kmeans(points, 3)
    labelled = segment.label_rows(points, fit)
    centers = segment.cluster_centers(fit, spark).select("label", F.col("c1").alias("x"), F.col("c2").alias("y"))
    met = labelled.join(F.broadcast(centers), F.col("segmentation") == F.col("label"))
    away = (F.col("c1") - F.col("x")) ** 2 + (F.col("c2") - F.col("y")) ** 2
    least = F.array_min(F.array(*[(F.col("c1") - x) ** 2 + (F.col("c2") - y) ** 2 for x, y in fit.centers]))
    rows = met.select("label", "x", "y", "c1", "c2", away.alias("d"), least.alias("least"))
    per = rows.groupBy("label", "x", "y").agg(F.avg("c1").alias("mx"), F.avg("c2").alias("my"), F.sum("d").alias("d"),
                                              F.max(F.col("d") - F.col("least")).alias("over"), F.count(F.lit(1)).alias("n"))
    # the fit stops when no centre moves by more than its tolerance
    close = F.max(F.abs(F.col("mx") - F.col("x")) + F.abs(F.col("my") - F.col("y"))) <= 2e-4
    facts = per.agg(close.alias("a"), (F.abs(F.sum("d") - fit.cost) <= 1e-9 * (1 + fit.cost)).alias("b"),
                    (F.max("over") <= 1e-12).alias("c"), F.sum("n").alias("n"))
    total = points.agg(F.count(F.lit(1)).alias("total"))
    return with_one_row(facts, total).select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("fact"), held.alias("holds")) for name, held in (
            ("centre is the mean", F.col("a")), ("cost is the sum", F.col("b")), ("label is nearest", F.col("c")),
            ("no point lost", F.col("n") == F.col("total")))])).alias("r")).select("r.*")


SUBSEGMENTS = ("AA", "AB", "BA", "BB", "BC", "BD")


@register("subsegment_sizes")
def subsegment_sizes(spark, sf):
    """A15 on the fitted subsegments."""
    return profile.value_counts(hierarchical(spark, sf)[0], "subsegmentation")


@register("subsegment_profile")
def subsegment_profile(spark, sf):
    """A16 on the fitted subsegments: feature x subsegment means."""
    return profile.means_transposed(hierarchical(spark, sf)[0], "subsegmentation", SUBSEGMENTS, FEATS)


@register("priority_lookup")
def priority_lookup(spark, sf):
    segs = hierarchical(spark, sf)[0]
    return segs.join(F.broadcast(segment.priority_table(spark)), "subsegmentation", "left")


@register("feature_importance")
def feature_importance(spark, sf):
    return segment.feature_importance(_top_rows(spark, sf))


@register("extra_trees_importance")
def extra_trees_importance(spark, sf):
    splits = trees.fit_extra_trees(_top_rows(spark, sf), FEATS, "segmentation")
    return trees.importance(spark, splits, FEATS)


_ROOT_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, logistic_region AS y, {c}::DOUBLE AS v FROM features" for c in FEATS)


@register("extra_trees_roots", _feat_sql("""
    SELECT tree, 1 AS node, feature, round(cut, 6) AS threshold, n::BIGINT AS n, n_left::BIGINT AS n_left,
           round(gini - (n_left * gini_left + (n - n_left) * gini_right) / n, 9) AS gain FROM sides
    QUALIFY row_number() OVER (PARTITION BY tree ORDER BY gini - (n_left * gini_left + (n - n_left) * gini_right) / n DESC, pick) = 1
    """, extra=[
    ("long", _ROOT_LONG),
    ("ranges", "SELECT feature, min(v) AS low, max(v) AS high FROM long GROUP BY feature"),
    ("drawn", """SELECT r.range::INTEGER AS tree, feature, low, high,
        low + ('0x' || md5('42:' || r.range || ':1:' || feature || ':at')[1:8])::BIGINT / 4294967296::DOUBLE * (high - low) AS x,
        row_number() OVER (PARTITION BY r.range ORDER BY md5('42:' || r.range || ':1:' || feature || ':pick')) AS pick
        FROM range(100) r, ranges WHERE high > low"""),
    ("tried", "SELECT *, CASE WHEN x < high THEN x ELSE low END AS cut FROM drawn WHERE pick <= 2"),
    ("classes", """SELECT tree, feature, pick, cut, y, count(*)::DOUBLE AS n, (count(*) FILTER (v <= cut))::DOUBLE AS l
        FROM tried JOIN long USING (feature) GROUP BY ALL"""),
    ("sides", """SELECT tree, feature, pick, cut, sum(n) AS n, sum(l) AS n_left, 1 - sum(n * n) / (sum(n) * sum(n)) AS gini,
        1 - sum(l * l) / (sum(l) * sum(l)) AS gini_left,
        1 - sum((n - l) * (n - l)) / (sum(n - l) * sum(n - l)) AS gini_right FROM classes GROUP BY ALL""")]))
def extra_trees_roots(spark, sf):
    """The first split of each of 100 trees that tell regions apart."""
    splits = trees.fit_extra_trees(features_table(spark, sf), FEATS, "logistic_region", depth=1)
    return trees.splits_table(spark, splits).withColumns({"threshold": F.round("threshold", 6), "gain": F.round("gain", 9)})


@register("unknown_regions", _feat_sql(f"""
    SELECT DISTINCT logistic_region FROM features
    WHERE logistic_region NOT IN ({", ".join(f"'{r}'" for r in FIRST_REGIONS)})"""))
def unknown_regions(spark, sf):
    """Regions of a fresh load that the scaler registry of an earlier one lacks."""
    data = features_table(spark, sf)
    registry = prepare.fit_minmax(data.where(F.col("logistic_region").isin(*FIRST_REGIONS)), FEATS)
    # the earlier load knew all first regions, also those without a driver now
    known = registry.select("logistic_region").unionByName(
        spark.createDataFrame([(r,) for r in FIRST_REGIONS], "logistic_region string")).distinct()
    return prepare.unknown_groups(known, data)


@register("top_recharged", _feat_sql("""
    SELECT driver_uuid, logistic_region, qty_recharge FROM features
    ORDER BY qty_recharge DESC, driver_uuid, logistic_region LIMIT 10"""))
def top_recharged(spark, sf):
    """O3: the ten drivers with most recharges."""
    data = feature_mart_row(spark, sf)
    return (data.orderBy(F.desc("qty_recharge"), "driver_uuid", "logistic_region").limit(10)
            .select("driver_uuid", "logistic_region", "qty_recharge"))


# ---------------------------------------------------------------------------
# Round trips through storage
# ---------------------------------------------------------------------------

FEATURE_SCHEMA = T.StructType(
    [T.StructField("driver_uuid", T.StringType()), T.StructField("logistic_region", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("prop_critical_delay", "driver_delay_origin", "speed",
                                                   "consumer_evaluation", "sla", "prop_completed_routes",
                                                   "days_connected", "avg_daily_critical_hours_executed",
                                                   "avg_special_hours_executed", "avg_total_hours_executed")]
    + [T.StructField("strikes", T.LongType()), T.StructField("qty_recharge", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("avg_recharge", "share_days_non_negative", "avg_daily_utr")]
    + [T.StructField("date_partition", T.DateType()), T.StructField("orders", T.LongType()),
       T.StructField("antiquity", T.IntegerType())])


@register("csv_roundtrip", _feat_sql("SELECT * FROM features"))
def csv_roundtrip(spark, sf):
    path = tables.scratch_path(spark, "features-csv")
    tables.write_csv(features_table(spark, sf), path)
    return tables.check_schema(tables.read_csv(spark, path, FEATURE_SCHEMA), FEATURE_SCHEMA)


@register("orders_with_options", """
    SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderdate >= DATE '1995-01-01' GROUP BY o_orderstatus""")
def orders_with_options(spark, sf):
    """Reader options and a constant filter that reaches the scan."""
    orders = tables.load_with_options(spark, os.path.join(sf, "orders.parquet"), "parquet", {"mergeSchema": "true"},
                                      "o_orderdate >= DATE '1995-01-01'")
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@register("workbook_roundtrip", _feat_sql("SELECT * FROM features"))
def workbook_roundtrip(spark, sf):
    """Workbooks of each region, read back with the declared schema."""
    path = tables.scratch_path(spark, "features-workbooks")
    workbooks.write_workbooks(features_table(spark, sf), path)
    return workbooks.read_workbooks(spark, path, FEATURE_SCHEMA)


@register("partitioned_write_roundtrip", _feat_sql("SELECT * FROM features"))
def partitioned_write_roundtrip(spark, sf):
    path = tables.scratch_path(spark, "features-by-date")
    tables.write_partitioned(features_table(spark, sf), path, "date_partition")
    return spark.read.parquet(path)


@register("catalog_publish", _feat_sql("SELECT * FROM features"))
def catalog_publish(spark, sf):
    """A version that passes its gate is published, a later one with a repeated key is refused and nobody sees it."""
    data = tables.materialise(features_table(spark, sf), "features")
    name = f"features_{uuid.uuid4().hex[:8]}"

    def audit(df):
        return quality.gate(quality.quality_report(df, name, unique_key="driver_uuid"))

    publish.publish(data, name, audit)
    try:
        publish.publish(data.unionByName(data), name, audit)
    except RuntimeError:
        return spark.table(name)
    raise AssertionError("a repeated key passed the gate")


@register("materialise_roundtrip", _feat_sql("SELECT * FROM features"))
def materialise_roundtrip(spark, sf):
    return tables.materialise(features_table(spark, sf), "features")

