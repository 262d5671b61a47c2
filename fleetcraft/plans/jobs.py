"""End-to-end jobs: the three notebooks of the reference as Spark jobs.

Each job reads logical tables through ``t`` (``Fixtures`` or any object with
the same methods), writes its result under ``out_dir`` and returns the
DataFrames it produced (read back from storage, so callers never hold a long
lineage). Outputs are the same as the catalogue queries.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcraft.operators import coverage as cov
from fleetcraft.operators import eligibility as elig
from fleetcraft.operators import prepare, quality, segment
from fleetcraft.plans import feature_mart
from fleetcraft.sources import tables

FEATURE_CHECKS = ("driver_uuid", "logistic_region", "prop_critical_delay", "sla", "prop_completed_routes",
                  "days_connected", "avg_total_hours_executed")


def feature_mart_job(t, params: feature_mart.FeatureParams, out_dir: str, min_rows: int | None = None,
                     enforce: bool = False) -> tuple[DataFrame, DataFrame]:
    """Build the feature row, check it, write it partitioned by run date.

    Re-running a date replaces only that date's partition (dynamic overwrite).
    Returns (features as written, quality report).
    """
    features = tables.materialise(feature_mart.feature_row(t, params), "feature-row")
    report = quality.quality_report(features, "features", never_null=FEATURE_CHECKS, min_rows=min_rows)
    if enforce:
        quality.gate(report)
    path = os.path.join(out_dir, "features")
    tables.write_partitioned(features, path, "date_partition")
    return t.spark.read.parquet(path).where(F.col("date_partition") == F.lit(params.windows.end)), report


@dataclass
class EligibilityResult:
    workers: DataFrame
    rules: DataFrame
    final: DataFrame
    order_coverage: DataFrame
    region_coverage: DataFrame


def eligibility_job(t, params: elig.EligibilityParams, rule_set: elig.RuleSet, run_date: dt.date,
                    out_dir: str, report_regions: Sequence[str]) -> EligibilityResult:
    """Worker row -> stored temp table -> rules -> final table -> unique-key
    gate -> overwrite the saved tables; coverage reports from one order base."""
    spark = t.spark
    # One (driver, region) aggregate of the window feeds the worker row and both reports: stored once.
    base = tables.materialise(cov.order_base(t.wallet_orders(), params.windows.orders), "order-base")
    workers = tables.materialise(elig.worker_row(t, params, base), "worker-row")
    rules = elig.apply_rules(workers, rule_set)
    rules_path = os.path.join(out_dir, "driver_rules")
    tables.overwrite_table(rules, rules_path)
    rules = spark.read.parquet(rules_path)
    final = tables.materialise(elig.final_segments(t.segmentation(), rules, run_date), "final-staged")
    quality.gate(quality.quality_report(final, "driver_segments_final", unique_key="driver_id"))
    final_path = os.path.join(out_dir, "driver_segments_final")
    tables.overwrite_table(final, final_path)
    return EligibilityResult(
        workers=workers, rules=rules, final=spark.read.parquet(final_path),
        order_coverage=cov.order_coverage(base, rules),
        region_coverage=cov.region_coverage_labelled(base, rules, "final_setting", report_regions))


@dataclass
class SegmentationResult:
    segments: DataFrame
    models: dict


def prepare_segment_input(features: DataFrame, strict: Sequence[str] = ()) -> DataFrame:
    """Drop unused columns, replace outliers, one row per driver (P2 preparation)."""
    data = features.select(*[c for c in features.columns if c not in segment.DROPPED_FEATURES])
    data = prepare.replace_outliers(data, segment.OUTLIER_FEATURES, mode="std3", strict=strict)
    return prepare.dedup_first(data, "driver_uuid", ["date_partition", "logistic_region"])


def segmentation_job(features: DataFrame, out_dir: str, top_k: int = 2,
                     sub_k: Sequence[tuple[str, int]] = (("A", 2), ("B", 4)),
                     restarts: int = segment.RESTARTS) -> SegmentationResult:
    """Two-level segmentation with stored models; CSV export of the result."""
    data = tables.materialise(prepare_segment_input(features), "segment-input")
    result, models = segment.fit_two_levels(data, top_k, sub_k, restarts=restarts)
    result = tables.materialise(result, "segments")
    path = os.path.join(out_dir, "segments_csv")
    tables.write_csv(result, path)
    return SegmentationResult(segments=result, models=models)


def score_job(features: DataFrame, models: dict) -> DataFrame:
    """Second pass of the final notebook: label a fresh load with stored models."""
    fresh = tables.materialise(prepare_segment_input(features), "fresh-input")
    registry = tables.materialise(prepare.update_registry(models[""].scaler, fresh, segment.SEGMENT_FEATURES,
                                                          kind=models[""].kind), "scaler-registry")
    top = tables.materialise(segment.score(models[""], fresh, registry=registry), "top-segments")
    labelled = fresh.join(top.select("driver_uuid", "segmentation"), "driver_uuid")
    # a parent without stored subsegments keeps its drivers, with no subsegment
    subs = None
    for p in (p for p in models if p):
        part = segment.score(models[p], labelled.where(F.col("segmentation") == p), column="subsegmentation",
                             registry=registry).select("driver_uuid", "subsegmentation")
        subs = part if subs is None else subs.unionByName(part)
    return labelled.join(subs, "driver_uuid", "left") if subs is not None else labelled
