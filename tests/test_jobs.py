"""End-to-end jobs on the smallest fixtures that hold them."""

from fleetcraft.plans import jobs
from fleetcraft.plans.settings import ELIGIBILITY, FEATURES, REGIONS, RULES_ACTIVE, RUN_DATE
from fleetcraft.sources import tables
from fleetcraft.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
SEGMENT_SF = "/root/testdata/sf0.01"   # the smallest with enough drivers for six subsegments


def test_eligibility_job(spark):
    out = tables.scratch_path(spark, "test-eligibility")
    res = jobs.eligibility_job(Fixtures(spark, SF), ELIGIBILITY, RULES_ACTIVE, RUN_DATE, out, REGIONS)
    assert res.final.count() == res.final.select("driver_id").distinct().count()
    assert res.rules.count() == res.workers.count()
    assert {r.setting for r in res.order_coverage.collect()} == {"setting_1", "final_setting"}


def test_feature_and_segmentation_jobs(spark):
    out = tables.scratch_path(spark, "test-features")
    t = Fixtures(spark, SEGMENT_SF)
    features, report = jobs.feature_mart_job(t, FEATURES, out)
    n = features.count()
    assert report.count() == len(jobs.FEATURE_CHECKS)
    seg = jobs.segmentation_job(features, out, restarts=2)
    rows = seg.segments.collect()
    assert len(rows) == n
    assert all(r.subsegmentation.startswith(r.segmentation) for r in rows)
    scored = jobs.score_job(features, seg.models)
    assert scored.count() == n


def test_catalog_tables_run_the_same_job(spark):
    """Logical tables written out and read back through CatalogTables give the
    same worker row as the fixture mapping."""
    from fleetcraft.operators import eligibility as elig
    from fleetcraft.sources.catalog import CatalogTables

    fx = Fixtures(spark, SF)
    base = tables.scratch_path(spark, "test-catalog")
    frames = {"accounts": fx.accounts(), "workers": fx.workers(), "segmentation": fx.segmentation(),
              "wallet_orders": fx.wallet_orders(), "deliveries": fx.deliveries(), "routes": fx.routes(),
              "worker_registration": fx.worker_registration(), "billing": fx.billing(with_uuid=True),
              "daily_wallet": fx.daily_wallet(), "strikes": fx.strikes(),
              "supply_intervals": fx.supply_intervals(with_uuid=True), "wallet_streak": fx.wallet_streak(),
              "coordinates": fx.coordinates()}
    locations = {}
    for name, df in frames.items():
        locations[name] = f"{base}/{name}"
        df.write.parquet(locations[name])
    cat = CatalogTables(spark, locations)
    a = sorted(elig.worker_row(cat, ELIGIBILITY).collect())
    b = sorted(elig.worker_row(fx, ELIGIBILITY).collect())
    assert a == b
