"""Cross-model invariants on the driver tables (sf0.001)."""

from pyspark.sql import functions as F

from talentlake.plans.catalog import QUERIES, warehouse


def test_status_shares_sum_to_one(spark, sf_dir):
    k1 = warehouse(spark, sf_dir).mart_status_by_scope
    sums = k1.groupBy("office_id", "department_id").agg(F.sum("status_share").alias("s")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-9 for r in sums)


def test_met_plus_breached_equals_owned(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    k2 = w.mart_exec_overview.collect()[0]
    assert k2.recruiter_sla_met_cases + k2.recruiter_sla_breached_cases == k2.recruiter_owned_stage_cases
    for r in w.mart_recruiter_performance.collect():
        assert r.sla_met_cases + r.sla_breached_cases == r.total_cases


def test_funnel_bounded_by_distinct_applications(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    apps = w.stg_events.select("application_id").distinct().count()
    assert all(r.applications_reached <= apps for r in w.mart_funnel.collect())


def test_overview_equals_diagnostics(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    k2 = w.mart_exec_overview.collect()[0]
    k9 = w.mart_tth_diagnostics.collect()[0]
    assert k2.hired_applications == k9.total_hired_applications
    assert k2.hired_applications_with_valid_time_to_hire == k9.hired_applications_with_valid_time_to_hire
    assert k2.avg_time_to_hire_days == k9.avg_time_to_hire_days


def test_hiring_k_moves_k_from_active_to_hired(spark, sf_dir):
    before = {r["status"]: r["count"] for r in QUERIES["seed_applications"](spark, sf_dir).groupBy("status").count().collect()}
    after = {r.status: r.applications for r in QUERIES["apply_outcome_status_mix"](spark, sf_dir).collect()}
    hired_items = QUERIES["apply_hire"](spark, sf_dir)
    k = hired_items.filter("apply_status = 'applied'").count()
    rejected = QUERIES["apply_reject"](spark, sf_dir).count()
    assert after["hired"] == before["hired"] + k
    assert after["active"] == before["active"] - k - rejected
    assert after["rejected"] == before["rejected"] + rejected
