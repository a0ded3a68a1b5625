"""Hand-made frames for the semantic rules (N1-N27) and the fixture cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from talentlake.config import StageConfig
from talentlake.operators import core, fractional, marts, staging
from talentlake.plans import changes
from talentlake.sources.raw import RAW_COLUMNS, normalise_raw

STAGES = StageConfig()


def raw_events(spark, rows, batch="b1", at="2024-02-01 00:00:00"):
    cols = RAW_COLUMNS["application_events"]
    full = [tuple(r.get(c) for c in cols) for r in rows]
    df = spark.createDataFrame(full, ", ".join(f"{c} string" for c in cols))
    return normalise_raw(df, "application_events", batch, at)


def ev(app, prev, cur, at, action="candidate_stage_change", org="Org"):
    return {"organization_name": org, "action": action, "application_id": str(app), "previous_status": "active",
            "current_status": "active", "last_activity_at": at, "previous_stage": prev, "current_stage": cur}


def raw_table(spark, name, rows):
    cols = RAW_COLUMNS[name]
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"{c} string" for c in cols))
    return normalise_raw(df, name, "b1", "2024-02-01 00:00:00")


def test_duplicate_event_later_load_wins(spark):
    e1 = raw_events(spark, [ev(1, None, "Application Review", "2024-01-01 00:00:00", org="first")], "b1", "2024-02-01 00:00:00")
    e2 = raw_events(spark, [ev(1, None, "Application Review", "2024-01-01 00:00:00", org="second")], "b2", "2024-02-02 00:00:00")
    out = staging.stg_events(e1.unionByName(e2)).collect()
    assert len(out) == 1 and out[0].organization_name == "second"


def test_tied_events_ordered_by_stage_rank(spark):
    rows = [
        ev(1, None, "Application Review", "2024-01-01 00:00:00"),
        # two events at the same instant (a two-stage apply): Recruiter Interview then Hiring Manager Review
        ev(1, "Recruiter Interview", "Hiring Manager Review", "2024-01-02 00:00:00"),
        ev(1, "Application Review", "Recruiter Interview", "2024-01-02 00:00:00"),
    ]
    st = staging.stg_events(raw_events(spark, rows))
    apps = spark.createDataFrame([(1,)], "application_id long").select(
        "application_id", *[F.lit(None).cast("long").alias(c) for c in ("candidate_id", "job_id", "recruiter_id", "department_id", "office_id")]
    )
    t = core.fact_stage_transition(st, apps, STAGES).orderBy("stage_name").collect()
    by_stage = {r.stage_name: r for r in t}
    assert by_stage["Application Review"].duration_hours == 24
    assert by_stage["Recruiter Interview"].duration_hours == 0


def _transitions(spark, rows, stages=STAGES):
    st = staging.stg_events(raw_events(spark, rows))
    apps = spark.createDataFrame([(1,)], "application_id long").select(
        "application_id", *[F.lit(None).cast("long").alias(c) for c in ("candidate_id", "job_id", "recruiter_id", "department_id", "office_id")]
    )
    return core.fact_stage_transition(st, apps, stages)


def test_first_event_and_sla_boundaries(spark):
    rows = [
        ev(1, None, "Application Review", "2024-01-01 00:00:00"),
        ev(1, "Application Review", "Recruiter Interview", "2024-01-04 00:00:00"),      # exactly 72 h → met
        ev(1, "Recruiter Interview", "Offer", "2024-01-07 00:59:00"),                    # 72 h 59 m → whole 72 → met
        ev(1, "Offer", "Reference Check", "2024-01-09 00:00:00"),                         # unowned → NULL
    ]
    t = {r.stage_name: r for r in _transitions(spark, rows).collect()}
    assert set(t) == {"Application Review", "Recruiter Interview", "Offer"}  # first event gives no row
    assert t["Application Review"].sla_met is True
    assert t["Recruiter Interview"].duration_hours == 72 and t["Recruiter Interview"].sla_met is True
    assert t["Offer"].sla_met is None and t["Offer"].sla_target_days is None
    assert t["Offer"].is_recruiter_owned_stage is False


def test_fractional_mode_breaches_at_72h59m(spark):
    rows = [
        ev(1, None, "Recruiter Interview", "2024-01-04 00:00:00"),
        ev(1, "Recruiter Interview", "Offer", "2024-01-07 00:59:00"),
    ]
    t = fractional.stage_transitions(raw_events(spark, rows), STAGES).orderBy("left_stage_at").collect()
    assert t[0].duration_hours is None and t[0].stage_name == "Recruiter Interview"  # first event kept
    assert t[1].sla_met is False and abs(t[1].duration_hours - (72 + 59 / 60)) < 1e-9


def _fact(spark, apps, jobs=(), cands=()):
    a = raw_table(spark, "applications", apps)
    j = raw_table(spark, "jobs", list(jobs)) if jobs else raw_table(spark, "jobs", [{"ghjb_job_id": "999"}])
    c = raw_table(spark, "candidates", list(cands)) if cands else raw_table(spark, "candidates", [{"ghca_candidate_id": "999"}])
    return core.fact_application(staging.stg_applications(a), staging.stg_jobs(j), staging.stg_candidates(c))


def test_time_to_hire_rules(spark):
    apps = [
        {"ghap_application_id": "1", "ghap_status": "hired", "ghap_applied_at": "2024-01-01 00:00:00",
         "ghap_last_activity_at": "2024-01-05 12:00:00"},                                       # no hired_at → fallback
        {"ghap_application_id": "2", "ghap_status": "hired", "ghap_applied_at": "2024-01-10 00:00:00",
         "ghap_hired_at": "2024-01-05 00:00:00"},                                               # negative → NULL
        {"ghap_application_id": "3", "ghap_status": "hired", "ghap_applied_at": "2024-01-01 00:00:00",
         "ghap_hired_at": "2024-01-01 23:59:00"},                                               # 23h59 → 0 days
        {"ghap_application_id": "4", "ghap_status": "Hired", "ghap_applied_at": "2024-01-01 00:00:00"},
        {"ghap_application_id": "5", "ghap_status": None},
        {"ghap_application_id": "12.5x", "ghap_status": "active"},                            # bad id → dropped
    ]
    f = {r.application_id: r for r in _fact(spark, apps).collect()}
    assert set(f) == {1, 2, 3, 4, 5}
    assert f[1].hired_at == datetime(2024, 1, 5, 12) and f[1].time_to_hire_days == 4
    assert f[2].time_to_hire_days is None
    assert f[3].time_to_hire_days == 0
    for k in (4, 5):
        assert (f[k].is_active, f[k].is_rejected, f[k].is_hired) == (False, False, False)
    diag = marts.mart_tth_diagnostics(_fact(spark, apps)).collect()[0]
    assert diag.total_hired_applications == 3 and diag.hired_applications_excluded_from_avg == 1


def test_missing_job_uses_candidate_recruiter_and_unknown_labels(spark):
    apps = [{"ghap_application_id": "1", "ghap_job_id": "77", "ghap_candidate_id": "5", "ghap_status": "active"}]
    cands = [{"ghca_candidate_id": "5", "ghca_recruiter_id": "3", "ghca_recruiter_name": "R3"}]
    fact = _fact(spark, apps, cands=cands)
    row = fact.collect()[0]
    assert row.recruiter_id == 3 and row.office_id is None
    dj = core.dim_job(staging.stg_jobs(raw_table(spark, "jobs", [{"ghjb_job_id": "999"}])))
    k1 = marts.mart_status_by_scope(fact, dj).collect()[0]
    assert (k1.office_name, k1.department_name, k1.status_share) == ("Unknown office", "Unknown department", 1.0)


def test_department_name_smallest_and_recruiter_pairs(spark):
    jobs = [{"ghjb_job_id": "1", "ghjb_gh_department_id": "9", "ghjb_gh_department_name": "Sales",
             "ghjb_recruiter_id": "4", "ghjb_recruiter_name": "Ann"},
            {"ghjb_job_id": "2", "ghjb_gh_department_id": "9", "ghjb_gh_department_name": "Revenue",
             "ghjb_recruiter_id": "4", "ghjb_recruiter_name": "Anna"}]
    sj = staging.stg_jobs(raw_table(spark, "jobs", jobs))
    assert core.dim_department(sj).collect()[0].department_name == "Revenue"
    sc = staging.stg_candidates(raw_table(spark, "candidates", [{"ghca_candidate_id": "1"}]))
    rec = core.dim_recruiter(sj, sc)
    assert rec.count() == 2  # unique on (id, name), not id — the DQ unique test catches it
    from talentlake.operators import quality
    assert quality.unique(rec, ["recruiter_id"]).collect()[0].failures == 1


def test_workload_null_key_groups_get_zero_stage_metrics(spark):
    fact = spark.createDataFrame(
        [(1, None, 1, 1, 10, True, False, False), (2, 7, 1, 1, 10, True, False, False)],
        "application_id long, recruiter_id long, office_id long, department_id long, job_id long, "
        "is_active boolean, is_rejected boolean, is_hired boolean",
    )
    trans = spark.createDataFrame(
        [(None, 1, 1, True, True, 10), (7, 1, 1, True, False, 30)],
        "recruiter_id long, office_id long, department_id long, is_recruiter_owned_stage boolean, sla_met boolean, "
        "duration_hours long",
    )
    offers = spark.createDataFrame([], "offer_id long, recruiter_id long, office_id long, department_id long, is_accepted boolean")
    empty_dim = spark.createDataFrame([], "recruiter_id long, recruiter_name string")
    offices = spark.createDataFrame([], "office_id long, office_name string")
    deps = spark.createDataFrame([], "department_id long, department_name string")
    out = {r.recruiter_id: r for r in marts.mart_recruiter_workload(fact, trans, offers, empty_dim, offices, deps).collect()}
    assert out[None].recruiter_owned_stage_cases == 0 and out[None].sla_compliance_rate is None
    assert out[7].recruiter_owned_stage_cases == 1 and out[7].sla_breached_cases == 1
    assert out[None].recruiter_name == "Unknown recruiter"


def test_no_owned_transitions_compliance(spark):
    fact = spark.createDataFrame([], "application_id long, job_id long, is_active boolean, is_rejected boolean, "
                                     "is_hired boolean, time_to_hire_days long, application_source string")
    jobs = spark.createDataFrame([], "job_id long, job_status string")
    offers = spark.createDataFrame([], "is_accepted boolean")
    trans = spark.createDataFrame([(False, None)], "is_recruiter_owned_stage boolean, sla_met boolean")
    k2 = marts.mart_exec_overview(fact, jobs, offers, trans, "2026-01-01 00:00:00").collect()[0]
    assert k2.recruiter_sla_compliance_rate is None and k2.recruiter_owned_stage_cases == 0


def test_null_source_counts_as_historical(spark):
    apps = [{"ghap_application_id": "1", "ghap_status": "hired", "ghap_applied_at": "2024-01-01 00:00:00",
             "ghap_hired_at": "2024-01-03 00:00:00", "ghap_source": None},
            {"ghap_application_id": "2", "ghap_status": "hired", "ghap_applied_at": "2024-01-01 00:00:00",
             "ghap_hired_at": "2024-01-03 00:00:00", "ghap_source": "supabase_operational_source"}]
    d = marts.mart_tth_diagnostics(_fact(spark, apps)).collect()[0]
    assert d.historical_hired_applications_included == 1 and d.supabase_outcome_hired_applications_included == 1


def _ops(spark, rows):
    return spark.createDataFrame(
        rows, "application_id long, status string, current_stage string, updated_at timestamp, "
              "recruiter string, office string, department string",
    )


def test_manual_reject_with_null_stage_passes_and_is_applied(spark):
    apps = _ops(spark, [(1, "active", None, None, None, None, None), (2, "active", "Offer", None, None, None, None)])
    plan = changes.plan_reject(apps, "Manual candidate selection", 10, "because", application_ids=[1, 2], request_id="r")
    req = plan.request.collect()[0]
    assert req.error_message is None and req.selected_count == 2
    res = changes.apply_reject(changes.approve_requests(plan.request, ["r"], "a", "2026-01-01 00:00:00"), plan.items,
                               apps, "2026-01-01 00:00:00")
    assert {r.apply_status for r in res.items.collect()} == {"applied"}
    # manual hire of the same NULL-stage application is not planned (its insert filters the stage)
    hire = changes.plan_hire(apps, "Manual candidate selection", 10, "x", application_ids=[1, 2], request_id="h")
    assert [r.application_id for r in hire.items.collect()] == [2]


def test_stale_hire_item_is_skipped_and_second_apply_refused(spark):
    apps = _ops(spark, [(1, "active", "Offer", None, None, None, None), (2, "active", "Offer", None, None, None, None)])
    plan = changes.plan_hire(apps, "Offer only", 10, "go", request_id="h")
    now = "2026-01-01 00:00:00"
    approved = changes.approve_requests(plan.request, ["h"], "a", now)
    moved = apps.withColumn("status", F.when(F.col("application_id") == 2, F.lit("rejected")).otherwise(F.col("status")))
    res = changes.apply_hire(approved, plan.items, moved, now)
    items = {r.application_id: r.apply_status for r in res.items.collect()}
    assert items == {1: "applied", 2: "skipped"}
    assert res.request.collect()[0].status == "partially_applied"
    again = changes.apply_hire(res.request, res.items, res.applications, now)
    assert again.request.count() == 0  # status is no longer approved


def test_stage_plan_validation_errors(spark):
    apps = _ops(spark, [(1, "active", "Offer", None, None, None, None)])
    with pytest.raises(ValueError, match="Reason is required"):
        changes.plan_stage_change(apps, "Offer", reason=" ")
    with pytest.raises(ValueError, match="different"):
        changes.plan_stage_change(apps, "Offer", "Offer", reason="x")
    with pytest.raises(ValueError, match="backward"):
        changes.plan_stage_change(apps, "Offer", "Reference Check", reason="x")
    with pytest.raises(ValueError, match="requires at least one"):
        changes.plan_stage_change(apps, "Offer", reason="x", selection_mode="Manual application selection")


def test_stage_apply_sequence_events(spark):
    apps = _ops(spark, [(1, "active", "Application Review", None, "r", "o", "d")])
    now = "2026-01-01 00:00:00"
    plan = changes.plan_stage_change(apps, "Recruiter Interview", "Hiring Manager Review", 100, "Global impact", "x",
                                     request_id="s")
    res = changes.apply_stage_change(changes.approve_requests(plan.request, ["s"], "a", now), plan.items, apps, now)
    ev = [(r.previous_stage, r.new_stage) for r in res.stage_events.orderBy("sequence_position").collect()]
    assert ev == [("Application Review", "Recruiter Interview"), ("Recruiter Interview", "Hiring Manager Review")]
    assert res.applications.collect()[0].current_stage == "Hiring Manager Review"
    assert res.request.collect()[0].status == "applied"


def test_current_role_and_scope_counts(spark):
    from talentlake.operators import serve

    roles = spark.createDataFrame(
        [("u1", "analyst_readonly", True), ("u1", "hr_manager", True), ("u1", "super_admin", False),
         ("u2", "custom", True), ("u2", "dev_admin", True), ("u3", "analyst_readonly", False)],
        "user_id string, role string, is_active boolean",
    )
    got = {r.user_id: r.role for r in serve.current_role(roles).collect()}
    assert got == {"u1": "hr_manager", "u2": "dev_admin"}
    apps = spark.createDataFrame([("R", "", None), ("R", "", None), (None, "O", "D")],
                                 "recruiter string, office string, department string")
    got = {r.scope: r.applications for r in serve.scope_counts(apps).collect()}
    assert got == {"R / Unknown office / Unknown department": 2, "Unknown recruiter / O / D": 1}


def test_audit_and_record_status(spark):
    req = spark.createDataFrame([("r1", 3)], "request_id string, selected_count long")
    audit = changes.audit_rows(req, "create_stage_change_dry_run", "stage_change_request", "a@x", "2026-01-01 00:00:00",
                               ["selected_count"]).collect()[0]
    assert audit.object_id == "r1" and audit.payload == {"selected_count": "3"}
    results = spark.createDataFrame([("r1", "applied"), ("r1", "failed"), ("r2", "failed"), ("r3", "applied")],
                                    "request_id string, apply_status string")
    got = {r.request_id: r.status for r in changes.record_apply_status(results).collect()}
    assert got == {"r1": "partially_applied", "r2": "failed", "r3": "applied"}


def test_frozen_plan_survives_source_changes(spark):
    import tempfile

    apps = _ops(spark, [(1, "active", "Offer", None, None, None, None), (2, "active", "Offer", None, None, None, None)])
    plan = changes.freeze_plan(changes.plan_hire(apps, "Offer only", 1, "go", request_id="h"))
    chosen = [r.application_id for r in plan.items.collect()]
    assert chosen == [1]
    now = "2026-01-01 00:00:00"
    res = changes.apply_hire(changes.approve_requests(plan.request, ["h"], "a", now), plan.items, apps, now)
    paths = changes.write_applied(res, tempfile.mkdtemp(prefix="tl-apply-"), "v1")
    written = spark.read.parquet(paths["applications"])
    assert {r.application_id: r.status for r in written.collect()} == {1: "hired", 2: "active"}
    assert spark.read.parquet(paths["items"]).collect()[0].apply_status == "applied"


def test_one_application_in_two_approved_requests(spark):
    """Requests apply one after the other: the first changes the application, the second finds it changed."""
    apps = _ops(spark, [(1, "active", "Offer", None, None, None, None), (2, "active", "Offer", None, None, None, None)])
    now = "2026-01-01 00:00:00"
    plans = [changes.plan_hire(apps, "Offer only", 2, "go", request_id=f"h{k}") for k in (1, 2)]
    request = plans[0].request.unionByName(plans[1].request)
    items = plans[0].items.unionByName(plans[1].items)
    res = changes.apply_hire(changes.approve_requests(request, ["h1", "h2"], "a", now), items, apps, now)
    assert sorted((r.application_id, r.status) for r in res.applications.collect()) == [(1, "hired"), (2, "hired")]
    assert {r.request_id: r.status for r in res.request.collect()} == {"h1": "applied", "h2": "failed"}
    assert res.status_events.count() == 2

    stages = [changes.plan_stage_change(apps, s, None, 10, "Global impact", "x", request_id=f"s{k}")
              for k, s in ((1, "Recruiter Interview"), (2, "Reference Check"))]
    request = stages[0].request.unionByName(stages[1].request)
    items = stages[0].items.unionByName(stages[1].items)
    res = changes.apply_stage_change(changes.approve_requests(request, ["s1", "s2"], "a", now), items, apps, now)
    assert sorted((r.application_id, r.current_stage) for r in res.applications.collect()) == [
        (1, "Reference Check"), (2, "Reference Check")]


def test_manual_bounds_are_a_parameter(spark):
    apps = _ops(spark, [(i, "active", "Application Review", None, None, None, None) for i in range(700)])
    ids = list(range(700))
    plan = lambda **kw: changes.plan_stage_change(
        apps, "Offer", None, 10_000, "Manual application selection", "x", application_ids=ids, request_id="m", **kw)
    assert plan().items.count() == 500
    assert plan(bounds=(100, 10, 10_000)).items.count() == 700


def test_first_events_date_applications_as_all_events_do(spark):
    from talentlake.plans import ingest

    apps = spark.createDataFrame(
        [(i, 1, 1, "Offer", s, None, None, None, "2026-01-09 00:00:00") for i, s in ((1, "hired"), (2, "active"), (3, "hired"), (None, "hired"))],
        "application_id long, candidate_id long, job_id long, current_stage string, status string, applied_at string, created_at string, "
        "hired_at string, updated_at string")
    status = spark.createDataFrame(
        [(1, "HIRED", "2026-01-05"), (1, "hired", "2026-01-04"), (1, "active", "2026-01-01"), (2, "active", "2026-01-02"), (3, "hired", None),
         (None, "hired", "2026-01-01"), (3, None, "2026-01-01")], "application_id long, new_status string, changed_at string")
    stage = spark.createDataFrame([(1, "2026-01-03"), (1, "2026-01-02"), (2, None), (None, "2026-01-01")], "application_id long, changed_at string")
    hired, staged = ingest.first_events(status, stage)
    assert hired.collect() == [(1, "hired", "2026-01-04")] and staged.collect() == [(1, "2026-01-02")]
    whole = ingest.ops_to_applications(apps, status, stage, "b", "t")
    reduced = ingest.ops_to_applications(apps.select(*ingest.REINGESTED_COLUMNS), hired, staged, "b", "t")
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, reduced.collect()), key=str)
