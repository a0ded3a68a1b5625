"""Registered queries for the ingestion transforms and the change workflows.

The operational applications table is seeded from the raw tables (I4); the
workflows then plan, approve and apply over all of it. Oracles replay the
same steps in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.config import (
    DEFAULT_STAGES,
    HIRE_ELIGIBLE_STAGES,
    LATE_STAGE_PRIORITY,
    MODE_FOCUSED,
    MODE_GLOBAL,
    MODE_MANUAL_STAGE,
    REJECT_MODE_STAGES,
)
from talentlake.oracle import AS_OF, _in, case_map, long_sql, rank_sql, uuid5_sql, with_base, with_ops
from talentlake.plans import changes, ingest
from talentlake.plans.catalog import _cte_select, register
from talentlake.session import ensure_session_defaults, stored
from talentlake.sources.driver_tables import RawTables

APPROVER = "approver@example.com"
LOAD = ("batch-ops-0001", "2026-01-01 06:00:00")


def raw(spark: SparkSession, sf_dir: str) -> RawTables:
    ensure_session_defaults(spark)
    return RawTables(spark, sf_dir)


def ops_apps(spark: SparkSession, sf_dir: str, raw_apps: DataFrame | None = None) -> DataFrame:
    r = raw(spark, sf_dir)
    return ingest.seed_applications(raw_apps if raw_apps is not None else r["applications"], r["jobs"], r["candidates"], AS_OF)


def landed_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw applications written once, for queries that read them several times."""
    return stored(raw(spark, sf_dir)["applications"], "raw_applications")


def frozen_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operational table as written once; a plan and its apply both read this state."""
    return stored(ops_apps(spark, sf_dir), "ops_applications")


# -- I1, I3, I4, I5 ------------------------------------------------------------------

@register("derive_hired_at", with_base("""
SELECT ghap_application_id, ghap_status, ghap_last_activity_at,
  CASE WHEN lower(coalesce(nullif(ghap_status, ''), '')) = 'hired' THEN nullif(ghap_last_activity_at, '') END AS ghap_hired_at
FROM raw_applications"""))
def q_derive_hired_at(spark, sf_dir):
    a = raw(spark, sf_dir)["applications"].drop("ghap_hired_at")
    return ingest.derive_hired_at(a).select("ghap_application_id", "ghap_status", "ghap_last_activity_at", "ghap_hired_at")


@register("seed_applications", with_ops("SELECT * FROM ops_applications"))
def q_seed_applications(spark, sf_dir):
    return ops_apps(spark, sf_dir)


SEED_EVENTS_CTE = f"""
seed_events_base AS (
  SELECT * FROM (
    SELECT {long_sql('application_id')} AS application_id, previous_stage, current_stage AS new_stage,
      coalesce(last_activity_at, '{AS_OF}') AS changed_at_text, action, previous_status, current_status
    FROM raw_events) WHERE application_id IS NOT NULL AND coalesce(new_stage, '') <> ''
),
seed_events AS (
  SELECT {uuid5_sql("concat_ws(':', 'mock_greenhouse_seed', CAST(application_id AS VARCHAR), coalesce(previous_stage, 'None'), new_stage, changed_at_text)")} AS event_id,
    application_id, previous_stage, new_stage, 'mock_api_seed' AS changed_by_email,
    TRY_CAST(changed_at_text AS TIMESTAMP) AS changed_at, 'mock_api_seed' AS source,
    action AS mock_action, previous_status AS mock_previous_status, current_status AS mock_current_status
  FROM seed_events_base
)"""


def _seed_events(spark, sf_dir) -> DataFrame:
    return ingest.seed_stage_events(raw(spark, sf_dir)["application_events"], AS_OF)


@register("seed_stage_events", with_base("SELECT * FROM seed_events", extra_ctes=SEED_EVENTS_CTE))
def q_seed_stage_events(spark, sf_dir):
    ev = _seed_events(spark, sf_dir)
    return ev.select(
        *[c for c in ev.columns if c != "metadata"],
        F.col("metadata")["mock_action"].alias("mock_action"),
        F.col("metadata")["previous_status"].alias("mock_previous_status"),
        F.col("metadata")["current_status"].alias("mock_current_status"),
    )


@register("ops_to_events", with_base(f"""
SELECT CAST(NULL AS VARCHAR) AS organization_id, 'Operational source' AS organization_name,
  'candidate_stage_change' AS action, CAST(application_id AS VARCHAR) AS application_id,
  'active' AS previous_status, 'active' AS current_status,
  CAST(changed_at AS VARCHAR) AS last_activity_at,
  CAST(NULL AS VARCHAR) AS rejected_at, CAST(NULL AS VARCHAR) AS rejection_reason, CAST(NULL AS VARCHAR) AS rejection_details,
  previous_stage, new_stage AS current_stage,
  '{LOAD[0]}' AS _ingestion_batch_id, '{LOAD[1]}' AS _ingested_at, 'supabase_operational_source' AS _source_system,
  'application_stage_events' AS _source_object, 'operational_sync' AS _loaded_by
FROM seed_events""", extra_ctes=SEED_EVENTS_CTE))
def q_ops_to_events(spark, sf_dir):
    return ingest.ops_to_events(_seed_events(spark, sf_dir), *LOAD)


# -- F1 / F2 ----------------------------------------------------------------------------

@register("stage_rank", with_ops(f"""
SELECT application_id, current_stage, {rank_sql('current_stage', DEFAULT_STAGES.order)} AS stage_rank
FROM ops_applications"""))
def q_stage_rank(spark, sf_dir):
    a = ops_apps(spark, sf_dir)
    return a.select("application_id", "current_stage", changes.stage_rank_column("current_stage").alias("stage_rank"))


def _validation_sql() -> str:
    def r(expr: str) -> str:
        return rank_sql(expr, DEFAULT_STAGES.order)

    return f"""
, seqs AS (
  SELECT application_id, event_at, list_filter([previous_stage, current_stage], lambda x: x IS NOT NULL) AS seq
  FROM stg_events
),
errs AS (
  SELECT application_id, event_at, seq,
    list_filter(list_transform(generate_series(1, len(seq)), lambda i: (
      CASE WHEN seq[i] IN ('Hired', 'Rejected') THEN 'Hired and Rejected outcomes are excluded from this stage workflow'
           WHEN {r('seq[i]')} IS NULL THEN 'Invalid recruitment stage: ' || coalesce(seq[i], '<NULL>')
           WHEN i > 1 AND {r('seq[i]')} < {r('seq[i - 1]')} THEN 'Invalid backward recruitment stage transition: ' || seq[i]
      END)), lambda e: e IS NOT NULL) AS errors
  FROM seqs
)
SELECT application_id, event_at, seq AS stage_sequence,
  CASE WHEN seq IS NULL OR len(seq) = 0 THEN 'At least one recruitment stage is required' ELSE errors[1] END AS validation_error
FROM errs"""


@register("validate_sequence", _cte_select(_validation_sql()))
def q_validate_sequence(spark, sf_dir):
    from talentlake.plans.warehouse import Warehouse
    from talentlake.config import DRIVER_TABLE_STAGES

    w = Warehouse(raw(spark, sf_dir), DRIVER_TABLE_STAGES)
    e = w.stg_events.select(
        "application_id", "event_at",
        F.filter(F.array("previous_stage", "current_stage"), lambda x: x.isNotNull()).alias("stage_sequence"),
    )
    return e.withColumn("validation_error", changes.sequence_error("stage_sequence"))


# -- F3-F5: eligibility ------------------------------------------------------------------

@register("eligible_stage_change", with_ops("""
SELECT application_id, status, current_stage, updated_at FROM ops_applications
WHERE status = 'active' AND coalesce(current_stage, '') <> 'Hiring Manager Review'"""))
def q_eligible_stage_change(spark, sf_dir):
    a = changes.eligible_stage_change(ops_apps(spark, sf_dir), "Hiring Manager Review")
    return a.select("application_id", "status", "current_stage", "updated_at")


@register("eligible_hire", with_ops(f"""
SELECT application_id, status, current_stage, updated_at FROM ops_applications
WHERE status = 'active' AND status NOT IN ('hired', 'rejected') AND current_stage IN {_in(HIRE_ELIGIBLE_STAGES)}"""))
def q_eligible_hire(spark, sf_dir):
    a = changes.eligible_hire(ops_apps(spark, sf_dir), "Late-stage candidates")
    return a.select("application_id", "status", "current_stage", "updated_at")


@register("eligible_reject", with_ops(f"""
SELECT application_id, status, current_stage, updated_at FROM ops_applications
WHERE status = 'active' AND status NOT IN ('hired', 'rejected')
  AND current_stage IN {_in(REJECT_MODE_STAGES['Early process rejection'])}"""))
def q_eligible_reject(spark, sf_dir):
    a = changes.eligible_reject(ops_apps(spark, sf_dir), "Early process rejection")
    return a.select("application_id", "status", "current_stage", "updated_at")


# -- F6: stage-change plans ----------------------------------------------------------------

STAGE_REQUEST_COLS = """'{rid}' AS request_id, CAST(NULL AS VARCHAR) AS requested_by, '{target}' AS target_stage,
  {next_sql} AS next_stage, '{mode}' AS selection_mode, {limit} AS requested_limit, '{reason}' AS reason,
  'dry_run' AS status, 'supabase_operational_source' AS source"""


def _stage_plan_sql(rid, target, next_stage, mode, limit, reason, pool_sql, order_sql, basis_sql, check_sql=None):
    final = next_stage or target
    seq = f"['{target}'" + (f", '{next_stage}']" if next_stage else "]")
    next_sql = f"'{next_stage}'" if next_stage else "CAST(NULL AS VARCHAR)"
    eligible = f"SELECT * FROM ops_applications WHERE status = 'active' AND coalesce(current_stage, '') <> '{final}'"
    ctes = f"""
eligible AS ({eligible}),
{pool_sql},
chosen AS (SELECT * FROM pool {f'ORDER BY {order_sql} LIMIT {limit}' if limit else ''}),
plan_items AS (
  SELECT '{rid}' AS request_id, application_id, current_stage AS previous_stage, {seq} AS planned_stage_sequence,
    'pending' AS apply_status, CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS TIMESTAMP) AS applied_at
  FROM chosen),
plan_request AS (
  SELECT {STAGE_REQUEST_COLS.format(rid=rid, target=target, next_sql=next_sql, mode=mode, limit=limit or 'CAST(NULL AS INTEGER)', reason=reason)},
    (SELECT count(*) FROM ({basis_sql})) AS eligible_count,
    (SELECT count(*) FROM plan_items) AS selected_count,
    {check_sql or 'CAST(NULL AS VARCHAR)'} AS error_message
)"""
    return ctes


def _focused_pool() -> str:
    return """groups AS (SELECT recruiter, office, department, count(*) AS group_count FROM eligible GROUP BY ALL),
top_group AS (SELECT * FROM groups ORDER BY group_count DESC NULLS LAST, recruiter ASC NULLS LAST,
  office ASC NULLS LAST, department ASC NULLS LAST LIMIT 1),
pool AS (SELECT e.* FROM eligible e JOIN top_group g ON coalesce(e.recruiter, '') = coalesce(g.recruiter, '')
  AND coalesce(e.office, '') = coalesce(g.office, '') AND coalesce(e.department, '') = coalesce(g.department, ''))"""


FOCUSED = dict(rid="req-stage-focused", target="Hiring Manager Review", next_stage="Hiring Manager Interview",
               mode=MODE_FOCUSED, limit=50, reason="Hiring manager capacity freed")
GLOBAL = dict(rid="req-stage-global", target="Offer", next_stage=None, mode=MODE_GLOBAL, limit=20,
              reason="Quarter-end push")
MANUAL = dict(rid="req-stage-manual", target="Hiring Manager Review", next_stage=None, mode=MODE_MANUAL_STAGE,
              limit=None, reason="Selected from search")  # every selected id is planned
# Manual selection ids: the applications a recruiter found by searching the
# candidate name for a segment, restricted to those waiting in Recruiter Interview.
MANUAL_SEARCH = "machinery"
MANUAL_STAGE_FROM = "Recruiter Interview"

FOCUSED_SQL = _stage_plan_sql(**FOCUSED, pool_sql=_focused_pool(),
                              order_sql="updated_at DESC NULLS FIRST, application_id ASC", basis_sql="SELECT * FROM eligible")
GLOBAL_SQL = _stage_plan_sql(**GLOBAL, pool_sql="pool AS (SELECT * FROM eligible)",
                             order_sql="updated_at DESC NULLS FIRST, application_id ASC", basis_sql="SELECT * FROM eligible")
MANUAL_IDS_SQL = f"""manual_ids AS (SELECT DISTINCT application_id FROM ops_applications
  WHERE contains(lower(coalesce(candidate_full_name, '')), '{MANUAL_SEARCH}') AND status = 'active'
    AND current_stage = '{MANUAL_STAGE_FROM}')"""
MANUAL_SQL = MANUAL_IDS_SQL + ",\n" + _stage_plan_sql(
    **MANUAL,
    pool_sql="pool AS (SELECT e.* FROM eligible e WHERE e.application_id IN (SELECT application_id FROM manual_ids))",
    order_sql="updated_at ASC NULLS LAST, application_id ASC",
    basis_sql="SELECT * FROM manual_ids",
    check_sql=f"""CASE WHEN (SELECT count(*) FROM manual_ids m LEFT JOIN ops_applications a USING (application_id)
      WHERE a.status IS NULL OR a.status <> 'active' OR coalesce(a.current_stage, '') = '{MANUAL['target']}') > 0
      THEN 'Manual application selection contains ineligible application IDs' END""",
).strip()


def _manual_ids(apps: DataFrame) -> DataFrame:
    return apps.filter(
        F.lower(F.coalesce(F.col("candidate_full_name"), F.lit(""))).contains(MANUAL_SEARCH)
        & (F.col("status") == "active")
        & (F.col("current_stage") == MANUAL_STAGE_FROM)
    ).select("application_id")


def _plan(spark, sf_dir, spec) -> changes.Plan:
    apps = ops_apps(spark, sf_dir)
    ids = _manual_ids(apps) if spec["mode"] == MODE_MANUAL_STAGE else None
    return changes.plan_stage_change(apps, spec["target"], spec["next_stage"], spec["limit"], spec["mode"],
                                     spec["reason"], application_ids=ids, request_id=spec["rid"],
                                     bounds=(100, 10, 500) if spec["limit"] else (None, 10, None))


for _name, _spec, _sql in [("focused", FOCUSED, FOCUSED_SQL), ("global", GLOBAL, GLOBAL_SQL), ("manual", MANUAL, MANUAL_SQL)]:
    register(f"plan_stage_change_{_name}", with_ops("SELECT * FROM plan_items", _sql))(
        (lambda s: lambda spark, sf_dir: _plan(spark, sf_dir, s).items)(_spec))
    register(f"plan_stage_change_{_name}_request", with_ops("SELECT * FROM plan_request", _sql))(
        (lambda s: lambda spark, sf_dir: _plan(spark, sf_dir, s).request)(_spec))


# -- F8 / F9: outcome plans -----------------------------------------------------------------

def _prio_sql() -> str:
    return case_map("current_stage", LATE_STAGE_PRIORITY, "0")


def _outcome_plan_sql(prefix, rid, outcome, mode, stages, limit, reason, source) -> str:
    return f"""
{prefix}_eligible AS (SELECT * FROM ops_applications WHERE status = 'active' AND status NOT IN ('hired', 'rejected')
  AND current_stage IN {_in(stages)}),
{prefix}_items AS (
  SELECT '{rid}' AS request_id, application_id, status AS previous_status, current_stage AS previous_stage,
    '{outcome}' AS planned_outcome, 'pending' AS apply_status, CAST(NULL AS VARCHAR) AS error_message,
    CAST(NULL AS TIMESTAMP) AS applied_at
  FROM {prefix}_eligible ORDER BY {_prio_sql()} DESC, updated_at ASC NULLS LAST, application_id ASC LIMIT {limit}),
{prefix}_request AS (
  SELECT '{rid}' AS request_id, CAST(NULL AS VARCHAR) AS requested_by, '{outcome}' AS outcome, '{mode}' AS selection_mode,
    {limit} AS requested_limit, '{reason}' AS reason, 'dry_run' AS status, '{source}' AS source,
    (SELECT count(*) FROM {prefix}_eligible) AS eligible_count, (SELECT count(*) FROM {prefix}_items) AS selected_count,
    CAST(NULL AS VARCHAR) AS error_message)"""


HIRE = dict(rid="req-hire-1", outcome="hired", mode="Late-stage candidates", stages=HIRE_ELIGIBLE_STAGES, limit=10,
            reason="Offers accepted", source=changes.HIRE_REQUEST_SOURCE)
REJECT = dict(rid="req-reject-1", outcome="rejected", mode="Late-stage rejection",
              stages=REJECT_MODE_STAGES["Late-stage rejection"], limit=5, reason="Position filled",
              source=changes.REJECT_REQUEST_SOURCE)
HIRE_SQL = _outcome_plan_sql("hire", **HIRE)
REJECT_SQL = _outcome_plan_sql("reject", **REJECT)


def _plan_hire(apps):
    return changes.plan_hire(apps, HIRE["mode"], HIRE["limit"], HIRE["reason"], request_id=HIRE["rid"])


def _plan_reject(apps):
    return changes.plan_reject(apps, REJECT["mode"], REJECT["limit"], REJECT["reason"], request_id=REJECT["rid"])


register("plan_hire", with_ops("SELECT * FROM hire_items", HIRE_SQL))(lambda spark, sf_dir: _plan_hire(ops_apps(spark, sf_dir)).items)
register("plan_hire_request", with_ops("SELECT * FROM hire_request", HIRE_SQL))(
    lambda spark, sf_dir: _plan_hire(ops_apps(spark, sf_dir)).request)
register("plan_reject", with_ops("SELECT * FROM reject_items", REJECT_SQL))(
    lambda spark, sf_dir: _plan_reject(ops_apps(spark, sf_dir)).items)
register("plan_reject_request", with_ops("SELECT * FROM reject_request", REJECT_SQL))(
    lambda spark, sf_dir: _plan_reject(ops_apps(spark, sf_dir)).request)


# -- F10: approve ---------------------------------------------------------------------------------

@register("approve_request", with_ops(f"""
SELECT r.* EXCLUDE (status), 'approved' AS status, '{APPROVER}' AS approved_by,
  TIMESTAMP '{AS_OF}' AS approved_at, CAST(NULL AS VARCHAR) AS approval_error
FROM hire_request r""", HIRE_SQL))
def q_approve_request(spark, sf_dir):
    p = _plan_hire(ops_apps(spark, sf_dir))
    return changes.approve_requests(p.request, [HIRE["rid"]], APPROVER, AS_OF)


# -- F11: apply a stage change ------------------------------------------------------------------------

@register("apply_stage_change", with_ops(f"""
SELECT i.application_id,
  CASE WHEN u.pos = 1 THEN i.previous_stage ELSE i.planned_stage_sequence[u.pos - 1] END AS previous_stage,
  u.new_stage, '{APPROVER}' AS changed_by_email, TIMESTAMP '{AS_OF}' AS changed_at,
  'supabase_admin_workflow' AS source, i.request_id,
  i.request_id || ':' || CAST(i.application_id AS VARCHAR) || ':' || u.new_stage AS idempotency_key,
  CAST(u.pos - 1 AS INTEGER) AS sequence_position
FROM plan_items i,
  LATERAL (SELECT unnest(i.planned_stage_sequence) AS new_stage, unnest(generate_series(1, len(i.planned_stage_sequence))) AS pos) u
""", FOCUSED_SQL))
def q_apply_stage_change(spark, sf_dir):
    apps = frozen_apps(spark, sf_dir)
    p = changes.freeze_plan(changes.plan_stage_change(
        apps, FOCUSED["target"], FOCUSED["next_stage"], FOCUSED["limit"], FOCUSED["mode"], FOCUSED["reason"],
        request_id=FOCUSED["rid"]))
    approved = changes.approve_requests(p.request, [FOCUSED["rid"]], APPROVER, AS_OF)
    res = changes.apply_stage_change(approved, p.items, apps, AS_OF, changed_by=APPROVER)
    ev = res.stage_events
    return ev.select(
        *[c for c in ev.columns if c != "metadata"], F.col("metadata")["idempotency_key"].alias("idempotency_key")
    )


# -- F12 / F13: reject first, then hire against the changed applications ------------------------------------

def _reject_then_hire(spark, sf_dir):
    apps = frozen_apps(spark, sf_dir)
    rj = changes.freeze_plan(_plan_reject(apps))
    rj_res = changes.apply_reject(changes.approve_requests(rj.request, [REJECT["rid"]], APPROVER, AS_OF),
                                  rj.items, apps, AS_OF, changed_by=APPROVER)
    h = changes.freeze_plan(_plan_hire(apps))
    h_res = changes.apply_hire(changes.approve_requests(h.request, [HIRE["rid"]], APPROVER, AS_OF),
                               h.items, rj_res.applications, AS_OF, changed_by=APPROVER)
    return rj_res, h_res


APPLY_SQL = HIRE_SQL + "," + REJECT_SQL + f""",
reject_done AS (
  SELECT r.*, (a.status = 'active') AS applies FROM reject_items r JOIN ops_applications a USING (application_id)),
apps_after_reject AS (
  SELECT a.* REPLACE (CASE WHEN d.applies THEN 'rejected' ELSE a.status END AS status,
                      CASE WHEN d.applies THEN TIMESTAMP '{AS_OF}' ELSE a.updated_at END AS updated_at)
  FROM ops_applications a LEFT JOIN reject_done d USING (application_id)),
hire_done AS (
  SELECT h.*, coalesce(a.status = 'active' AND a.current_stage IN {_in(HIRE_ELIGIBLE_STAGES)}, false) AS applies
  FROM hire_items h LEFT JOIN apps_after_reject a USING (application_id))"""


@register("apply_hire", with_ops("""
SELECT request_id, application_id, previous_status, previous_stage, planned_outcome,
  CASE WHEN applies THEN 'applied' ELSE 'skipped' END AS apply_status,
  CASE WHEN applies THEN NULL ELSE 'Application is no longer eligible for hiring outcome' END AS error_message,
  TIMESTAMP '""" + AS_OF + """' AS applied_at
FROM hire_done""", APPLY_SQL))
def q_apply_hire(spark, sf_dir):
    return _reject_then_hire(spark, sf_dir)[1].items


@register("apply_hire_request", with_ops(f"""
SELECT r.* EXCLUDE (status), '{APPROVER}' AS approved_by, TIMESTAMP '{AS_OF}' AS approved_at,
  CAST(NULL AS VARCHAR) AS approval_error,
  (SELECT count(*) FILTER (WHERE applies) FROM hire_done) AS applied_count,
  (SELECT count(*) FILTER (WHERE NOT applies) FROM hire_done) AS skipped_count,
  CAST(0 AS BIGINT) AS failed_count,
  CASE WHEN (SELECT count(*) FILTER (WHERE NOT applies) FROM hire_done) = 0 THEN 'applied'
       WHEN (SELECT count(*) FILTER (WHERE applies) FROM hire_done) > 0 THEN 'partially_applied' ELSE 'failed' END AS status,
  TIMESTAMP '{AS_OF}' AS applied_at
FROM hire_request r""", APPLY_SQL))
def q_apply_hire_request(spark, sf_dir):
    return _reject_then_hire(spark, sf_dir)[1].request


@register("apply_reject", with_ops(f"""
SELECT application_id, previous_status, 'rejected' AS new_status, '{APPROVER}' AS changed_by_email,
  TIMESTAMP '{AS_OF}' AS changed_at, 'supabase_admin_workflow' AS source, request_id,
  previous_stage AS meta_previous_stage, 'rejection_outcome' AS meta_workflow,
  '{REJECT["reason"]}' AS meta_rejection_reason, '{REJECT["mode"]}' AS meta_selection_mode
FROM reject_done WHERE applies""", APPLY_SQL))
def q_apply_reject(spark, sf_dir):
    ev = _reject_then_hire(spark, sf_dir)[0].status_events
    m = F.col("metadata")
    return ev.select(
        *[c for c in ev.columns if c != "metadata"],
        m["previous_stage"].alias("meta_previous_stage"), m["workflow"].alias("meta_workflow"),
        m["rejection_reason"].alias("meta_rejection_reason"), m["selection_mode"].alias("meta_selection_mode"),
    )


@register("apply_outcome_status_mix", with_ops("""
SELECT a.status, count(*) AS applications FROM (
  SELECT a.* REPLACE (CASE WHEN h.applies THEN 'hired' ELSE a.status END AS status)
  FROM apps_after_reject a LEFT JOIN hire_done h USING (application_id)) a
GROUP BY a.status""", APPLY_SQL))
def q_apply_outcome_status_mix(spark, sf_dir):
    """Status counts after the two applies: hired +k, active −(k + rejected)."""
    apps = _reject_then_hire(spark, sf_dir)[1].applications
    return apps.groupBy("status").agg(F.count(F.lit(1)).alias("applications"))


# -- I2: re-ingest the operational state --------------------------------------------------------------
# Rejected applications arrive without their dates, so their first stage event dates them.

REINGEST_CTE = f"""
{HIRE_SQL},
{SEED_EVENTS_CTE.strip()},
hired_now AS (SELECT application_id FROM hire_items),
live AS (
  SELECT a.* REPLACE (CASE WHEN a.status = 'rejected' THEN NULL ELSE a.applied_at END AS applied_at,
                      CASE WHEN a.status = 'rejected' THEN NULL ELSE a.created_at END AS created_at)
  FROM ops_applications a),
live_after AS (
  SELECT a.* REPLACE ('hired' AS status, 'Offer' AS current_stage, TIMESTAMP '{AS_OF}' AS hired_at, TIMESTAMP '{AS_OF}' AS updated_at)
  FROM live a WHERE application_id IN (SELECT * FROM hired_now)
  UNION ALL
  SELECT * FROM live WHERE application_id NOT IN (SELECT * FROM hired_now)),
staged AS (
  SELECT application_id, min(CAST(changed_at AS VARCHAR)) AS staged_at FROM (
    SELECT application_id, changed_at FROM seed_events
    UNION ALL SELECT application_id, TIMESTAMP '{AS_OF}' FROM hired_now) GROUP BY application_id)"""


def _reingest_sql(table: str, batch: tuple[str, str]) -> str:
    return f"""
SELECT CAST(application_id AS VARCHAR) AS ghap_application_id, CAST(candidate_id AS VARCHAR) AS ghap_candidate_id,
  CAST(job_id AS VARCHAR) AS ghap_job_id,
  CASE WHEN applied_at IS NOT NULL THEN CAST(applied_at AS VARCHAR)
       WHEN created_at IS NOT NULL THEN CAST(created_at AS VARCHAR)
       ELSE (SELECT staged_at FROM staged s WHERE s.application_id = {table}.application_id) END AS ghap_applied_at,
  CAST(NULL AS VARCHAR) AS ghap_rejected_at,
  CAST(if(lower(status) = 'hired' AND hired_at IS NOT NULL, hired_at, updated_at) AS VARCHAR) AS ghap_last_activity_at,
  CAST(if(hired_at IS NULL AND lower(status) = 'hired', updated_at, hired_at) AS VARCHAR) AS ghap_hired_at,
  'supabase_operational_source' AS ghap_source, CAST(NULL AS VARCHAR) AS ghap_rejection_reason,
  status AS ghap_status, current_stage AS ghap_application_current_stage, CAST(NULL AS VARCHAR) AS ghap_jobs_count,
  '{batch[0]}' AS _ingestion_batch_id, '{batch[1]}' AS _ingested_at, 'supabase_operational_source' AS _source_system,
  'applications' AS _source_object, 'operational_sync' AS _loaded_by
FROM {table}"""


def _undated(apps: DataFrame) -> DataFrame:
    """Rejected applications without their dates."""
    rejected = F.col("status") == "rejected"
    return apps.withColumns({c: F.when(~F.coalesce(rejected, F.lit(False)), F.col(c)) for c in ("applied_at", "created_at")})


def _hired_state(spark, sf_dir, raw_apps: DataFrame | None = None):
    """Operational table (what a hire and both loads read of it) before and after a hire, and the first of its events."""
    apps = stored(_undated(ops_apps(spark, sf_dir, raw_apps)).select(*ingest.REINGESTED_COLUMNS), "ops_applications")
    h = changes.freeze_plan(_plan_hire(apps))
    res = changes.apply_hire(changes.approve_requests(h.request, [HIRE["rid"]], APPROVER, AS_OF), h.items, apps, AS_OF)
    cols = ("application_id", "changed_at")
    stages = _seed_events(spark, sf_dir).select(*cols).unionByName(res.stage_events.select(*cols))
    hired, staged = ingest.first_events(res.status_events, stages)
    return apps, res.applications, stored(hired, "first_hired"), stored(staged, "first_staged")


@register("ops_to_applications", with_ops(_reingest_sql("live_after", LOAD), REINGEST_CTE))
def q_ops_to_applications(spark, sf_dir):
    _, apps, status_events, stage_events = _hired_state(spark, sf_dir)
    return ingest.ops_to_applications(apps, status_events, stage_events, *LOAD)


# -- F17: commands → webhook events -----------------------------------------------------------------

COMMAND_NEXT_STAGE = {"Recruiter Interview": "Hiring Manager Review", "Final Interview": "Reference Check",
                      "Reference Check": "Offer"}


def _commands(apps: DataFrame) -> DataFrame:
    """Per active application: hire at Offer, reject at Application Review, else advance (without a
    target where no next stage is set), then reject a day later. Those at Offer are also hired under
    an unknown id."""
    stage = F.col("current_stage")
    active = apps.filter(F.col("status") == "active")
    issued = F.lit(AS_OF).cast("timestamp")
    first = active.select(
        "application_id",
        F.when(stage == "Offer", F.lit("hire")).when(stage == "Application Review", F.lit("reject"))
        .otherwise(F.lit("stage_change")).alias("command"),
        case_col(stage, COMMAND_NEXT_STAGE).alias("new_stage"),
        F.lit("active").alias("current_status"),
        F.when(stage == "Application Review", F.lit("Not a fit")).alias("reason"),
        issued.alias("issued_at"),
    )
    nothing = F.lit(None).cast("string")
    second = active.select(
        "application_id", F.lit("reject").alias("command"), nothing.alias("new_stage"),
        F.lit("active").alias("current_status"), F.lit("Position closed").alias("reason"),
        (issued + F.expr("INTERVAL 1 DAY")).alias("issued_at"),
    )
    unknown = active.filter(stage == "Offer").select(
        (-F.col("application_id") - 1).alias("application_id"), F.lit("hire").alias("command"),
        nothing.alias("new_stage"), F.lit("active").alias("current_status"), nothing.alias("reason"),
        issued.alias("issued_at"),
    )
    return first.unionByName(second).unionByName(unknown)


def case_col(col, mapping):
    from talentlake.functions.scalar import lookup

    return lookup(col, mapping)


@register("events_from_commands", with_ops(f"""
SELECT CAST(7000001 AS BIGINT) AS organization_id, command,
  CASE WHEN error IS NULL THEN CASE command WHEN 'stage_change' THEN 'candidate_stage_change'
    WHEN 'reject' THEN 'reject_candidate' ELSE 'hire_candidate' END END AS action,
  application_id,
  CASE WHEN error IS NULL THEN CASE WHEN step = 2 AND first_error IS NULL THEN first_status ELSE start_status END END AS previous_status,
  CASE WHEN error IS NULL THEN result_status END AS current_status,
  issued_at AS last_activity_at,
  CASE WHEN error IS NULL AND command = 'reject' THEN issued_at END AS rejected_at,
  CASE WHEN error IS NULL AND command = 'reject' THEN reason END AS rejection_reason,
  CAST(NULL AS VARCHAR) AS rejection_details,
  CASE WHEN error IS NULL THEN coalesce(moved, start_stage) END AS previous_stage,
  CASE WHEN error IS NULL THEN CASE WHEN command = 'stage_change' THEN new_stage ELSE coalesce(moved, start_stage) END END AS current_stage,
  error AS error_message
FROM judged""", f"""
active_apps AS (SELECT application_id, current_stage FROM ops_applications WHERE status = 'active'),
cmds AS (
  SELECT application_id, 1 AS step,
    CASE current_stage WHEN 'Offer' THEN 'hire' WHEN 'Application Review' THEN 'reject' ELSE 'stage_change' END AS command,
    {case_map('current_stage', COMMAND_NEXT_STAGE)} AS new_stage,
    CASE WHEN current_stage = 'Application Review' THEN 'Not a fit' END AS reason, TIMESTAMP '{AS_OF}' AS issued_at
  FROM active_apps
  UNION ALL
  SELECT application_id, 2, 'reject', NULL, 'Position closed', TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY FROM active_apps
  UNION ALL
  SELECT -application_id - 1, 1, 'hire', NULL, NULL, TIMESTAMP '{AS_OF}' FROM active_apps WHERE current_stage = 'Offer'),
starts AS (
  SELECT {long_sql('application_id')} AS application_id, current_stage AS start_stage, current_status AS start_status,
    0 AS origin, coalesce(last_activity_at, '') AS t, _ingested_at AS loaded, _ingestion_batch_id AS batch
  FROM raw_events
  UNION ALL
  SELECT {long_sql('ghap_application_id')}, ghap_application_current_stage, ghap_status, 1, '', NULL, NULL
  FROM raw_applications
  QUALIFY row_number() OVER (PARTITION BY {long_sql('ghap_application_id')}) = 1),
start AS (
  SELECT * FROM starts
  QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY origin, t DESC, loaded DESC NULLS LAST, batch DESC NULLS LAST,
    start_stage DESC NULLS LAST, start_status DESC NULLS LAST) = 1),
checked AS (
  SELECT c.*, s.start_stage, s.start_status,
    CASE c.command WHEN 'stage_change' THEN 'active' WHEN 'reject' THEN 'rejected' ELSE 'hired' END AS result_status,
    CASE WHEN s.application_id IS NULL THEN 'Application not found'
         WHEN c.command = 'stage_change' AND c.new_stage IS NULL THEN 'Stage change requires new_stage or current_stage.' END AS error
  FROM cmds c LEFT JOIN start s ON s.application_id = c.application_id),
judged AS (
  SELECT b.*, a.error AS first_error, a.result_status AS first_status,
    CASE WHEN b.step = 2 AND a.error IS NULL AND a.command = 'stage_change' THEN a.new_stage END AS moved
  FROM checked b LEFT JOIN checked a ON a.application_id = b.application_id AND a.step = 1 AND b.step = 2)"""))
def q_events_from_commands(spark, sf_dir):
    r = raw(spark, sf_dir)
    commands = _commands(ops_apps(spark, sf_dir))
    out = changes.events_from_commands(commands, r["application_events"], r["applications"], 7000001)
    return out


# -- S10/S11: merge re-ingested operational rows into the raw applications table -----------------------
# The raw table was landed before the rejected applications came in, so those keys are new. The table is
# re-ingested twice, before and after a hire; the later load wins.

UPSERT_COLUMNS = ("ghap_status", "ghap_application_current_stage", "ghap_hired_at", "ghap_last_activity_at",
                  "ghap_applied_at")
EARLIER_LOAD = ("batch-ops-0000", "2025-12-31 06:00:00")


@register("upsert_applications", with_ops(f"""
SELECT e.* REPLACE ({", ".join(f"i.{c} AS {c}" for c in UPSERT_COLUMNS)})
FROM landed e JOIN incoming i USING (ghap_application_id)
UNION ALL
SELECT * FROM landed e WHERE NOT EXISTS (FROM incoming i WHERE i.ghap_application_id = e.ghap_application_id)
UNION ALL BY NAME
SELECT i.ghap_application_id, {", ".join(f"i.{c}" for c in UPSERT_COLUMNS)}
FROM incoming i WHERE NOT EXISTS (FROM landed e WHERE i.ghap_application_id = e.ghap_application_id)""",
    REINGEST_CTE + f""",
landed AS (SELECT * FROM raw_applications WHERE coalesce(ghap_status, '') <> 'rejected'),
incoming AS ({_reingest_sql("live_after", LOAD)})"""))
def q_upsert_applications(spark, sf_dir):
    """Both re-ingested loads merged into the raw applications as they were landed."""
    from talentlake.sources.raw import upsert

    landed = landed_applications(spark, sf_dir)
    before, after, status_events, stage_events = _hired_state(spark, sf_dir, landed)
    incoming = ingest.ops_to_applications(before, status_events, stage_events, *EARLIER_LOAD).unionByName(
        ingest.ops_to_applications(after, status_events, stage_events, *LOAD))
    landed = landed.filter(F.coalesce(F.col("ghap_status"), F.lit("")) != "rejected")
    return upsert(landed, incoming, ["ghap_application_id"], columns=list(UPSERT_COLUMNS),
                  incoming_order=[F.col("_ingested_at")])
