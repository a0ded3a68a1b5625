"""Independent ANSI-SQL (DuckDB) formulations used as correctness oracles.

``BASE_CTES`` re-derives the raw tables from the driver tables with the same
rules as ``sources.driver_tables`` and computes the models from their formulas
by other means than the Spark plans: numbered events joined with the one
before, dimensions as groups, marts as filtered counts of long tables.

Engine-parity rules: text → bigint casts accept only an integer literal
(Spark's ``try_cast``); whole-unit differences use ``date_sub``; averages are
``sum / count`` in double; every window has a complete order with explicit
NULL placement.
"""

from __future__ import annotations

from talentlake.config import DRIVER_TABLE_STAGES, OPERATIONAL_SOURCE_MARKER, StageConfig

AS_OF = "2026-01-01 00:00:00"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {v if not isinstance(v, str) else _q(v)}" for k, v in mapping.items())
    return f"(CASE {col} {whens} ELSE {default} END)"


def rank_sql(col: str, order, default: str = "NULL") -> str:
    return case_map(col, {s: i + 1 for i, s in enumerate(order)}, default)


def long_sql(col: str) -> str:
    return f"(CASE WHEN regexp_full_match({col}, '[+-]?[0-9]+') THEN TRY_CAST({col} AS BIGINT) END)"


def ts_sql(col: str) -> str:
    return f"TRY_CAST({col} AS TIMESTAMP)"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def base_ctes(stages: StageConfig = DRIVER_TABLE_STAGES) -> str:
    owned = _in(stages.owned)
    sla = "(CASE e.previous_stage " + " ".join(
        f"WHEN {_q(k)} THEN CAST({float(v)} AS DOUBLE)" for k, v in stages.sla_days.items()
    ) + " ELSE NULL END)"
    rank_prev = rank_sql("previous_stage", stages.order)
    rank_cur = rank_sql("current_stage", stages.order)
    event_stage = case_map("event_type", {
        "signup": "Application Review", "view": "Recruiter Interview", "click": "Hiring Manager Review",
        "error": "Reference Check", "purchase": "Offer",
    })
    prio_stage = case_map("o_orderpriority", {
        "1-URGENT": "Offer", "2-HIGH": "Reference Check", "3-MEDIUM": "Final Interview",
        "4-NOT SPECIFIED": "Recruiter Interview", "5-LOW": "Application Review",
    })
    meta1 = "'batch-0001' AS _ingestion_batch_id, '2024-02-01 00:00:00' AS _ingested_at, 'greenhouse' AS _source_system"
    marker = _q(OPERATIONAL_SOURCE_MARKER)
    return f"""
raw_jobs AS (
  SELECT
    CAST(s_suppkey AS VARCHAR) AS ghjb_job_id,
    s_name AS ghjb_job_name,
    CAST(s_suppkey + 100000 AS VARCHAR) AS ghjb_requisition_id,
    CASE WHEN s_acctbal < 0 THEN 'closed' ELSE 'open' END AS ghjb_job_status,
    CAST(TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(s_suppkey AS BIGINT)) AS VARCHAR) AS ghjb_created_at,
    CAST(TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(s_suppkey AS BIGINT)) + to_days(1) AS VARCHAR) AS ghjb_opened_at,
    CASE WHEN s_acctbal < 0 THEN CAST(TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(s_suppkey AS BIGINT)) + to_days(60) AS VARCHAR) END AS ghjb_closed_at,
    CAST(s_suppkey % 5 AS VARCHAR) AS ghjb_gh_department_id,
    r_name AS ghjb_gh_department_name,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS ghjb_gh_office_id,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE n_name END AS ghjb_gh_office_name,
    CAST(s_nationkey + 500 AS VARCHAR) AS ghjb_hiring_manager_id,
    'Manager ' || CAST(s_nationkey AS VARCHAR) AS ghjb_hiring_manager_name,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 18 AS VARCHAR) END AS ghjb_recruiter_id,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'Recruiter ' || CAST(s_suppkey % 18 AS VARCHAR) END AS ghjb_recruiter_name,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Contract' ELSE 'Full-time' END AS ghjb_employment_type,
    r_name AS ghjb_budget_owner,
    'Executive ' || CAST(s_suppkey % 5 AS VARCHAR) AS ghjb_executive,
    CASE WHEN s_suppkey % 23 = 0 THEN '12.5x' WHEN s_suppkey % 9 = 0 THEN '0.5' ELSE '1.0' END AS ghjb_fte,
    'Permanent' AS ghjb_job_type,
    {meta1}, 'jobs' AS _source_object, 'api_sync' AS _loaded_by
  FROM supplier
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON s_suppkey % 5 = r_regionkey
),
raw_candidates AS (
  SELECT
    CAST(c_custkey AS VARCHAR) AS ghca_candidate_id,
    c_mktsegment AS ghca_first_name,
    c_name AS ghca_last_name,
    CAST(TIMESTAMP '2019-01-01 00:00:00' + to_minutes(CAST(c_custkey AS BIGINT)) AS VARCHAR) AS ghca_created_at,
    CAST(TIMESTAMP '2019-01-01 00:00:00' + to_minutes(CAST(c_custkey AS BIGINT)) + to_days(1) AS VARCHAR) AS ghca_updated_at,
    CAST(NULL AS VARCHAR) AS ghca_status,
    CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey % 18 AS VARCHAR) END AS ghca_recruiter_id,
    CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'Recruiter ' || CAST(c_nationkey % 18 AS VARCHAR) END AS ghca_recruiter_name,
    CAST(NULL AS VARCHAR) AS ghca_application_id,
    {meta1}, 'candidates' AS _source_object, 'api_sync' AS _loaded_by
  FROM customer
),
first_supplier AS (
  SELECT l_orderkey, min(l_suppkey) AS first_suppkey FROM lineitem GROUP BY l_orderkey
),
raw_applications AS (
  SELECT
    CAST(o_orderkey AS VARCHAR) AS ghap_application_id,
    CAST(o_custkey AS VARCHAR) AS ghap_candidate_id,
    CAST(o_orderdate AS VARCHAR) AS ghap_applied_at,
    CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate + to_days(10) AS VARCHAR) END AS ghap_rejected_at,
    CAST(o_orderdate + to_days(CAST(o_orderkey % 53 AS INTEGER)) + to_hours(CAST(o_orderkey % 23 AS BIGINT)) AS VARCHAR) AS ghap_last_activity_at,
    CASE o_orderkey % 4 WHEN 0 THEN {marker} WHEN 1 THEN NULL WHEN 2 THEN 'Referral' ELSE 'LinkedIn' END AS ghap_source,
    CASE WHEN o_orderstatus = 'P' THEN 'Not a fit' END AS ghap_rejection_reason,
    CAST(first_suppkey AS VARCHAR) AS ghap_job_id,
    {case_map('o_orderstatus', {'O': 'active', 'F': 'hired', 'P': 'rejected'})} AS ghap_status,
    {prio_stage} AS ghap_application_current_stage,
    CASE WHEN o_orderkey % 13 = 0 THEN '12.5x' WHEN o_orderkey % 17 = 0 THEN '123.0' ELSE '1' END AS ghap_jobs_count,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate + to_days(CAST(o_orderkey % 97 - 5 AS INTEGER)) AS VARCHAR) END AS ghap_hired_at,
    {meta1}, 'applications' AS _source_object, 'api_sync' AS _loaded_by
  FROM orders LEFT JOIN first_supplier ON o_orderkey = l_orderkey
),
raw_offers AS (
  SELECT
    CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS ghof_offer_id,
    CAST(l_orderkey AS VARCHAR) AS ghof_application_id,
    {case_map('l_returnflag', {'A': 'accepted', 'R': 'rejected', 'N': 'sent'})} AS ghof_status,
    CAST(l_shipdate AS VARCHAR) AS ghof_created_at,
    CAST(l_shipdate + to_days(1) AS VARCHAR) AS ghof_updated_at,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate + to_days(3) AS VARCHAR) END AS ghof_resolved_at,
    CAST(l_shipdate + to_days(30) AS VARCHAR) AS ghof_starts_at,
    {meta1}, 'offers' AS _source_object, 'api_sync' AS _loaded_by
  FROM lineitem
),
raw_openings AS (
  SELECT
    CAST(p_partkey AS VARCHAR) AS ghop_id,
    '10000-' || CAST(p_partkey AS VARCHAR) AS ghop_opening_id,
    CASE WHEN p_size > 25 THEN 'closed' ELSE 'open' END AS ghop_status,
    CAST(TIMESTAMP '2021-01-01 00:00:00' + to_hours(CAST(p_partkey AS BIGINT)) AS VARCHAR) AS ghop_opened_at,
    CASE WHEN p_size > 25 THEN CAST(TIMESTAMP '2021-01-01 00:00:00' + to_hours(CAST(p_partkey AS BIGINT)) + to_days(30) AS VARCHAR) END AS ghop_closed_at,
    CAST(NULL AS VARCHAR) AS ghop_application_id,
    CASE WHEN p_size > 25 THEN 'Hire - New Headcount' END AS ghop_close_reason_name,
    p_brand AS ghop_priority,
    p_type AS ghop_additional_hire_replacement,
    CAST(p_partkey % 100 AS VARCHAR) AS ghop_job_id,
    {meta1}, 'openings' AS _source_object, 'api_sync' AS _loaded_by
  FROM part
),
event_base AS (
  SELECT event_id, ts, user_id, {event_stage} AS stage,
    lag({event_stage}) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS FIRST, event_id ASC NULLS FIRST) AS prev_stage
  FROM events
),
raw_events AS (
  SELECT '7000001' AS organization_id, 'Acme Talent' AS organization_name, 'candidate_stage_change' AS action,
    CAST(user_id AS VARCHAR) AS application_id,
    CASE WHEN prev_stage IS NULL THEN NULL ELSE 'active' END AS previous_status, 'active' AS current_status,
    CAST(ts AS VARCHAR) AS last_activity_at, CAST(NULL AS VARCHAR) AS rejected_at,
    CAST(NULL AS VARCHAR) AS rejection_reason, CAST(NULL AS VARCHAR) AS rejection_details,
    prev_stage AS previous_stage, stage AS current_stage,
    'batch-0001' AS _ingestion_batch_id, '2024-02-01 00:00:00' AS _ingested_at, 'greenhouse' AS _source_system,
    'application_events' AS _source_object, 'api_sync' AS _loaded_by
  FROM event_base
  UNION ALL
  SELECT '7000001', 'Acme Talent (redelivered)', 'candidate_stage_change', CAST(user_id AS VARCHAR),
    CASE WHEN prev_stage IS NULL THEN NULL ELSE 'active' END, 'active', CAST(ts AS VARCHAR),
    NULL, NULL, NULL, prev_stage, stage,
    'batch-0002', '2024-02-02 06:00:00', 'greenhouse', 'application_events', 'api_sync'
  FROM event_base WHERE event_id % 10 = 0
),
stg_events_typed AS (
  SELECT organization_id, organization_name, action, {long_sql('application_id')} AS application_id,
    previous_status, current_status, previous_stage, current_stage,
    {ts_sql('last_activity_at')} AS event_at, {ts_sql('rejected_at')} AS rejected_at,
    rejection_reason, rejection_details, _ingestion_batch_id, {ts_sql('_ingested_at')} AS ingested_at,
    _source_system, _source_object, _loaded_by
  FROM raw_events
),
stg_events AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY application_id, action, previous_status, current_status, previous_stage, current_stage, event_at
      ORDER BY ingested_at DESC NULLS LAST, _ingestion_batch_id DESC NULLS LAST, organization_id DESC NULLS LAST,
               organization_name DESC NULLS LAST, rejected_at DESC NULLS LAST, rejection_reason DESC NULLS LAST,
               rejection_details DESC NULLS LAST, _source_system DESC NULLS LAST, _source_object DESC NULLS LAST,
               _loaded_by DESC NULLS LAST) AS rn
    FROM stg_events_typed) WHERE rn = 1
),
stg_applications AS (
  SELECT {long_sql('ghap_application_id')} AS application_id, {long_sql('ghap_candidate_id')} AS candidate_id,
    {long_sql('ghap_job_id')} AS job_id, {ts_sql('ghap_applied_at')} AS applied_at,
    {ts_sql('ghap_rejected_at')} AS rejected_at, {ts_sql('ghap_last_activity_at')} AS last_activity_at,
    {ts_sql('ghap_hired_at')} AS hired_at, ghap_source AS application_source,
    ghap_rejection_reason AS rejection_reason, ghap_status AS application_status,
    ghap_application_current_stage AS current_stage, {long_sql('ghap_jobs_count')} AS jobs_count,
    _ingestion_batch_id, {ts_sql('_ingested_at')} AS ingested_at, _source_system, _source_object, _loaded_by
  FROM raw_applications
),
stg_candidates AS (
  SELECT {long_sql('ghca_candidate_id')} AS candidate_id, ghca_first_name AS first_name, ghca_last_name AS last_name,
    concat(coalesce(ghca_first_name, ''), ' ', coalesce(ghca_last_name, '')) AS candidate_full_name,
    {long_sql('ghca_recruiter_id')} AS recruiter_id, ghca_recruiter_name AS recruiter_name,
    {ts_sql('ghca_created_at')} AS created_at, {ts_sql('ghca_updated_at')} AS updated_at,
    _ingestion_batch_id, {ts_sql('_ingested_at')} AS ingested_at, _source_system, _source_object, _loaded_by
  FROM raw_candidates
),
stg_jobs AS (
  SELECT {long_sql('ghjb_job_id')} AS job_id, ghjb_job_name AS job_name,
    {long_sql('ghjb_requisition_id')} AS requisition_id, ghjb_job_status AS job_status,
    {ts_sql('ghjb_created_at')} AS created_at, {ts_sql('ghjb_opened_at')} AS opened_at,
    {ts_sql('ghjb_closed_at')} AS closed_at, {long_sql('ghjb_gh_department_id')} AS department_id,
    ghjb_gh_department_name AS department_name, {long_sql('ghjb_gh_office_id')} AS office_id,
    ghjb_gh_office_name AS office_name, {long_sql('ghjb_hiring_manager_id')} AS hiring_manager_id,
    ghjb_hiring_manager_name AS hiring_manager_name, {long_sql('ghjb_recruiter_id')} AS recruiter_id,
    ghjb_recruiter_name AS recruiter_name, ghjb_employment_type AS employment_type,
    ghjb_budget_owner AS budget_owner, ghjb_executive AS executive, TRY_CAST(ghjb_fte AS DOUBLE) AS fte,
    ghjb_job_type AS job_type,
    _ingestion_batch_id, {ts_sql('_ingested_at')} AS ingested_at, _source_system, _source_object, _loaded_by
  FROM raw_jobs
),
stg_offers AS (
  SELECT {long_sql('ghof_offer_id')} AS offer_id, {long_sql('ghof_application_id')} AS application_id,
    ghof_status AS offer_status, {ts_sql('ghof_created_at')} AS created_at, {ts_sql('ghof_updated_at')} AS updated_at,
    {ts_sql('ghof_resolved_at')} AS resolved_at, {ts_sql('ghof_starts_at')} AS starts_at,
    _ingestion_batch_id, {ts_sql('_ingested_at')} AS ingested_at, _source_system, _source_object, _loaded_by
  FROM raw_offers
),
stg_openings AS (
  SELECT {long_sql('ghop_id')} AS opening_row_id, {long_sql('ghop_opening_id')} AS opening_id,
    {long_sql('ghop_job_id')} AS job_id, {long_sql('ghop_application_id')} AS application_id,
    ghop_status AS opening_status, ghop_close_reason_name AS close_reason_name, ghop_priority AS priority,
    ghop_additional_hire_replacement AS additional_hire_replacement,
    {ts_sql('ghop_opened_at')} AS opened_at, {ts_sql('ghop_closed_at')} AS closed_at,
    _ingestion_batch_id, {ts_sql('_ingested_at')} AS ingested_at, _source_system, _source_object, _loaded_by
  FROM raw_openings
),
dim_candidate AS (
  SELECT candidate_id, first_name, last_name, candidate_full_name, recruiter_id, recruiter_name, created_at, updated_at
  FROM stg_candidates WHERE candidate_id IS NOT NULL GROUP BY ALL
),
dim_job AS (
  SELECT * EXCLUDE (_ingestion_batch_id, ingested_at, _source_system, _source_object, _loaded_by)
  FROM stg_jobs WHERE job_id IS NOT NULL GROUP BY ALL
),
dim_office AS (SELECT office_id, office_name FROM dim_job GROUP BY ALL HAVING office_id IS NOT NULL
  UNION SELECT office_id, office_name FROM stg_jobs WHERE office_id IS NOT NULL),
dim_department AS (
  SELECT department_id, min(department_name) AS department_name FROM stg_jobs GROUP BY department_id HAVING department_id IS NOT NULL
),
people AS (SELECT recruiter_id, recruiter_name FROM stg_candidates UNION ALL SELECT recruiter_id, recruiter_name FROM stg_jobs),
dim_recruiter AS (SELECT * FROM people WHERE recruiter_id IS NOT NULL GROUP BY ALL),
outcome AS (
  SELECT *, coalesce(application_status = 'hired', false) AS is_hired,
    CASE application_status WHEN 'hired' THEN ifnull(hired_at, last_activity_at) END AS hire_time
  FROM stg_applications WHERE application_id IS NOT NULL
),
fact_application AS (
  SELECT f.application_id, f.candidate_id, f.job_id, ifnull(j.recruiter_id, p.recruiter_id) AS recruiter_id, j.department_id,
    j.office_id, f.application_status, f.current_stage, f.application_source, f.rejection_reason, f.applied_at, f.rejected_at,
    f.last_activity_at, f.hire_time AS hired_at,
    CASE WHEN date_sub('day', f.applied_at, f.hire_time) >= 0 THEN date_sub('day', f.applied_at, f.hire_time) END AS time_to_hire_days,
    f.jobs_count, coalesce(f.application_status = 'active', false) AS is_active,
    coalesce(f.application_status = 'rejected', false) AS is_rejected, f.is_hired
  FROM outcome f
  LEFT JOIN stg_candidates p ON p.candidate_id = f.candidate_id
  LEFT JOIN stg_jobs j ON j.job_id = f.job_id
),
fact_offer AS (
  SELECT offer_id, application_id, f.candidate_id, f.job_id, f.recruiter_id, f.department_id, f.office_id, offer_status,
    created_at, updated_at, resolved_at, starts_at, coalesce(offer_status = 'accepted', false) AS is_accepted
  FROM (SELECT * FROM stg_offers WHERE offer_id IS NOT NULL) LEFT JOIN fact_application f USING (application_id)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY event_at ASC NULLS FIRST,
      {rank_prev} ASC NULLS FIRST, {rank_cur} ASC NULLS FIRST, action ASC NULLS FIRST,
      previous_stage ASC NULLS FIRST, current_stage ASC NULLS FIRST, previous_status ASC NULLS FIRST,
      current_status ASC NULLS FIRST) AS k
  FROM stg_events
),
stay AS (
  SELECT e.*, before.event_at AS began, date_sub('hour', before.event_at, e.event_at) AS hours, {sla} AS target
  FROM numbered e JOIN numbered before ON before.k + 1 = e.k AND before.application_id IS NOT DISTINCT FROM e.application_id
  WHERE e.previous_stage IS NOT NULL AND before.event_at IS NOT NULL
),
fact_stage_transition AS (
  SELECT
    md5(concat_ws('|', CAST(application_id AS VARCHAR), previous_stage, CAST(epoch_us(began) AS VARCHAR),
        coalesce(CAST(epoch_us(event_at) AS VARCHAR), ''))) AS stage_transition_id,
    application_id, action, previous_status, stay.current_status, previous_stage AS stage_name, previous_stage,
    stay.current_stage, began AS stage_started_at, event_at AS stage_ended_at, hours AS duration_hours,
    hours / 24.0::DOUBLE AS duration_days, coalesce(previous_stage IN {owned}, false) AS is_recruiter_owned_stage,
    target AS sla_target_days, stay.ingested_at,
    f.candidate_id, f.job_id, f.recruiter_id, f.department_id, f.office_id,
    CASE WHEN target IS NOT NULL THEN coalesce(hours / 24.0::DOUBLE <= target, false) END AS sla_met
  FROM stay LEFT JOIN fact_application f USING (application_id)
)"""


def with_base(select_sql: str, stages: StageConfig = DRIVER_TABLE_STAGES, extra_ctes: str = "") -> str:
    extra = (",\n" + extra_ctes.strip().rstrip(",")) if extra_ctes.strip() else ""
    return "WITH " + base_ctes(stages).strip() + extra + "\n" + select_sql.strip()


def uuid5_sql(name_sql: str, namespace_hex: str = "6ba7b8119dad11d180b400c04fd430c8") -> str:
    h = f"sha1(unhex('{namespace_hex}') || encode({name_sql}))"
    nib = f"substr('89ab', ((position(substr({h}, 17, 1) in '0123456789abcdef') - 1) & 3) + 1, 1)"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {nib}"
            f" || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))")


def ops_ctes(as_of: str = AS_OF) -> str:
    """Operational applications seeded from the raw tables (I4)."""
    return f"""
ops_job_ctx AS (
  SELECT * FROM (
    SELECT {long_sql('ghjb_job_id')} AS ctx_job_id, ghjb_job_name AS job_title,
      ghjb_recruiter_name AS ctx_recruiter_name, CAST(NULL AS VARCHAR) AS recruiter_email,
      ghjb_gh_office_name AS ctx_office_name, ghjb_gh_department_name AS ctx_department_name
    FROM raw_jobs) WHERE ctx_job_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ctx_job_id ORDER BY job_title DESC NULLS LAST,
    ctx_recruiter_name DESC NULLS LAST, ctx_office_name DESC NULLS LAST, ctx_department_name DESC NULLS LAST) = 1
),
ops_candidate_ctx AS (
  SELECT * FROM (
    SELECT {long_sql('ghca_candidate_id')} AS ctx_candidate_id,
      nullif(trim(concat_ws(' ', nullif(ghca_first_name, ''), nullif(ghca_last_name, ''))), '') AS ctx_candidate_name,
      ghca_created_at AS ctx_created_at
    FROM raw_candidates) WHERE ctx_candidate_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ctx_candidate_id ORDER BY ctx_candidate_name DESC NULLS LAST,
    ctx_created_at DESC NULLS LAST) = 1
),
ops_base AS (
  SELECT * FROM (
    SELECT {long_sql('ghap_application_id')} AS application_id, {long_sql('ghap_job_id')} AS job_id,
      {long_sql('ghap_candidate_id')} AS candidate_id, ghap_last_activity_at AS _updated,
      ghap_applied_at AS applied_text, coalesce(nullif(ghap_status, ''), 'active') AS status,
      ghap_application_current_stage AS current_stage
    FROM raw_applications) WHERE application_id IS NOT NULL
),
ops_applications AS (
  SELECT a.application_id, a.candidate_id, a.job_id, c.ctx_candidate_name AS candidate_full_name,
    c.ctx_candidate_name AS candidate_name, j.job_title, a.current_stage, a.status,
    j.ctx_recruiter_name AS recruiter, j.ctx_recruiter_name AS recruiter_name, j.recruiter_email,
    j.ctx_office_name AS office, j.ctx_office_name AS office_name,
    j.ctx_department_name AS department, j.ctx_department_name AS department_name,
    TRY_CAST(a.applied_text AS TIMESTAMP) AS applied_at,
    TRY_CAST(coalesce(a.applied_text, c.ctx_created_at) AS TIMESTAMP) AS created_at,
    TRY_CAST(CASE WHEN a.status = 'hired' THEN a._updated END AS TIMESTAMP) AS hired_at,
    TRY_CAST(coalesce(a._updated, '{as_of}') AS TIMESTAMP) AS updated_at
  FROM ops_base a
  LEFT JOIN ops_job_ctx j ON a.job_id = j.ctx_job_id
  LEFT JOIN ops_candidate_ctx c ON a.candidate_id = c.ctx_candidate_id
)"""


def with_ops(select_sql: str, extra_ctes: str = "") -> str:
    ctes = ops_ctes().strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip().rstrip(",")
    return with_base(select_sql, extra_ctes=ctes)
