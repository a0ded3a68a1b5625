"""Registered queries for the fractional-hours model (I6-I13) and the serving layer."""

from __future__ import annotations

from talentlake.config import DRIVER_TABLE_STAGES, HIRE_ELIGIBLE_STAGES
from talentlake.operators import fractional, serve
from talentlake.oracle import _in, rank_sql, with_base, with_ops
from talentlake.plans import changes
from talentlake.plans.catalog import K1_SQL, K3_SQL, K4_SQL, K5_SQL, K7_SQL, K8_SQL, facts_written, register, warehouse
from talentlake.plans.catalog_ops import HIRE_SQL, _plan_hire, ops_apps, raw

STAGES = DRIVER_TABLE_STAGES
# Dashboard scope used by the registered serving queries (a user's selection).
SCOPE_DEPARTMENTS = ("EUROPE", "ASIA", "AMERICA")
SCOPE_RECRUITERS = tuple(f"Recruiter {i}" for i in range(1, 10))


# -- fractional model ---------------------------------------------------------------------

def _fr(spark, sf_dir):
    r = raw(spark, sf_dir)
    enriched = fractional.enriched_applications(r["applications"], r["jobs"], r["candidates"])
    transitions = fractional.stage_transitions(r["application_events"], STAGES)
    cases = fractional.recruiter_sla_cases(transitions, enriched)
    return r, enriched, transitions, cases


def _fr_ctes() -> str:
    tb = ", ".join(
        f"{e} ASC NULLS FIRST" for e in (
            rank_sql("previous_stage", STAGES.order), rank_sql("current_stage", STAGES.order), "action",
            "previous_stage", "current_stage", "previous_status", "current_status",
        )
    )
    stage = "coalesce(previous_stage, current_stage)"
    target = "(CASE " + stage + " " + " ".join(
        f"WHEN '{k}' THEN CAST({float(v)} AS DOUBLE)" for k, v in STAGES.sla_days.items()) + " END)"
    hours = "(CAST(epoch_us(event_at) - epoch_us(entered) AS DOUBLE) / CAST(3600000000 AS DOUBLE))"
    return f"""
enriched AS (
  SELECT a.* EXCLUDE (ghap_applied_at, ghap_rejected_at, ghap_last_activity_at, _ingestion_batch_id, _ingested_at,
                      _source_system, _source_object, _loaded_by),
    TRY_CAST(a.ghap_applied_at AS TIMESTAMP) AS ghap_applied_at, TRY_CAST(a.ghap_rejected_at AS TIMESTAMP) AS ghap_rejected_at,
    TRY_CAST(a.ghap_last_activity_at AS TIMESTAMP) AS ghap_last_activity_at,
    j.ghjb_job_id, j.ghjb_job_name, j.ghjb_job_status, j.ghjb_gh_department_id, j.ghjb_gh_department_name,
    j.ghjb_gh_office_id, j.ghjb_gh_office_name, j.ghjb_hiring_manager_id, j.ghjb_hiring_manager_name,
    j.ghjb_recruiter_id, j.ghjb_recruiter_name,
    c.ghca_candidate_id, c.ghca_first_name, c.ghca_last_name, c.ghca_recruiter_id, c.ghca_recruiter_name,
    trim(concat(coalesce(c.ghca_first_name, ''), ' ', coalesce(c.ghca_last_name, ''))) AS candidate_full_name,
    coalesce(j.ghjb_recruiter_name, c.ghca_recruiter_name) AS recruiter_name
  FROM raw_applications a
  LEFT JOIN raw_jobs j ON a.ghap_job_id = j.ghjb_job_id
  LEFT JOIN raw_candidates c ON a.ghap_candidate_id = c.ghca_candidate_id
),
fr_distinct AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY application_id, action, previous_status, current_status, previous_stage, current_stage, event_at
      ORDER BY ingested_at DESC NULLS LAST, _ingestion_batch_id DESC NULLS LAST) AS rn
    FROM stg_events_typed) WHERE rn = 1
),
fr_ordered AS (
  SELECT application_id, action, previous_status, current_status, previous_stage, current_stage, event_at,
    lag(event_at) OVER (PARTITION BY application_id ORDER BY event_at ASC NULLS FIRST, {tb}) AS entered
  FROM fr_distinct
),
transitions_fr AS (
  SELECT application_id, action, previous_status, current_status, previous_stage, current_stage,
    event_at AS last_activity_at, {stage} AS stage_name, entered AS entered_stage_at, event_at AS left_stage_at,
    {hours} AS duration_hours, {hours} / CAST(24.0 AS DOUBLE) AS duration_days, {target} AS sla_target_days,
    coalesce({stage} IN {_in(STAGES.owned)}, false) AS is_recruiter_owned_stage,
    CASE WHEN {target} IS NOT NULL AND {hours} IS NOT NULL THEN {hours} / CAST(24.0 AS DOUBLE) <= {target} END AS sla_met
  FROM fr_ordered
),
sla_cases AS (
  SELECT t.*, e.ghap_application_id, e.candidate_full_name, e.ghjb_job_name, e.ghjb_gh_department_name,
    e.ghjb_gh_office_name, e.recruiter_name, e.ghap_status
  FROM transitions_fr t LEFT JOIN enriched e ON t.application_id = {long_expr('e.ghap_application_id')}
  WHERE t.is_recruiter_owned_stage
)"""


def long_expr(col: str) -> str:
    from talentlake.oracle import long_sql

    return long_sql(col)


FR = _fr_ctes()


def _global_sql(app_filter: str = "TRUE", sla_filter: str = "TRUE") -> str:
    return f"""
SELECT (SELECT count(*) FILTER (WHERE ghjb_job_status = 'open') FROM raw_jobs) AS open_jobs,
  (SELECT count(*) FROM enriched WHERE {app_filter}) AS total_applications,
  (SELECT count(*) FILTER (WHERE ghap_status = 'active') FROM enriched WHERE {app_filter}) AS active_applications,
  (SELECT count(*) FILTER (WHERE ghap_status = 'rejected') FROM enriched WHERE {app_filter}) AS rejected_applications,
  (SELECT count(*) FILTER (WHERE ghap_status = 'hired') FROM enriched WHERE {app_filter}) AS hired_applications,
  (SELECT count(*) FILTER (WHERE ghof_status = 'accepted') FROM raw_offers) AS accepted_offers,
  (SELECT CASE WHEN count(*) FILTER (WHERE sla_met IS NOT NULL) = 0 THEN 0.0
     ELSE CAST(count(*) FILTER (WHERE sla_met) AS DOUBLE) / count(*) FILTER (WHERE sla_met IS NOT NULL) END
   FROM sla_cases WHERE {sla_filter}) AS recruiter_sla_compliance_rate,
  (SELECT count(*) FILTER (WHERE sla_met IS NOT NULL) FROM sla_cases WHERE {sla_filter}) AS recruiter_sla_total_cases"""


register("enriched_applications", with_base("SELECT * FROM enriched", extra_ctes=FR))(
    lambda spark, sf_dir: _fr(spark, sf_dir)[1])
register("stage_transitions_fractional", with_base("SELECT * FROM transitions_fr", extra_ctes=FR))(
    lambda spark, sf_dir: _fr(spark, sf_dir)[2])
register("recruiter_sla_cases", with_base("SELECT * FROM sla_cases", extra_ctes=FR))(
    lambda spark, sf_dir: _fr(spark, sf_dir)[3])


@register("global_metrics", with_base(_global_sql(), extra_ctes=FR))
def q_global_metrics(spark, sf_dir):
    r, enriched, _, cases = _fr(spark, sf_dir)
    return fractional.global_metrics(r["jobs"], enriched, r["offers"], cases)


@register("global_metrics_scoped", with_base(_global_sql(
    f"ghjb_gh_department_name IN {_in(SCOPE_DEPARTMENTS)}", f"ghjb_gh_department_name IN {_in(SCOPE_DEPARTMENTS)}"),
    extra_ctes=FR))
def q_global_metrics_scoped(spark, sf_dir):
    r, enriched, _, cases = _fr(spark, sf_dir)
    return fractional.global_metrics_scoped(r["jobs"], enriched, r["offers"], cases, None, SCOPE_DEPARTMENTS)


for _col, _key in [("ghap_status", "status"), ("ghap_application_current_stage", "stage"),
                   ("ghjb_gh_office_name", "office"), ("ghjb_gh_department_name", "department")]:
    register(f"applications_by_{_key}", with_base(
        f"SELECT {_col}, count(*) AS applications FROM enriched GROUP BY {_col}", extra_ctes=FR))(
        (lambda c: lambda spark, sf_dir: fractional.applications_by(_fr(spark, sf_dir)[1], c))(_col))


@register("recruiter_sla_summary", with_base("""
SELECT recruiter_name, stage_name, count(application_id) AS cases,
  round_even(CAST(sum(epoch_us(left_stage_at) - epoch_us(entered_stage_at)) AS DOUBLE) / CAST(count(duration_days) AS DOUBLE)
             / CAST(3600000000 AS DOUBLE) / CAST(24.0 AS DOUBLE), 2) AS avg_duration_days,
  round_even(avg(CAST(sla_met AS INTEGER)) * CAST(100.0 AS DOUBLE), 1) AS sla_compliance_rate
FROM sla_cases WHERE sla_met IS NOT NULL GROUP BY recruiter_name, stage_name""", extra_ctes=FR))
def q_recruiter_sla_summary(spark, sf_dir):
    return fractional.recruiter_sla_summary(_fr(spark, sf_dir)[3])


@register("delayed_cases", with_base("""
SELECT application_id, candidate_full_name, ghjb_job_name, ghjb_gh_department_name, ghjb_gh_office_name,
  recruiter_name, stage_name, round_even(duration_days, 2) AS duration_days, sla_target_days
FROM sla_cases WHERE sla_met = false AND duration_days IS NOT NULL""", extra_ctes=FR))
def q_delayed_cases(spark, sf_dir):
    return fractional.delayed_cases(_fr(spark, sf_dir)[3])


# -- serving over the marts --------------------------------------------------------------------

def _mart_cte(name: str, sql: str) -> str:
    """``, a AS (...)\\nSELECT ...`` or ``SELECT ...`` → CTE text defining ``name``."""
    sql = sql.strip()
    if sql.startswith(","):
        head, _, tail = sql[1:].rpartition("\nSELECT ")
        return f"{name} AS (WITH {head.strip().rstrip(',')}\nSELECT {tail})"
    return f"{name} AS ({sql})"


def _scope_sql(offices=None, departments=None, recruiters=None) -> str:
    parts = ["TRUE"]
    if offices is not None:
        parts.append(f"office_name IN {_in(offices)}")
    if departments is not None:
        parts.append(f"department_name IN {_in(departments)}")
    if recruiters is not None:
        parts.append(f"recruiter_name IN {_in(recruiters)}")
    return " AND ".join(parts)


DEP = _scope_sql(departments=SCOPE_DEPARTMENTS)
DEP_REC = _scope_sql(departments=SCOPE_DEPARTMENTS, recruiters=SCOPE_RECRUITERS)


@register("serve_overview_scoped", with_base(f"""
SELECT {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in serve.SUMMED)},
  CASE WHEN coalesce(sum(recruiter_owned_stage_cases), 0) = 0 THEN NULL
       ELSE CAST(sum(recruiter_sla_met_cases) AS DOUBLE) / sum(recruiter_owned_stage_cases) END AS recruiter_sla_compliance_rate,
  round_even(sum(avg_time_to_hire_days * hired_applications_with_valid_time_to_hire) FILTER (WHERE avg_time_to_hire_days IS NOT NULL AND hired_applications_with_valid_time_to_hire > 0)
    / sum(hired_applications_with_valid_time_to_hire) FILTER (WHERE avg_time_to_hire_days IS NOT NULL AND hired_applications_with_valid_time_to_hire > 0), 6) AS avg_time_to_hire_days
FROM k3 WHERE {DEP}""", extra_ctes=_mart_cte("k3", K3_SQL)))
def q_serve_overview_scoped(spark, sf_dir):
    return serve.overview_scoped(facts_written(spark, sf_dir).mart_exec_overview_by_scope, None, SCOPE_DEPARTMENTS)


@register("serve_status", with_base(f"""
SELECT application_status, CAST(sum(applications_count) AS BIGINT) AS applications_count FROM k1 WHERE {DEP} GROUP BY application_status""",
                                    extra_ctes=_mart_cte("k1", K1_SQL)))
def q_serve_status(spark, sf_dir):
    return serve.status_distribution(warehouse(spark, sf_dir).mart_status_by_scope, None, SCOPE_DEPARTMENTS)


@register("serve_status_table", with_base(f"""
SELECT office_name, department_name, application_status, applications_count,
  round_even(status_share * CAST(100.0 AS DOUBLE), 1) AS status_share FROM k1 WHERE {DEP}""",
                                          extra_ctes=_mart_cte("k1", K1_SQL)))
def q_serve_status_table(spark, sf_dir):
    return serve.status_table(warehouse(spark, sf_dir).mart_status_by_scope, None, SCOPE_DEPARTMENTS)


@register("serve_funnel", with_base(f"""
SELECT stage_order, stage_name, CAST(sum(applications_reached) AS BIGINT) AS applications_reached FROM k7 WHERE {DEP}
GROUP BY stage_order, stage_name""", extra_ctes=_mart_cte("k7", K7_SQL)))
def q_serve_funnel(spark, sf_dir):
    return serve.funnel(warehouse(spark, sf_dir).mart_funnel_by_scope, None, SCOPE_DEPARTMENTS)


@register("serve_workload", with_base(f"""
SELECT recruiter_name, CAST(sum(total_applications) AS BIGINT) AS total_applications,
  CAST(sum(active_applications) AS BIGINT) AS active_applications,
  CAST(sum(sla_breached_cases) AS BIGINT) AS sla_breached_cases FROM k5 WHERE {DEP_REC} GROUP BY recruiter_name""",
                                      extra_ctes=_mart_cte("k5", K5_SQL)))
def q_serve_workload(spark, sf_dir):
    return serve.workload_chart(facts_written(spark, sf_dir).mart_recruiter_workload, None, SCOPE_DEPARTMENTS, SCOPE_RECRUITERS)


@register("serve_workload_table", with_base(f"""
SELECT recruiter_name, office_name, department_name, total_applications, active_applications, jobs_touched,
  recruiter_owned_stage_cases, sla_met_cases, sla_breached_cases,
  round_even(sla_compliance_rate * CAST(100.0 AS DOUBLE), 1) AS sla_compliance_rate,
  round_even(avg_recruiter_stage_duration_days, 2) AS avg_recruiter_stage_duration_days, total_offers, accepted_offers
FROM k5 WHERE {DEP_REC}""", extra_ctes=_mart_cte("k5", K5_SQL)))
def q_serve_workload_table(spark, sf_dir):
    return serve.workload_table(facts_written(spark, sf_dir).mart_recruiter_workload, None, SCOPE_DEPARTMENTS, SCOPE_RECRUITERS)


@register("serve_performance", with_base(f"""
SELECT recruiter_name, office_name, department_name, stage_name, total_cases, sla_met_cases, sla_breached_cases,
  round_even(sla_compliance_rate * CAST(100.0 AS DOUBLE), 1) AS sla_compliance_rate,
  round_even(avg_duration_days, 2) AS avg_duration_days
FROM k4 WHERE {DEP_REC}""", extra_ctes=_mart_cte("k4", K4_SQL)))
def q_serve_performance(spark, sf_dir):
    return serve.performance_table(warehouse(spark, sf_dir).mart_recruiter_performance, None, SCOPE_DEPARTMENTS,
                                   SCOPE_RECRUITERS)


@register("serve_breaches", with_base(f"""
SELECT application_id, candidate_full_name, job_name, recruiter_name, department_name, office_name, stage_name,
  round_even(duration_days, 2) AS duration_days, sla_target_days, application_status, current_stage
FROM k8 WHERE {DEP_REC}""", extra_ctes=_mart_cte("k8", K8_SQL)))
def q_serve_breaches(spark, sf_dir):
    return serve.breach_table(warehouse(spark, sf_dir).mart_sla_breaches, None, SCOPE_DEPARTMENTS, SCOPE_RECRUITERS)


# -- operational serving ---------------------------------------------------------------------------

DISPLAY_CTE = """
display AS (
  SELECT application_id, candidate_id,
    nullif(trim(coalesce(nullif(candidate_full_name, ''), nullif(candidate_name, ''),
             CASE WHEN candidate_id IS NOT NULL THEN 'Candidate ' || CAST(candidate_id AS VARCHAR) END)), '') AS candidate_display,
    job_id,
    nullif(trim(coalesce(nullif(job_title, ''), CASE WHEN job_id IS NOT NULL THEN 'Job ' || CAST(job_id AS VARCHAR) END)), '') AS job_display,
    CASE WHEN trim(status) = '' THEN NULL ELSE status END AS status,
    CASE WHEN trim(current_stage) = '' THEN NULL ELSE current_stage END AS current_stage,
    nullif(trim(coalesce(nullif(office_name, ''), nullif(office, ''))), '') AS office,
    nullif(trim(coalesce(nullif(department_name, ''), nullif(department, ''))), '') AS department,
    nullif(trim(coalesce(nullif(recruiter_name, ''), nullif(recruiter, ''))), '') AS recruiter,
    updated_at, created_at, applied_at
  FROM {src}
)"""


@register("display_rows", with_ops("SELECT * FROM display", DISPLAY_CTE.format(src="ops_applications")))
def q_display_rows(spark, sf_dir):
    return serve.display_rows(ops_apps(spark, sf_dir))


SEARCH = dict(stages=("Offer", "Reference Check"), text="building", departments=("EUROPE", "ASIA"), cap=50)


def _search_sql(kind: str) -> str:
    blob = "lower(concat_ws(' ', " + ", ".join(
        [f"CAST({c} AS VARCHAR)" for c in ("application_id", "candidate_id", "candidate_display", "job_id", "job_display",
                                           "status", "current_stage", "office", "department", "recruiter")]
        + [f"strftime({c}, '%Y-%m-%d %H:%M:%S')" for c in ("updated_at", "created_at", "applied_at")]) + "))"
    s1 = f"coalesce(current_stage IN {_in(SEARCH['stages'])}, false)"
    s2 = f"({s1} AND coalesce(contains({blob}, '{SEARCH['text']}'), false))"
    s3 = f"({s2} AND coalesce(department IN {_in(SEARCH['departments'])}, false))"
    ctes = f"""eligible_apps AS (SELECT * FROM ops_applications WHERE status = 'active' AND status NOT IN ('hired', 'rejected')
  AND current_stage IN {_in(HIRE_ELIGIBLE_STAGES)}),
{DISPLAY_CTE.format(src='eligible_apps').strip()}"""
    if kind == "counts":
        sel = f"""SELECT count(*) AS eligible_count, count(*) FILTER (WHERE {s1}) AS after_stage_count,
  count(*) FILTER (WHERE {s2}) AS after_search_count, count(*) FILTER (WHERE {s3}) AS after_scope_count FROM display"""
    else:
        sel = f"""SELECT * FROM display WHERE {s3} ORDER BY updated_at ASC NULLS FIRST, application_id ASC LIMIT {SEARCH['cap']}"""
    return with_ops(sel, ctes)


def _search(spark, sf_dir):
    apps = ops_apps(spark, sf_dir)
    return serve.candidate_search(changes.eligible_hire(apps, "Late-stage candidates"), stages=SEARCH["stages"],
                                  text=SEARCH["text"], departments=SEARCH["departments"], cap=SEARCH["cap"])


register("candidate_search", _search_sql("list"))(lambda spark, sf_dir: _search(spark, sf_dir)[0])
register("candidate_search_counts", _search_sql("counts"))(lambda spark, sf_dir: _search(spark, sf_dir)[1])


@register("exclusion_reason", with_ops(f"""
SELECT application_id, status, current_stage,
  coalesce(nullif(concat_ws('; ',
    CASE WHEN status = 'hired' THEN 'already hired' WHEN status = 'rejected' THEN 'already rejected'
         WHEN coalesce(status <> 'active', true) THEN 'not active' END,
    CASE WHEN NOT coalesce(current_stage IN {_in(HIRE_ELIGIBLE_STAGES)}, false) THEN 'current stage not eligible for hired' END),
  ''), 'not eligible') AS exclusion_reason
FROM ops_applications"""))
def q_exclusion_reason(spark, sf_dir):
    return serve.exclusion_reason(ops_apps(spark, sf_dir), "hired")


@register("expected_kpi_delta", with_ops(f"""
SELECT request_id, status, outcome, selection_mode, requested_limit, eligible_count, selected_count, reason,
  'up to ' || CAST(selected_count AS VARCHAR) AS expected_active_applications_decrease,
  'up to ' || CAST(selected_count AS VARCHAR) AS expected_hired_kpi_increase,
  '0' AS expected_rejected_kpi_increase
FROM hire_request""", HIRE_SQL))
def q_expected_kpi_delta(spark, sf_dir):
    p = changes.freeze_plan(_plan_hire(ops_apps(spark, sf_dir)))
    return serve.expected_kpi_delta(p.request, p.items)



@register("item_details", with_ops("""
SELECT d.*, i.apply_status AS item_apply_status
FROM display d JOIN hire_items i USING (application_id)""",
    HIRE_SQL + ",\n" + DISPLAY_CTE.format(src="ops_applications").strip()))
def q_item_details(spark, sf_dir):
    apps = ops_apps(spark, sf_dir)
    return serve.item_details(apps, _plan_hire(apps).items)


@register("scope_counts", with_ops("""
SELECT concat_ws(' / ', coalesce(nullif(recruiter, ''), 'Unknown recruiter'), coalesce(nullif(office, ''), 'Unknown office'),
  coalesce(nullif(department, ''), 'Unknown department')) AS scope, count(*) AS applications
FROM ops_applications WHERE status = 'active' AND coalesce(current_stage, '') <> 'Offer'
GROUP BY 1"""))
def q_scope_counts(spark, sf_dir):
    return serve.scope_counts(changes.eligible_stage_change(ops_apps(spark, sf_dir), "Offer"))
