"""Registered queries for filters, options, paging, orders, display texts, manual plans and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.config import HIRE_ELIGIBLE_STAGES, MODE_FOCUSED, MODE_GLOBAL, MODE_MANUAL_OUTCOME, REJECT_ELIGIBLE_STAGES
from talentlake.functions import scalar
from talentlake.operators import quality, serve
from talentlake.oracle import AS_OF, _in, long_sql, with_base, with_ops
from talentlake.plans import changes
from talentlake.plans.catalog import K1_SQL, K3_SQL, K4_SQL, K5_SQL, K7_SQL, facts_written, register, warehouse
from talentlake.plans.catalog_ops import (
    APPLY_SQL, APPROVER, HIRE, HIRE_SQL, MANUAL_IDS_SQL, REJECT, _manual_ids, _plan_hire, _reject_then_hire,
    frozen_apps, ops_apps, raw,
)
from talentlake.plans.catalog_serve import FR, _fr, _mart_cte
from talentlake.plans.warehouse import Warehouse


# -- P6, P11, P12, A16, O6, O7 -------------------------------------------------------------

@register("optional_filters", with_ops("""
SELECT application_id, job_id, status, current_stage FROM ops_applications
WHERE status = 'active' AND CAST(current_stage AS VARCHAR) = 'Offer'"""))
def q_optional_filters(spark, sf_dir):
    found = serve.optional_filters(ops_apps(spark, sf_dir), status="active", current_stage="Offer", job_id=None,
                                   not_a_column="x")
    return serve.pick_columns(found, ("application_id", "job_id", "not_a_column", "status", "current_stage"))


@register("lookup_applications", with_ops("""
SELECT application_id, candidate_full_name, current_stage FROM ops_applications
WHERE application_id IN (SELECT application_id FROM manual_ids)""", MANUAL_IDS_SQL))
def q_lookup_applications(spark, sf_dir):
    apps = ops_apps(spark, sf_dir)
    return serve.pick_columns(serve.lookup_ids(apps, _manual_ids(apps)),
                              ("application_id", "candidate_full_name", "current_stage"))


OPTION_COLUMNS = ("recruiter", "office", "department")


@register("scope_options", with_ops("\nUNION ALL\n".join(
    f"SELECT '{c}' AS kind, {c} AS value FROM ops_applications WHERE {c} IS NOT NULL GROUP BY {c}" for c in OPTION_COLUMNS)))
def q_scope_options(spark, sf_dir):
    apps = ops_apps(spark, sf_dir)
    parts = [serve.options(apps, c).select(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in OPTION_COLUMNS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PAGE_COLUMNS = ("application_id", "candidate_full_name", "status", "current_stage")
PAGE_SELECT = f"SELECT {', '.join(PAGE_COLUMNS)} FROM ops_applications"


@register("applications_page", with_ops(f"{PAGE_SELECT} ORDER BY application_id LIMIT 100 OFFSET 200"))
def q_applications_page(spark, sf_dir):
    """The third page of 100 applications."""
    return serve.page(ops_apps(spark, sf_dir).select(*PAGE_COLUMNS), "application_id", 100, 200)[0]


@register("applications_page_after", with_ops(f"{PAGE_SELECT} WHERE application_id > 500 ORDER BY application_id LIMIT 100"))
def q_applications_page_after(spark, sf_dir):
    return serve.page_after(ops_apps(spark, sf_dir).select(*PAGE_COLUMNS), "application_id", 100, after=500)


@register("recent_requests", with_ops("""
SELECT request_id, outcome, eligible_count, selected_count, TIMESTAMP '2026-01-01 09:00:00' AS requested_at
FROM hire_request""", APPLY_SQL))
def q_recent_requests(spark, sf_dir):
    """The latest hiring request among all outcome requests."""
    from talentlake.plans.catalog_ops import _plan_reject

    apps = ops_apps(spark, sf_dir)
    cols = ("request_id", "outcome", "eligible_count", "selected_count")
    asked = [(_plan_hire(apps).request, "2026-01-01 09:00:00"), (_plan_reject(apps).request, "2026-01-01 10:00:00")]
    frames = [r.select(*cols, F.lit(t).cast("timestamp").alias("requested_at")) for r, t in asked]
    return serve.recent_requests(frames[0].unionByName(frames[1]), 1, "hired")


# -- O1: orders -------------------------------------------------------------------------------

def _order_sql(name: str, columns) -> str:
    listed = dict(serve.SERVING_ORDER[name])
    keys = [f"{c} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}" for c, down in listed.items()]
    return ", ".join(keys + [f"{c} ASC NULLS FIRST" for c in columns if c not in listed])


def _positioned(key: str, name: str, mart: str, sql: str, model: str, columns, within) -> None:
    cols = ", ".join(columns)
    register(key, with_base(
        f"SELECT {cols}, CAST(row_number() OVER (PARTITION BY {', '.join(within)} ORDER BY {_order_sql(name, columns)}) AS INTEGER) "
        f"AS position FROM {mart}", extra_ctes=_mart_cte(mart, sql)))(
        lambda spark, sf_dir: serve.positioned(warehouse(spark, sf_dir).model(model).select(*columns), name, within))


_positioned("serve_performance_order", "performance", "k4", K4_SQL, "mart_recruiter_performance",
            ("department_name", "recruiter_name", "office_name", "stage_name", "sla_compliance_rate", "avg_duration_days"),
            ("department_name",))
_positioned("serve_workload_order", "workload", "k5", K5_SQL, "mart_recruiter_workload",
            ("department_name", "recruiter_name", "office_name", "active_applications", "sla_breached_cases"),
            ("department_name",))
_positioned("serve_status_order", "status", "k1", K1_SQL, "mart_status_by_scope",
            ("office_name", "department_name", "application_status", "applications_count"),
            ("office_name", "department_name"))
_positioned("serve_funnel_order", "funnel_by_scope", "k7", K7_SQL, "mart_funnel_by_scope",
            ("office_name", "department_name", "stage_order", "stage_name", "applications_reached"), ("department_name",))


# -- X8, X9, X19, X20, U3 ------------------------------------------------------------------------

@register("event_ids", with_base("""
SELECT ifnull(application_id, 'None') || '_' || ifnull(action, 'None') || '_' || ifnull(last_activity_at, 'None') AS event_id,
  count(*) AS deliveries
FROM raw_events GROUP BY 1"""))
def q_event_ids(spark, sf_dir):
    """Deliveries of each event id."""
    ids = raw(spark, sf_dir)["application_events"].select(
        scalar.event_id("application_id", "action", "last_activity_at").alias("event_id"))
    return ids.groupBy("event_id").agg(F.count(F.lit(1)).alias("deliveries"))


@register("transition_id_uniqueness", with_base("""
SELECT count(*) AS transitions, count(*) AS distinct_ids
FROM (SELECT DISTINCT stage_transition_id FROM fact_stage_transition)"""))
def q_transition_id_uniqueness(spark, sf_dir):
    """The default 64-bit transition ids are as many as the transitions' distinct keys."""
    from talentlake.config import DRIVER_TABLE_STAGES

    w = Warehouse(raw(spark, sf_dir), DRIVER_TABLE_STAGES, as_of=AS_OF)
    ids = w.fact_stage_transition.groupBy("stage_transition_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.agg(F.sum("n").alias("transitions"), F.count(F.lit(1)).alias("distinct_ids"))


@register("kpi_texts", with_base(f"""
SELECT office_name, department_name,
  {', '.join(f"coalesce(replace(format('{{:,}}', {c}), ',', ' '), '0') AS {c}" for c in serve.SUMMED)},
  coalesce(printf('%.1f days', round_even(avg_time_to_hire_days, 1)), 'N/A') AS avg_time_to_hire,
  coalesce(printf('%.1f%%', round_even(100.0::DOUBLE * (CAST(recruiter_sla_met_cases AS DOUBLE)
    / nullif(recruiter_owned_stage_cases, 0)), 1)), 'N/A') AS recruiter_sla_compliance
FROM k3""", extra_ctes=_mart_cte("k3", K3_SQL)))
def q_kpi_texts(spark, sf_dir):
    return serve.kpi_texts(facts_written(spark, sf_dir).mart_exec_overview_by_scope)


@register("request_metadata", with_ops(f"""
SELECT request_id,
  '{{"applied_count":' || count(*) FILTER (WHERE applies) || ',"failed_count":0,"reason":"{HIRE['reason']}","skipped_count":'
    || count(*) FILTER (WHERE NOT applies) || '}}' AS metadata,
  CAST(count(*) FILTER (WHERE applies) AS VARCHAR) AS applied_text
FROM hire_done GROUP BY request_id""", APPLY_SQL))
def q_request_metadata(spark, sf_dir):
    """The counts of an applied request merged into its metadata, over a stale count."""
    request = _reject_then_hire(spark, sf_dir)[1].request
    request = request.withColumn("metadata", F.to_json(F.struct("reason", F.lit("stale").alias("applied_count"))))
    return changes.request_metadata(request).select(
        "request_id", "metadata", scalar.json_field("metadata", "applied_count").alias("applied_text"))


@register("clean_stage_lists", with_base("""
SELECT application_id, last_activity_at, list_filter(
  [trim(previous_stage), CASE WHEN trim(current_stage) IS DISTINCT FROM trim(previous_stage) THEN trim(current_stage) END],
  lambda x: x <> '') AS stages
FROM raw_events"""))
def q_clean_stage_lists(spark, sf_dir):
    e = raw(spark, sf_dir)["application_events"]
    padded = F.array(F.concat(F.lit(" "), F.col("previous_stage")), F.col("current_stage"), F.lit("  "),
                     F.concat(F.col("current_stage"), F.lit(" ")), F.col("previous_stage"))
    return e.select("application_id", "last_activity_at", scalar.clean_stage_list(padded).alias("stages"))


# -- F7 -------------------------------------------------------------------------------------------

RECORD_SEQUENCE = ("Hiring Manager Review", "Hiring Manager Interview")
RECORD_LIMIT = 40
RECORD_CTE = f"""
record_rows AS (
  SELECT application_id, job_id, current_stage, ifnull(nullif(recruiter, ''), 'Unknown recruiter') AS recruiter,
    ifnull(nullif(office, ''), 'Unknown office') AS office, ifnull(nullif(department, ''), 'Unknown department') AS department
  FROM ops_applications a
  WHERE lower(trim(status)) = 'active' AND ifnull(lower(trim(current_stage)), '') <> '{RECORD_SEQUENCE[-1].lower()}'
    AND EXISTS (SELECT 1 FROM raw_jobs j WHERE {long_sql('j.ghjb_job_id')} = a.job_id)),
record_top AS (
  SELECT recruiter, office, department, count(*) AS n FROM record_rows GROUP BY ALL
  ORDER BY n DESC, recruiter, office, department LIMIT 1)"""


def _record_plan(spark, sf_dir, mode) -> changes.Plan:
    jobs = raw(spark, sf_dir)["jobs"].select(scalar.safe_long("ghjb_job_id").alias("job_id"))
    return changes.plan_record_form(ops_apps(spark, sf_dir), jobs, RECORD_SEQUENCE, RECORD_LIMIT, mode, "req-record")


def _record_items(source: str) -> str:
    return f"""
SELECT 'req-record' AS request_id, application_id, job_id, current_stage, recruiter, office, department,
  {list(RECORD_SEQUENCE)} AS planned_stage_sequence
FROM {source} ORDER BY application_id LIMIT {RECORD_LIMIT}"""


register("plan_record_form", with_ops(_record_items("record_rows JOIN record_top USING (recruiter, office, department)"), RECORD_CTE))(
    lambda spark, sf_dir: _record_plan(spark, sf_dir, MODE_FOCUSED).items)
register("plan_record_form_global", with_ops(_record_items("record_rows"), RECORD_CTE))(
    lambda spark, sf_dir: _record_plan(spark, sf_dir, MODE_GLOBAL).items)
register("plan_record_form_request", with_ops(f"""
SELECT 'req-record' AS request_id, '{MODE_FOCUSED}' AS selection_mode, (SELECT count(*) FROM record_rows) AS eligible_count,
  recruiter, office, department, n AS selected_group_count
FROM record_top""", RECORD_CTE))(lambda spark, sf_dir: _record_plan(spark, sf_dir, MODE_FOCUSED).request)


# -- F8, F9: manual modes ---------------------------------------------------------------------------

UNLIMITED = (None, 1, None)  # every selected id is planned


def _manual_outcome_sql(rid: str, outcome: str, stages) -> str:
    return with_ops(f"""
SELECT '{rid}' AS request_id, application_id, status AS previous_status, current_stage AS previous_stage,
  '{outcome}' AS planned_outcome, 'pending' AS apply_status, CAST(NULL AS VARCHAR) AS error_message,
  CAST(NULL AS TIMESTAMP) AS applied_at
FROM ops_applications WHERE status = 'active' AND current_stage IN {_in(stages)}""")


def _waiting(apps: DataFrame, stages) -> DataFrame:
    return apps.filter((F.col("status") == "active") & F.col("current_stage").isin(list(stages))).select("application_id")


@register("plan_hire_manual", _manual_outcome_sql("req-hire-manual", "hired", HIRE_ELIGIBLE_STAGES))
def q_plan_hire_manual(spark, sf_dir):
    apps = ops_apps(spark, sf_dir)
    return changes.plan_hire(apps, MODE_MANUAL_OUTCOME, None, "Offers signed", _waiting(apps, HIRE_ELIGIBLE_STAGES),
                             "req-hire-manual", bounds=UNLIMITED).items


@register("plan_reject_manual", _manual_outcome_sql("req-reject-manual", "rejected", REJECT_ELIGIBLE_STAGES))
def q_plan_reject_manual(spark, sf_dir):
    apps = ops_apps(spark, sf_dir)
    return changes.plan_reject(apps, MODE_MANUAL_OUTCOME, None, "Jobs closed", _waiting(apps, REJECT_ELIGIBLE_STAGES),
                               "req-reject-manual", bounds=UNLIMITED).items


# -- F12 with two requests, F15, F16 ------------------------------------------------------------------

SECOND = dict(rid="req-hire-2", limit=25, approved_at="2026-01-01 01:00:00")


@register("apply_two_requests", with_ops(f"""
SELECT r.rid AS request_id, application_id, status AS previous_status, current_stage AS previous_stage,
  CASE WHEN r.rid = '{HIRE['rid']}' OR pos > {HIRE['limit']} THEN 'applied' ELSE 'skipped' END AS apply_status,
  CASE WHEN r.rid <> '{HIRE['rid']}' AND pos <= {HIRE['limit']} THEN 'Application is no longer eligible for hiring outcome' END AS error_message
FROM (SELECT *, row_number() OVER (ORDER BY CASE current_stage WHEN 'Offer' THEN 2 WHEN 'Reference Check' THEN 1 ELSE 0 END DESC,
    updated_at ASC NULLS LAST, application_id) AS pos FROM hire_eligible) e
JOIN (VALUES ('{HIRE['rid']}', {HIRE['limit']}), ('{SECOND['rid']}', {SECOND['limit']})) r(rid, most) ON e.pos <= r.most""", HIRE_SQL))
def q_apply_two_requests(spark, sf_dir):
    """Two approved hiring requests that share applications: the later one skips what the first has hired."""
    apps = frozen_apps(spark, sf_dir)
    first = changes.freeze_plan(_plan_hire(apps))
    second = changes.freeze_plan(changes.plan_hire(apps, HIRE["mode"], SECOND["limit"], HIRE["reason"],
                                                   request_id=SECOND["rid"], bounds=(10, 1, 100)))
    requests = changes.approve_requests(first.request, [HIRE["rid"]], APPROVER, AS_OF).unionByName(
        changes.approve_requests(second.request, [SECOND["rid"]], APPROVER, SECOND["approved_at"]))
    done = changes.apply_hire(requests, first.items.unionByName(second.items), apps, AS_OF, changed_by=APPROVER)
    return done.items.select("request_id", "application_id", "previous_status", "previous_stage", "apply_status", "error_message")


@register("audit_rows", with_ops(f"""
SELECT '{APPROVER}' AS email, 'create_hiring_dry_run' AS action, 'outcome_change_request' AS object_type,
  request_id AS object_id, CAST(eligible_count AS VARCHAR) AS eligible_text, reason AS reason_text,
  TIMESTAMP '{AS_OF}' AS created_at
FROM hire_request""", HIRE_SQL))
def q_audit_rows(spark, sf_dir):
    rows = changes.audit_rows(_plan_hire(ops_apps(spark, sf_dir)).request, "create_hiring_dry_run", "outcome_change_request",
                              APPROVER, AS_OF, ("eligible_count", "reason"))
    return rows.select("email", "action", "object_type", "object_id", F.col("payload")["eligible_count"].alias("eligible_text"),
                       F.col("payload")["reason"].alias("reason_text"), "created_at")


@register("record_apply_status", with_ops("""
SELECT request_id, count(*) FILTER (WHERE applies) AS applied_count, CAST(0 AS BIGINT) AS failed_count,
  count(*) FILTER (WHERE NOT applies) AS skipped_count, 'applied' AS status
FROM hire_done GROUP BY request_id
UNION ALL
SELECT request_id, count(*) FILTER (WHERE applies), 0, count(*) FILTER (WHERE NOT applies), 'applied'
FROM reject_done GROUP BY request_id""", APPLY_SQL))
def q_record_apply_status(spark, sf_dir):
    rejected, hired = _reject_then_hire(spark, sf_dir)
    cols = ("request_id", "application_id", "apply_status")
    return changes.record_apply_status(hired.items.select(*cols).unionByName(rejected.items.select(*cols)))


# -- Q7 ---------------------------------------------------------------------------------------------

@register("dq_composite_key", with_base("""
SELECT 'raw_application_events' AS model, 'application_id,last_activity_at' AS column_name, 'unique' AS test,
  count(*) - count(*) FILTER (WHERE n = 1) AS failures
FROM (SELECT count(*) AS n FROM raw_events WHERE application_id IS NOT NULL AND last_activity_at IS NOT NULL
      GROUP BY application_id, last_activity_at)"""))
def q_dq_composite_key(spark, sf_dir):
    return quality.unique(raw(spark, sf_dir)["application_events"], ["application_id", "last_activity_at"],
                          "raw_application_events")
