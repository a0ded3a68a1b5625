"""Registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and their SQL oracles.

Every query reads the driver tables of ``sf_dir`` through the adapter, so
its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentlake.config import DRIVER_TABLE_STAGES, OPERATIONAL_SOURCE_MARKER
from talentlake.oracle import AS_OF, with_base
from talentlake.plans.warehouse import CUBE_MARTS, Warehouse
from talentlake.session import ensure_session_defaults, stored
from talentlake.sources.driver_tables import RawTables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    ensure_session_defaults(spark)
    return Warehouse(RawTables(spark, sf_dir), DRIVER_TABLE_STAGES, as_of=AS_OF, transition_id_hash="md5")


def facts_written(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The models with ``fact_application`` written once, for those that read it several times."""
    w = warehouse(spark, sf_dir)
    w.__dict__["fact_application"] = stored(w.fact_application, "fact_application")
    return w


def register(name: str, oracle: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def _model_query(name: str, model: str, oracle_select: str) -> None:
    register(name, with_base(oracle_select))(lambda spark, sf_dir: warehouse(spark, sf_dir).model(model))


# -- staging and core (C1-C14) ------------------------------------------------------

for _key, _model in [
    ("stg_events_dedup", "stg_events"),
    ("stg_applications", "stg_applications"),
    ("stg_candidates", "stg_candidates"),
    ("stg_jobs", "stg_jobs"),
    ("stg_offers", "stg_offers"),
    ("stg_openings", "stg_openings"),
    ("dim_candidate", "dim_candidate"),
    ("dim_job", "dim_job"),
    ("dim_office", "dim_office"),
    ("dim_department", "dim_department"),
    ("dim_recruiter", "dim_recruiter"),
    ("fact_application", "fact_application"),
    ("fact_offer", "fact_offer"),
    ("fact_stage_transition", "fact_stage_transition"),
]:
    _model_query(_key, _model, f"SELECT * FROM {_model}")


# -- marts (K1-K9) -----------------------------------------------------------------------
# The oracles count rows of long tables (one row per fact, tagged), not joined pre-aggregates.

_OPERATIONAL = f"'{OPERATIONAL_SOURCE_MARKER}'"

K1_SQL = """
, seen AS (
  SELECT office_id, department_id, application_status, application_id,
    ifnull((SELECT min(j.office_name) FROM dim_job j WHERE j.job_id = f.job_id), 'Unknown office') AS office_name,
    ifnull((SELECT min(j.department_name) FROM dim_job j WHERE j.job_id = f.job_id), 'Unknown department') AS department_name
  FROM fact_application f
), sized AS (
  SELECT office_id, office_name, department_id, department_name, application_status, count(*) AS applications_count
  FROM (SELECT DISTINCT * FROM seen) GROUP BY ALL
)
SELECT g.*, CAST(g.applications_count AS DOUBLE) / CAST((SELECT sum(o.applications_count) FROM sized o
    WHERE o.office_id IS NOT DISTINCT FROM g.office_id AND o.department_id IS NOT DISTINCT FROM g.department_id) AS DOUBLE) AS status_share
FROM sized g
"""

# One row per job, application, offer and owned stage of a scope.
_TALLY = f"""
, tally AS (
  SELECT 'job' AS kind, office_id AS o, department_id AS d, job_status AS tag, NULL::BIGINT AS days, NULL::BOOLEAN AS operational FROM dim_job
  UNION ALL
  SELECT 'application', office_id, department_id,
    CASE WHEN is_hired THEN 'hired' WHEN is_rejected THEN 'rejected' WHEN is_active THEN 'active' END,
    CASE WHEN is_hired THEN time_to_hire_days END, application_source IS NOT DISTINCT FROM {_OPERATIONAL}
  FROM fact_application
  UNION ALL
  SELECT 'offer', office_id, department_id, CASE WHEN is_accepted THEN 'accepted' END, NULL, NULL FROM fact_offer
  UNION ALL
  SELECT 'owned', office_id, department_id, CASE sla_met WHEN true THEN 'met' WHEN false THEN 'breached' END, NULL, NULL
  FROM fact_stage_transition WHERE is_recruiter_owned_stage
)"""


def _tally_columns() -> str:
    """Each measure as a filtered count of the tally."""
    tagged = {
        "total_jobs": ("job", None), "open_jobs": ("job", "open"), "closed_jobs": ("job", "closed"),
        "total_applications": ("application", None), "active_applications": ("application", "active"),
        "rejected_applications": ("application", "rejected"), "hired_applications": ("application", "hired"),
        "total_offers": ("offer", None), "accepted_offers": ("offer", "accepted"),
        "recruiter_owned_stage_cases": ("owned", None), "recruiter_sla_met_cases": ("owned", "met"),
        "recruiter_sla_breached_cases": ("owned", "breached"),
    }
    cols = [
        f"count(*) FILTER (kind = '{kind}'{f" AND tag = '{tag}'" if tag else ''}) AS {name}" for name, (kind, tag) in tagged.items()
    ]
    cols += [
        "count(days) AS hired_applications_with_valid_time_to_hire",
        "count(days) FILTER (NOT operational) AS historical_hired_applications_with_valid_time_to_hire",
        "count(days) FILTER (operational) AS supabase_outcome_hired_applications_with_valid_time_to_hire",
        "CAST(sum(days) AS DOUBLE) / nullif(count(days), 0) AS avg_time_to_hire_days",
        "CAST(count(*) FILTER (kind = 'owned' AND tag = 'met') AS DOUBLE) / nullif(count(*) FILTER (kind = 'owned'), 0)"
        " AS recruiter_sla_compliance_rate",
    ]
    return ",\n  ".join(cols)


K2_SQL = f"""{_TALLY}
SELECT TIMESTAMP '{AS_OF}' AS generated_at, {_tally_columns()}
FROM tally
"""

K3_SQL = f"""{_TALLY}
SELECT TIMESTAMP '{AS_OF}' AS generated_at, office_id, ifnull(office_name, 'Unknown office') AS office_name,
  department_id, ifnull(department_name, 'Unknown department') AS department_name,
  {_tally_columns()}
FROM (SELECT office_id, office_name, department_id, department_name FROM dim_job GROUP BY ALL) AS place
JOIN tally ON tally.o = place.office_id AND tally.d = place.department_id
GROUP BY place.office_id, place.office_name, place.department_id, place.department_name
"""

K4_SQL = """
, owned AS (
  SELECT recruiter_id, department_id, office_id, job_id, stage_name, sla_target_days, duration_hours AS h,
    CASE sla_met WHEN true THEN 1 WHEN false THEN 0 END AS met
  FROM fact_stage_transition WHERE is_recruiter_owned_stage
), named AS (
  SELECT owned.* EXCLUDE (job_id), dim_recruiter.recruiter_name, dim_job.department_name, dim_job.office_name
  FROM owned LEFT JOIN dim_recruiter USING (recruiter_id) LEFT JOIN dim_job ON dim_job.job_id = owned.job_id
)
SELECT * EXCLUDE (h, met), count(*) AS total_cases, CAST(sum(h) AS DOUBLE) / count(h) / 24.0 AS avg_duration_days,
  count(*) FILTER (met = 1) AS sla_met_cases, count(*) FILTER (met = 0) AS sla_breached_cases,
  CAST(count(*) FILTER (met = 1) AS DOUBLE) / count(*) AS sla_compliance_rate
FROM named GROUP BY ALL
"""

# Rows that a recruiter's scope holds; scopes without a key hold applications and jobs only.
K5_SQL = """
, work AS (
  SELECT DISTINCT 'application' AS kind, application_id AS id, recruiter_id, office_id, department_id,
    CASE WHEN is_hired THEN 'hired' WHEN is_rejected THEN 'rejected' WHEN is_active THEN 'active' END AS tag, NULL::BIGINT AS h
  FROM fact_application
  UNION ALL
  SELECT DISTINCT 'job', job_id, recruiter_id, office_id, department_id, NULL, NULL FROM fact_application WHERE job_id IS NOT NULL
  UNION ALL
  SELECT 'owned', application_id, recruiter_id, office_id, department_id,
    CASE sla_met WHEN true THEN 'met' WHEN false THEN 'breached' END, duration_hours
  FROM fact_stage_transition
  WHERE is_recruiter_owned_stage AND recruiter_id + office_id + department_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'offer', offer_id, recruiter_id, office_id, department_id, CASE WHEN is_accepted THEN 'accepted' END, NULL
  FROM fact_offer WHERE recruiter_id + office_id + department_id IS NOT NULL
), scopes AS (
  SELECT recruiter_id, office_id, department_id,
    count(*) FILTER (kind = 'application') AS total_applications, count(*) FILTER (tag = 'active') AS active_applications,
    count(*) FILTER (tag = 'rejected') AS rejected_applications, count(*) FILTER (tag = 'hired') AS hired_applications,
    count(*) FILTER (kind = 'job') AS jobs_touched, count(*) FILTER (kind = 'owned') AS recruiter_owned_stage_cases,
    count(*) FILTER (tag = 'met') AS sla_met_cases, count(*) FILTER (tag = 'breached') AS sla_breached_cases,
    CAST(sum(h) AS DOUBLE) / nullif(count(h), 0) / 24.0 AS avg_recruiter_stage_duration_days,
    CAST(count(*) FILTER (tag = 'met') AS DOUBLE) / nullif(count(*) FILTER (kind = 'owned'), 0) AS sla_compliance_rate,
    count(DISTINCT id) FILTER (kind = 'offer') AS total_offers, count(DISTINCT id) FILTER (tag = 'accepted') AS accepted_offers
  FROM work GROUP BY recruiter_id, office_id, department_id HAVING bool_or(kind = 'application')
)
SELECT scopes.*,
  ifnull((SELECT min(recruiter_name) FROM dim_recruiter r WHERE r.recruiter_id = scopes.recruiter_id), 'Unknown recruiter') AS recruiter_name,
  ifnull((SELECT min(office_name) FROM dim_office p WHERE p.office_id = scopes.office_id), 'Unknown office') AS office_name,
  ifnull((SELECT min(department_name) FROM dim_department p WHERE p.department_id = scopes.department_id), 'Unknown department') AS department_name
FROM scopes
"""


def _stage_order_sql(col: str) -> str:
    from talentlake.oracle import rank_sql

    return f"CAST({rank_sql(col, DRIVER_TABLE_STAGES.order, str(DRIVER_TABLE_STAGES.unknown_order))} AS BIGINT)"


K6_SQL = f"""
SELECT {_stage_order_sql('stage_name')} AS stage_order, stage_name, count(application_id) AS applications_reached
FROM (SELECT DISTINCT application_id, current_stage AS stage_name FROM stg_events) WHERE stage_name IS NOT NULL GROUP BY stage_name
"""

K7_SQL = f"""
, reached AS (
  SELECT DISTINCT f.office_id, f.department_id, f.job_id, application_id, e.current_stage AS stage_name
  FROM fact_application f JOIN stg_events e USING (application_id)
), named AS (
  SELECT DISTINCT r.office_id, ifnull(j.office_name, 'Unknown office') AS office_name, r.department_id,
    ifnull(j.department_name, 'Unknown department') AS department_name, stage_name, application_id
  FROM reached r LEFT JOIN dim_job j ON j.job_id = r.job_id WHERE stage_name IS NOT NULL
)
SELECT office_id, office_name, department_id, department_name, {_stage_order_sql('stage_name')} AS stage_order, stage_name,
  count(*) AS applications_reached
FROM named GROUP BY ALL
"""

K8_SQL = """
, late AS (SELECT * FROM fact_stage_transition WHERE NOT sla_met AND is_recruiter_owned_stage),
subject AS (
  SELECT f.application_id, f.candidate_id, f.job_id, f.application_status, f.current_stage, p.candidate_full_name,
    j.job_name, j.department_name, j.office_name
  FROM fact_application f
  LEFT JOIN dim_candidate p ON p.candidate_id = f.candidate_id
  LEFT JOIN dim_job j ON j.job_id = f.job_id
)
SELECT application_id, s.candidate_id, candidate_full_name, s.job_id, job_name, recruiter_id, recruiter_name, late.department_id,
  department_name, late.office_id, office_name, stage_name, stage_started_at, stage_ended_at, duration_days, sla_target_days,
  application_status, s.current_stage
FROM late LEFT JOIN subject s USING (application_id) LEFT JOIN dim_recruiter USING (recruiter_id)
"""

K9_SQL = f"""
, hire AS (SELECT time_to_hire_days AS days, application_source IS NOT DISTINCT FROM {_OPERATIONAL} AS operational
  FROM fact_application WHERE is_hired)
SELECT TIMESTAMP '{AS_OF}' AS generated_at, count(*) AS total_hired_applications,
  count(days) AS hired_applications_with_valid_time_to_hire,
  CAST(sum(days) AS DOUBLE) / nullif(count(days), 0) AS avg_time_to_hire_days,
  count(days) FILTER (NOT operational) AS historical_hired_applications_included,
  count(days) FILTER (operational) AS supabase_outcome_hired_applications_included,
  count(*) - count(days) AS hired_applications_excluded_from_avg
FROM hire
"""


def _cte_select(sql: str) -> str:
    """Marts whose oracle adds CTEs start with ``, name AS (...)``."""
    sql = sql.strip()
    if sql.startswith(","):
        head, _, tail = sql[1:].rpartition("\nSELECT ")
        return with_base("SELECT " + tail, extra_ctes=head)
    return with_base(sql)


MART_SQL = {
    "mart_status_by_scope": K1_SQL,
    "mart_exec_overview": K2_SQL,
    "mart_exec_overview_by_scope": K3_SQL,
    "mart_recruiter_performance": K4_SQL,
    "mart_recruiter_workload": K5_SQL,
    "mart_funnel": K6_SQL,
    "mart_funnel_by_scope": K7_SQL,
    "mart_sla_breaches": K8_SQL,
    "mart_tth_diagnostics": K9_SQL,
}
SEVERAL_FACT_READS = ("mart_exec_overview", "mart_exec_overview_by_scope", "mart_recruiter_workload")
for _model, _sql in MART_SQL.items():
    register(_model, _cte_select(_sql))(
        (lambda m, models: (lambda spark, sf_dir: models(spark, sf_dir).model(m)))(
            _model, facts_written if _model in SEVERAL_FACT_READS else warehouse)
    )


for _model in CUBE_MARTS:
    # the same marts from one scan of each fact (grouping sets)
    register(_model.replace("mart_", "cube_"), _cte_select(MART_SQL[_model]))(
        (lambda m: lambda spark, sf_dir: facts_written(spark, sf_dir).from_cube(m))(_model))


from talentlake.plans import catalog_ops  # noqa: E402,F401  (registers workflow queries)
from talentlake.plans import catalog_serve  # noqa: E402,F401  (registers fractional and serving queries)
from talentlake.plans import catalog_quality  # noqa: E402,F401  (registers data-quality queries)
from talentlake.plans import catalog_streaming  # noqa: E402,F401  (registers streaming queries)
from talentlake.plans import catalog_more  # noqa: E402,F401  (registers filters, orders, texts, manual plans, audit rows)
from talentlake.plans import catalog_tables  # noqa: E402,F401  (registers stored tables: merges, logs, pages, catalog layers)
