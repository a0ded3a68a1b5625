"""Serving queries over the marts and the operational table.

A dashboard re-aggregates marts for a scope (offices, departments,
recruiters). Scope filters are plain ``isin`` predicates on mart columns, so
they are pushed into the mart scan when the marts are stored as Parquet.
Results are small (one row per status / stage / recruiter).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.config import (
    HIRE_ELIGIBLE_STAGES,
    REJECT_ELIGIBLE_STAGES,
    ROLE_PRIORITY,
    STATUS_HIRED,
    STATUS_REJECTED,
    UNKNOWN_DEPARTMENT,
    UNKNOWN_OFFICE,
    UNKNOWN_RECRUITER,
)
from talentlake.functions.scalar import format_count, format_days, format_percentage, safe_divide, search_text


# -- P6-P8, P11, P12 -------------------------------------------------------------

def optional_filters(df: DataFrame, **equals) -> DataFrame:
    """``column == value`` for every non-None value, compared as text on both sides."""
    cond: Column = F.lit(True)
    for column, value in equals.items():
        if value is not None and column in df.columns:
            cond = cond & (F.col(column).cast("string") == F.lit(str(value)))
    return df.filter(cond)


def scope(df: DataFrame, offices: Iterable[str] | None = None, departments: Iterable[str] | None = None,
          recruiters: Iterable[str] | None = None) -> DataFrame:
    """Office, department and recruiter name lists (``None`` = no filter; NULL names drop out)."""
    cond: Column = F.lit(True)
    if offices is not None and "office_name" in df.columns:
        cond = cond & F.col("office_name").isin(list(offices))
    if departments is not None and "department_name" in df.columns:
        cond = cond & F.col("department_name").isin(list(departments))
    if recruiters is not None and "recruiter_name" in df.columns:
        cond = cond & F.col("recruiter_name").isin(list(recruiters))
    return df.filter(cond)


def pick_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def lookup_ids(df: DataFrame, ids: DataFrame, key: str = "application_id") -> DataFrame:
    """Rows whose key is in an id set (semi join; the id set is shuffled or broadcast by size)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values of a column, sorted."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


# -- D1-D6 ------------------------------------------------------------------------

SUMMED = (
    "total_jobs", "open_jobs", "closed_jobs", "total_applications", "active_applications", "rejected_applications",
    "hired_applications", "total_offers", "accepted_offers", "recruiter_owned_stage_cases",
    "recruiter_sla_met_cases", "recruiter_sla_breached_cases",
)


def overview_scoped(overview_by_scope: DataFrame, offices=None, departments=None) -> DataFrame:
    """KPI roll-up of a scope: sums, met / owned (NULL if none owned) and a weighted mean time to hire.

    The mean is weighted by the valid time-to-hire count over rows with a
    value and a positive weight, NULL when there are none; rounded to 6 dp.
    """
    d = scope(overview_by_scope, offices, departments)
    weight = "hired_applications_with_valid_time_to_hire"
    if weight not in d.columns:
        weight = "hired_applications"
    usable = F.col("avg_time_to_hire_days").isNotNull() & F.col(weight).isNotNull() & (F.col(weight) > 0)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) if c in d.columns else F.lit(0).cast("bigint").alias(c)
            for c in SUMMED]
    agg = d.agg(
        *sums,
        F.sum(F.when(usable, F.col("avg_time_to_hire_days") * F.col(weight))).alias("_num"),
        F.sum(F.when(usable, F.col(weight))).alias("_den"),
    )
    return agg.select(
        *SUMMED,
        safe_divide(F.col("recruiter_sla_met_cases"), F.col("recruiter_owned_stage_cases"))
        .alias("recruiter_sla_compliance_rate"),
        F.bround(safe_divide(F.col("_num"), F.col("_den")), 6).alias("avg_time_to_hire_days"),
    )


def status_distribution(status_by_scope: DataFrame, offices=None, departments=None) -> DataFrame:
    """D2 (chart): applications per status over the scope."""
    return scope(status_by_scope, offices, departments).groupBy("application_status").agg(
        F.sum("applications_count").alias("applications_count")
    )


def status_table(status_by_scope: DataFrame, offices=None, departments=None) -> DataFrame:
    """D2 (table): status share as a percentage, 1 dp half-even."""
    return scope(status_by_scope, offices, departments).select(
        "office_name", "department_name", "application_status", "applications_count",
        F.bround(F.col("status_share") * F.lit(100.0), 1).alias("status_share"),
    )


def funnel(funnel_by_scope: DataFrame, offices=None, departments=None) -> DataFrame:
    """D3: applications reached per stage over the scope."""
    return scope(funnel_by_scope, offices, departments).groupBy("stage_order", "stage_name").agg(
        F.sum("applications_reached").alias("applications_reached")
    )


def workload_chart(workload: DataFrame, offices=None, departments=None, recruiters=None) -> DataFrame:
    """D4 (chart): per recruiter name."""
    return scope(workload, offices, departments, recruiters).groupBy("recruiter_name").agg(
        F.sum("total_applications").alias("total_applications"),
        F.sum("active_applications").alias("active_applications"),
        F.sum("sla_breached_cases").alias("sla_breached_cases"),
    )


def workload_table(workload: DataFrame, offices=None, departments=None, recruiters=None) -> DataFrame:
    """D4 (table): rate in %, 1 dp; mean duration 2 dp."""
    return scope(workload, offices, departments, recruiters).select(
        "recruiter_name", "office_name", "department_name", "total_applications", "active_applications",
        "jobs_touched", "recruiter_owned_stage_cases", "sla_met_cases", "sla_breached_cases",
        F.bround(F.col("sla_compliance_rate") * F.lit(100.0), 1).alias("sla_compliance_rate"),
        F.bround("avg_recruiter_stage_duration_days", 2).alias("avg_recruiter_stage_duration_days"),
        "total_offers", "accepted_offers",
    )


def performance_table(performance: DataFrame, offices=None, departments=None, recruiters=None) -> DataFrame:
    """D5."""
    return scope(performance, offices, departments, recruiters).select(
        "recruiter_name", "office_name", "department_name", "stage_name", "total_cases", "sla_met_cases",
        "sla_breached_cases",
        F.bround(F.col("sla_compliance_rate") * F.lit(100.0), 1).alias("sla_compliance_rate"),
        F.bround("avg_duration_days", 2).alias("avg_duration_days"),
    )


def breach_table(breaches: DataFrame, offices=None, departments=None, recruiters=None) -> DataFrame:
    """D6."""
    return scope(breaches, offices, departments, recruiters).select(
        "application_id", "candidate_full_name", "job_name", "recruiter_name", "department_name", "office_name",
        "stage_name", F.bround("duration_days", 2).alias("duration_days"), "sla_target_days",
        "application_status", "current_stage",
    )


# -- D7-D9, D11 ---------------------------------------------------------------------------

def display_rows(apps: DataFrame) -> DataFrame:
    """Candidate / job display names with fallbacks; blank values become NULL."""
    def blank_to_null(c: Column) -> Column:
        return F.when(F.trim(c.cast("string")) == "", F.lit(None)).otherwise(c)

    def first_truthy(*cols: Column) -> Column:
        # the first value that is not empty; one of blanks only counts as present and is then dropped
        return blank_to_null(F.coalesce(*[F.nullif(c, F.lit("")) for c in cols]))

    cand = first_truthy(F.col("candidate_full_name"), F.col("candidate_name"),
                        F.when(F.col("candidate_id").isNotNull(), F.concat(F.lit("Candidate "), F.col("candidate_id").cast("string"))))
    job = first_truthy(F.col("job_title"),
                       F.when(F.col("job_id").isNotNull(), F.concat(F.lit("Job "), F.col("job_id").cast("string"))))
    return apps.select(
        "application_id", "candidate_id",
        cand.alias("candidate_display"),
        "job_id",
        job.alias("job_display"),
        blank_to_null(F.col("status")).alias("status"),
        blank_to_null(F.col("current_stage")).alias("current_stage"),
        first_truthy(F.col("office_name"), F.col("office")).alias("office"),
        first_truthy(F.col("department_name"), F.col("department")).alias("department"),
        first_truthy(F.col("recruiter_name"), F.col("recruiter")).alias("recruiter"),
        "updated_at", "created_at", "applied_at",
    )


def _search_blob(display: DataFrame) -> Column:
    # the display row's values in their order, as text (timestamps in ISO form like the UI)
    parts = []
    for c in ("application_id", "candidate_id", "candidate_display", "job_id", "job_display", "status",
              "current_stage", "office", "department", "recruiter"):
        parts.append(F.col(c).cast("string"))
    for c in ("updated_at", "created_at", "applied_at"):
        parts.append(F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss"))
    return search_text(*parts)


def candidate_search(eligible: DataFrame, stages: Sequence[str] | None = None,
                     text: str = "", job: str | None = None, offices: Sequence[str] | None = None,
                     departments: Sequence[str] | None = None, recruiters: Sequence[str] | None = None,
                     cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """Stage → text → job / office / department / recruiter; counts after each step and a capped list.

    ``eligible`` are the applications that can be chosen. One pass computes all step counts (``count_if`` of the cumulative
    predicates); the list is a top-``cap`` by (updated_at, application_id).
    """
    d = display_rows(eligible)
    stage_ok = F.lit(True) if not stages else F.col("current_stage").isin(list(stages))
    needle = (text or "").strip().lower()
    text_ok = F.lit(True) if not needle else _search_blob(d).contains(F.lit(needle))
    scope_ok = F.lit(True)
    if job:
        scope_ok = scope_ok & (F.col("job_display") == F.lit(job))
    if offices is not None:
        scope_ok = scope_ok & F.col("office").isin(list(offices))
    if departments is not None:
        scope_ok = scope_ok & F.col("department").isin(list(departments))
    if recruiters is not None:
        scope_ok = scope_ok & F.col("recruiter").isin(list(recruiters))
    flagged = d.select(
        "*",
        F.coalesce(stage_ok, F.lit(False)).alias("_s1"),
        F.coalesce(stage_ok & text_ok, F.lit(False)).alias("_s2"),
        F.coalesce(stage_ok & text_ok & scope_ok, F.lit(False)).alias("_s3"),
    )
    counts = flagged.agg(
        F.count(F.lit(1)).alias("eligible_count"),
        F.count_if("_s1").alias("after_stage_count"),
        F.count_if("_s2").alias("after_search_count"),
        F.count_if("_s3").alias("after_scope_count"),
    )
    listing = (
        flagged.filter("_s3")
        .orderBy(F.col("updated_at").asc_nulls_first(), F.col("application_id").asc())
        .limit(cap)
        .drop("_s1", "_s2", "_s3")
    )
    return listing, counts


def exclusion_reason(apps: DataFrame, outcome: str) -> DataFrame:
    """Why an application cannot take the outcome ("; "-joined, else "not eligible")."""
    stages = HIRE_ELIGIBLE_STAGES if outcome == STATUS_HIRED else REJECT_ELIGIBLE_STAGES
    status = F.col("status")
    status_reason = (
        F.when(status == STATUS_HIRED, F.lit("already hired"))
        .when(status == STATUS_REJECTED, F.lit("already rejected"))
        .when(F.coalesce(status != "active", F.lit(True)), F.lit("not active"))
    )
    stage_reason = F.when(~F.coalesce(F.col("current_stage").isin(list(stages)), F.lit(False)),
                          F.lit(f"current stage not eligible for {outcome}"))
    joined = F.concat_ws("; ", status_reason, stage_reason)
    return apps.select("application_id", "status", "current_stage",
                       F.when(joined == "", F.lit("not eligible")).otherwise(joined).alias("exclusion_reason"))


def expected_kpi_delta(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Per outcome request, the KPI changes it can cause ("up to n")."""
    per_request = items.groupBy("request_id").agg(F.count(F.lit(1)).alias("_items"))
    r = requests.join(per_request, "request_id", "left")
    n = F.coalesce(F.nullif(F.col("selected_count"), F.lit(0)), F.col("_items"), F.lit(0)).cast("string")
    up_to = F.concat(F.lit("up to "), n)
    outcome = F.coalesce(F.col("outcome"), F.lit("outcome"))
    return r.select(
        "request_id", "status", outcome.alias("outcome"), "selection_mode", "requested_limit", "eligible_count",
        F.coalesce(F.nullif(F.col("selected_count"), F.lit(0)), F.col("_items"), F.lit(0)).alias("selected_count"),
        "reason",
        up_to.alias("expected_active_applications_decrease"),
        F.when(outcome == STATUS_HIRED, up_to).when(outcome == STATUS_REJECTED, F.lit("0")).alias("expected_hired_kpi_increase"),
        F.when(outcome == STATUS_REJECTED, up_to).when(outcome == STATUS_HIRED, F.lit("0")).alias("expected_rejected_kpi_increase"),
    )


# -- O6-O8 -------------------------------------------------------------------------------------

def recent_requests(requests: DataFrame, n: int = 20, outcome: str | None = None, time_col: str = "requested_at") -> DataFrame:
    """Most recent n requests, optionally of one outcome."""
    r = requests if outcome is None else requests.filter(F.col("outcome") == outcome)
    return r.orderBy(F.col(time_col).desc_nulls_last(), F.col("request_id").asc()).limit(n)


def page(df: DataFrame, key: str, limit: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """One page ordered by ``key`` plus the total row count."""
    return df.orderBy(F.col(key).asc()).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("count"))


def page_after(df: DataFrame, key: str, limit: int, after: object = None) -> DataFrame:
    """O7 at scale: the next ``limit`` rows past the last seen ``key`` (each task keeps ``limit`` rows)."""
    rest = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rest.orderBy(F.col(key).asc()).limit(limit)


# -- O1: order of served results ------------------------------------------------------------

# Fixed values: (column, descending) per served result.
SERVING_ORDER = {
    "performance": (("sla_compliance_rate", False), ("avg_duration_days", True)),
    "workload": (("active_applications", True), ("sla_breached_cases", True), ("recruiter_name", False)),
    "status": (("applications_count", True),),
    "funnel": (("stage_order", False),),
    "funnel_by_scope": (("office_name", False), ("department_name", False), ("stage_order", False)),
    "delayed": (("duration_days", True),),
    "applications_by": (("applications", True),),
}


def _order_keys(df: DataFrame, name: str) -> list[Column]:
    """The result's order, then its other columns, so that ties are in a fixed order."""
    listed = SERVING_ORDER[name]
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in listed]
    return keys + [F.col(c).asc_nulls_first() for c in df.columns if c not in {c for c, _ in listed}]


def ordered(df: DataFrame, name: str) -> DataFrame:
    """O1: a served result in its order (NULLs first ascending, last descending; ties by the other columns)."""
    return df.orderBy(*_order_keys(df, name))


def positioned(df: DataFrame, name: str, within: Sequence[str]) -> DataFrame:
    """O1: ``position`` (from 1) of each row in the result's order within its scope."""
    order = Window.partitionBy(*within).orderBy(*_order_keys(df, name))
    return df.withColumn("position", F.row_number().over(order))


# -- display texts (X20) -------------------------------------------------------------------

def kpi_texts(overview_by_scope: DataFrame) -> DataFrame:
    """KPI cards of each scope as display texts."""
    d = overview_by_scope
    return d.select(
        "office_name", "department_name",
        *[format_count(c).alias(c) for c in SUMMED],
        format_days("avg_time_to_hire_days").alias("avg_time_to_hire"),
        format_percentage(safe_divide(F.col("recruiter_sla_met_cases"), F.col("recruiter_owned_stage_cases")))
        .alias("recruiter_sla_compliance"),
    )


# -- W7, D10, A15 ----------------------------------------------------------------------------

def current_role(user_roles: DataFrame) -> DataFrame:
    """Each user's highest-priority active role (grouped ``min_by``; ties by role name)."""
    from talentlake.functions.scalar import lookup

    rank = lookup("role", {r: i + 1 for i, r in enumerate(ROLE_PRIORITY)}, 99)
    active = user_roles.filter(F.col("is_active") == F.lit(True))
    return active.groupBy("user_id").agg(F.min_by("role", F.struct(rank, F.col("role"))).alias("role"))


def item_details(apps: DataFrame, items: DataFrame) -> DataFrame:
    """Display rows of a request's applications with each item's apply status."""
    status = items.select("application_id", F.col("apply_status").alias("item_apply_status"))
    chosen = apps.join(status.select("application_id"), "application_id", "left_semi")
    return display_rows(chosen).join(status, "application_id", "left")


def scope_counts(apps: DataFrame) -> DataFrame:
    """Applications per "recruiter / office / department" key (blank → "Unknown …")."""
    def label(col: str, unknown: str) -> Column:
        return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(unknown))

    key = F.concat_ws(" / ", label("recruiter", UNKNOWN_RECRUITER), label("office", UNKNOWN_OFFICE),
                      label("department", UNKNOWN_DEPARTMENT))
    return apps.groupBy(key.alias("scope")).agg(F.count(F.lit(1)).alias("applications"))
