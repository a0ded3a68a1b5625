"""Fractional-hours model (I6-I13): the earlier pandas semantics, on Spark.

Differences from the warehouse models (kept on purpose, selected by using
this module instead of ``core``):

* durations are fractional hours (micro-second precision), not whole hours;
* the stage of a row is ``previous_stage`` or, for an application's first
  event, ``current_stage``; the first event is kept with a NULL duration;
* the recruiter falls back by *name* (job's, else the candidate's);
* the candidate name is trimmed;
* an empty compliance denominator gives 0, not NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.config import DEFAULT_STAGES, StageConfig
from talentlake.functions.scalar import fractional_hours_between, full_name, in_set, lookup, safe_rate, safe_timestamp
from talentlake.functions.windows import hot_keys, lag_by_key, latest_per_key
from talentlake.operators.core import event_order_tiebreak
from talentlake.operators.staging import EVENT_DEDUP_KEY, stg_events_typed

JOB_CONTEXT_COLUMNS = (
    "ghjb_job_id", "ghjb_job_name", "ghjb_job_status", "ghjb_gh_department_id", "ghjb_gh_department_name",
    "ghjb_gh_office_id", "ghjb_gh_office_name", "ghjb_hiring_manager_id", "ghjb_hiring_manager_name",
    "ghjb_recruiter_id", "ghjb_recruiter_name",
)
CANDIDATE_CONTEXT_COLUMNS = (
    "ghca_candidate_id", "ghca_first_name", "ghca_last_name", "ghca_recruiter_id", "ghca_recruiter_name",
)
APPLICATION_DATE_COLUMNS = ("ghap_applied_at", "ghap_rejected_at", "ghap_last_activity_at")


def enriched_applications(raw_applications: DataFrame, raw_jobs: DataFrame, raw_candidates: DataFrame) -> DataFrame:
    """Applications with job and candidate context; trimmed full name; recruiter name fallback."""
    apps = raw_applications.select(
        *[safe_timestamp(c).alias(c) if c in APPLICATION_DATE_COLUMNS else F.col(c)
          for c in raw_applications.columns if not c.startswith("_")]
    )
    jobs = raw_jobs.select(*JOB_CONTEXT_COLUMNS)
    cands = raw_candidates.select(*CANDIDATE_CONTEXT_COLUMNS)
    joined = apps.join(jobs, apps.ghap_job_id == jobs.ghjb_job_id, "left").join(
        cands, apps.ghap_candidate_id == cands.ghca_candidate_id, "left"
    )
    return joined.select(
        "*",
        full_name("ghca_first_name", "ghca_last_name", trim=True).alias("candidate_full_name"),
        F.coalesce(F.col("ghjb_recruiter_name"), F.col("ghca_recruiter_name")).alias("recruiter_name"),
    )


TRANSITION_COLUMNS = (
    "application_id", "action", "previous_status", "current_status", "previous_stage", "current_stage",
    "last_activity_at", "stage_name", "entered_stage_at", "left_stage_at", "duration_hours", "duration_days",
    "sla_target_days", "is_recruiter_owned_stage", "sla_met",
)


def stage_transitions(raw_events: DataFrame, stages: StageConfig = DEFAULT_STAGES) -> DataFrame:
    """One row per distinct event with the time since the application's previous event."""
    typed = stg_events_typed(raw_events)
    distinct = latest_per_key(typed, EVENT_DEDUP_KEY, [F.col("ingested_at"), F.col("_ingestion_batch_id")])
    ev = distinct.select(
        "application_id", "action", "previous_status", "current_status", "previous_stage", "current_stage", "event_at",
    )
    order = event_order_tiebreak(stages)
    hot = hot_keys(typed, "application_id", "event_at", order)
    ev = lag_by_key(ev, "application_id", "event_at", order, ["event_at"], prefix="entered_", hot=hot)
    stage = F.coalesce(F.col("previous_stage"), F.col("current_stage"))
    hours = fractional_hours_between(F.col("entered_event_at"), F.col("event_at"))
    days = hours / F.lit(24.0)
    target = lookup(stage, {k: float(v) for k, v in stages.sla_days.items()}).cast("double")
    return ev.select(
        "application_id", "action", "previous_status", "current_status", "previous_stage", "current_stage",
        F.col("event_at").alias("last_activity_at"),
        stage.alias("stage_name"),
        F.col("entered_event_at").alias("entered_stage_at"),
        F.col("event_at").alias("left_stage_at"),
        hours.alias("duration_hours"),
        days.alias("duration_days"),
        target.alias("sla_target_days"),
        F.coalesce(in_set(stage, stages.owned), F.lit(False)).alias("is_recruiter_owned_stage"),
        F.when(target.isNotNull() & days.isNotNull(), days <= target).alias("sla_met"),
    )


RECRUITER_SLA_CONTEXT = (
    "ghap_application_id", "candidate_full_name", "ghjb_job_name", "ghjb_gh_department_name",
    "ghjb_gh_office_name", "recruiter_name", "ghap_status",
)


def recruiter_sla_cases(transitions: DataFrame, enriched: DataFrame) -> DataFrame:
    """I8: owned-stage transitions with application context."""
    ctx = enriched.select(*RECRUITER_SLA_CONTEXT).withColumn("_app_key", F.col("ghap_application_id").try_cast("long"))
    owned = transitions.filter(F.col("is_recruiter_owned_stage"))
    return owned.join(ctx, owned.application_id == ctx._app_key, "left").drop("_app_key")


def global_metrics(raw_jobs: DataFrame, enriched: DataFrame, raw_offers: DataFrame, sla_cases: DataFrame) -> DataFrame:
    """Eight KPIs in one row (one aggregate over a tagged union; rate 0 when nothing is valid)."""
    rows = (
        raw_jobs.select(F.lit("job").alias("t"), F.col("ghjb_job_status").alias("v"), F.lit(None).cast("boolean").alias("m"))
        .unionByName(enriched.select(F.lit("app").alias("t"), F.col("ghap_status").alias("v"), F.lit(None).cast("boolean").alias("m")))
        .unionByName(raw_offers.select(F.lit("offer").alias("t"), F.col("ghof_status").alias("v"), F.lit(None).cast("boolean").alias("m")))
        .unionByName(sla_cases.select(F.lit("sla").alias("t"), F.lit(None).cast("string").alias("v"), F.col("sla_met").alias("m")))
    )
    t, v, m = F.col("t"), F.col("v"), F.col("m")
    agg = rows.agg(
        F.count_if((t == "job") & (v == "open")).alias("open_jobs"),
        F.count_if(t == "app").alias("total_applications"),
        F.count_if((t == "app") & (v == "active")).alias("active_applications"),
        F.count_if((t == "app") & (v == "rejected")).alias("rejected_applications"),
        F.count_if((t == "app") & (v == "hired")).alias("hired_applications"),
        F.count_if((t == "offer") & (v == "accepted")).alias("accepted_offers"),
        F.count_if((t == "sla") & m.isNotNull() & m).alias("_met"),
        F.count_if((t == "sla") & m.isNotNull()).alias("recruiter_sla_total_cases"),
    )
    return agg.select(
        "open_jobs", "total_applications", "active_applications", "rejected_applications", "hired_applications",
        "accepted_offers",
        safe_rate(F.col("_met"), F.col("recruiter_sla_total_cases")).alias("recruiter_sla_compliance_rate"),
        "recruiter_sla_total_cases",
    )


def applications_by(enriched: DataFrame, column: str) -> DataFrame:
    """Group sizes with NULL kept as a group (sort by size when serving)."""
    return enriched.groupBy(column).agg(F.count(F.lit(1)).alias("applications"))


def recruiter_sla_summary(sla_cases: DataFrame) -> DataFrame:
    """Per recruiter name and stage: cases, mean days (2 dp), compliance % (1 dp), half-even."""
    valid = sla_cases.filter(F.col("sla_met").isNotNull())
    return valid.groupBy("recruiter_name", "stage_name").agg(
        F.count("application_id").alias("cases"),
        # mean of fractional days from the exact micro-second total (engine-independent rounding input)
        F.bround(
            F.try_divide(
                F.sum(F.unix_micros("left_stage_at") - F.unix_micros("entered_stage_at")).cast("double"),
                F.count("duration_days").cast("double"),
            ) / F.lit(3.6e9) / F.lit(24.0),
            2,
        ).alias("avg_duration_days"),
        F.bround(F.avg(F.col("sla_met").cast("int")) * F.lit(100.0), 1).alias("sla_compliance_rate"),
    )


def delayed_cases(sla_cases: DataFrame) -> DataFrame:
    """Breached cases with names, duration rounded to 2 dp (sort by duration when serving)."""
    late = sla_cases.filter((F.col("sla_met") == F.lit(False)) & F.col("duration_days").isNotNull())
    return late.select(
        "application_id", "candidate_full_name", "ghjb_job_name", "ghjb_gh_department_name", "ghjb_gh_office_name",
        "recruiter_name", "stage_name", F.bround("duration_days", 2).alias("duration_days"), "sla_target_days",
    )


def scope_filter(df: DataFrame, offices: Iterable[str] | None, departments: Iterable[str] | None,
                 office_col: str = "ghjb_gh_office_name", department_col: str = "ghjb_gh_department_name") -> DataFrame:
    """Rows whose office and department names are in the lists (a ``None`` list means no filter)."""
    cond: Column = F.lit(True)
    if offices is not None and office_col in df.columns:
        cond = cond & F.col(office_col).isin(list(offices))
    if departments is not None and department_col in df.columns:
        cond = cond & F.col(department_col).isin(list(departments))
    return df.filter(cond)


def global_metrics_scoped(raw_jobs: DataFrame, enriched: DataFrame, raw_offers: DataFrame, sla_cases: DataFrame,
                          offices: Iterable[str] | None, departments: Iterable[str] | None) -> DataFrame:
    """Only applications and SLA cases are scoped; jobs and offers stay global."""
    return global_metrics(raw_jobs, scope_filter(enriched, offices, departments), raw_offers,
                          scope_filter(sla_cases, offices, departments))
