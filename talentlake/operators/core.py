"""Core dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.config import DEFAULT_STAGES, STATUS_ACTIVE, STATUS_HIRED, STATUS_REJECTED, StageConfig
from talentlake.functions.scalar import in_set, lookup, stage_rank, surrogate_key, whole_units_between
from talentlake.functions.windows import HotKeys, lag_by_key


def dim_candidate(stg_candidates: DataFrame) -> DataFrame:
    """C7."""
    return (
        stg_candidates.filter(F.col("candidate_id").isNotNull())
        .select("candidate_id", "first_name", "last_name", "candidate_full_name",
                "recruiter_id", "recruiter_name", "created_at", "updated_at")
        .distinct()
    )


DIM_JOB_COLUMNS = (
    "job_id", "job_name", "requisition_id", "job_status", "department_id", "department_name",
    "office_id", "office_name", "hiring_manager_id", "hiring_manager_name", "recruiter_id",
    "recruiter_name", "employment_type", "budget_owner", "executive", "fte", "job_type",
    "created_at", "opened_at", "closed_at",
)


def dim_job(stg_jobs: DataFrame) -> DataFrame:
    """C8."""
    return stg_jobs.filter(F.col("job_id").isNotNull()).select(*DIM_JOB_COLUMNS).distinct()


def dim_office(stg_jobs: DataFrame) -> DataFrame:
    """C9."""
    return stg_jobs.filter(F.col("office_id").isNotNull()).select("office_id", "office_name").distinct()


def dim_department(stg_jobs: DataFrame) -> DataFrame:
    """One name per id, the smallest non-NULL one (partial-aggregable ``min``)."""
    return (
        stg_jobs.filter(F.col("department_id").isNotNull())
        .groupBy("department_id")
        .agg(F.min("department_name").alias("department_name"))
    )


def dim_recruiter(stg_jobs: DataFrame, stg_candidates: DataFrame) -> DataFrame:
    """C11: distinct (id, name) pairs from jobs and candidates (unique on the pair, not the id)."""
    from_jobs = stg_jobs.select("recruiter_id", "recruiter_name")
    from_candidates = stg_candidates.select("recruiter_id", "recruiter_name")
    return from_jobs.unionByName(from_candidates).filter(F.col("recruiter_id").isNotNull()).distinct()


def fact_application(stg_applications: DataFrame, stg_jobs: DataFrame, stg_candidates: DataFrame) -> DataFrame:
    """C12.

    Recruiter = the job's, else the candidate's. ``hired_at`` only for hired
    applications (falling back to the last activity); time to hire in whole
    24-hour days, NULL when negative or incomplete. Status flags never NULL.
    """
    a = stg_applications.alias("a")
    j = stg_jobs.select("job_id", "recruiter_id", "department_id", "office_id").alias("j")
    c = stg_candidates.select("candidate_id", "recruiter_id").alias("c")
    hired = F.col("a.application_status") == STATUS_HIRED
    hired_or_last = F.coalesce(F.col("a.hired_at"), F.col("a.last_activity_at"))
    days = whole_units_between("DAY", F.col("a.applied_at"), hired_or_last)
    return (
        a.join(j, F.col("a.job_id") == F.col("j.job_id"), "left")
        .join(c, F.col("a.candidate_id") == F.col("c.candidate_id"), "left")
        .filter(F.col("a.application_id").isNotNull())
        .select(
            F.col("a.application_id"),
            F.col("a.candidate_id"),
            F.col("a.job_id"),
            F.coalesce(F.col("j.recruiter_id"), F.col("c.recruiter_id")).alias("recruiter_id"),
            F.col("j.department_id"),
            F.col("j.office_id"),
            F.col("a.application_status"),
            F.col("a.current_stage"),
            F.col("a.application_source"),
            F.col("a.rejection_reason"),
            F.col("a.applied_at"),
            F.col("a.rejected_at"),
            F.col("a.last_activity_at"),
            F.when(hired, hired_or_last).alias("hired_at"),
            F.when(hired & F.col("a.applied_at").isNotNull() & hired_or_last.isNotNull() & (days >= 0), days)
            .alias("time_to_hire_days"),
            F.col("a.jobs_count"),
            F.coalesce(F.col("a.application_status") == STATUS_ACTIVE, F.lit(False)).alias("is_active"),
            F.coalesce(F.col("a.application_status") == STATUS_REJECTED, F.lit(False)).alias("is_rejected"),
            F.coalesce(hired, F.lit(False)).alias("is_hired"),
        )
    )


def fact_offer(stg_offers: DataFrame, fact_app: DataFrame) -> DataFrame:
    """C13."""
    o = stg_offers.alias("o")
    a = fact_app.select("application_id", "candidate_id", "job_id", "recruiter_id", "department_id", "office_id").alias("a")
    return (
        o.join(a, F.col("o.application_id") == F.col("a.application_id"), "left")
        .filter(F.col("o.offer_id").isNotNull())
        .select(
            F.col("o.offer_id"),
            F.col("o.application_id"),
            F.col("a.candidate_id"),
            F.col("a.job_id"),
            F.col("a.recruiter_id"),
            F.col("a.department_id"),
            F.col("a.office_id"),
            F.col("o.offer_status"),
            F.col("o.created_at"),
            F.col("o.updated_at"),
            F.col("o.resolved_at"),
            F.col("o.starts_at"),
            F.coalesce(F.col("o.offer_status") == "accepted", F.lit(False)).alias("is_accepted"),
        )
    )


def event_order_tiebreak(stages: StageConfig = DEFAULT_STAGES) -> list:
    """Complete order for events of one application sharing a timestamp.

    Stage rank of the previous and current stage, then the action and the
    remaining de-duplication key columns (unique after C1).
    """
    return [
        stage_rank("previous_stage", stages.order),
        stage_rank("current_stage", stages.order),
        F.col("action"),
        F.col("previous_stage"),
        F.col("current_stage"),
        F.col("previous_status"),
        F.col("current_status"),
    ]


STAGE_TRANSITION_COLUMNS = (
    "stage_transition_id", "application_id", "action", "previous_status", "current_status", "stage_name",
    "previous_stage", "current_stage", "stage_started_at", "stage_ended_at", "duration_hours", "duration_days",
    "is_recruiter_owned_stage", "sla_target_days", "ingested_at", "candidate_id", "job_id", "recruiter_id",
    "department_id", "office_id", "sla_met",
)


def fact_stage_transition(
    stg_events_df: DataFrame,
    fact_app: DataFrame,
    stages: StageConfig = DEFAULT_STAGES,
    id_hash: str = "xxhash64",
    hot: HotKeys | None = None,
) -> DataFrame:
    """C14: interval between consecutive events of an application.

    The stage is the previous event's ``previous_stage`` side, i.e. the row
    describes time spent in ``previous_stage`` from the preceding event (of
    any kind) to this one. The preceding event is found over all events; rows
    without one or without a previous stage are dropped. Durations are whole
    hours; days = hours / 24. ``sla_met`` is NULL for stages without a target.

    ``hot``: applications whose events are split over tasks (default: a sketch of the events).
    ``id_hash``: ``xxhash64`` (64-bit surrogate) or ``md5`` (text, engine-portable).
    """
    # a row without a time ends no interval and starts none
    events = stg_events_df.filter(F.col("event_at").isNotNull()).select(
        "application_id", "action", "previous_status", "current_status",
        "previous_stage", "current_stage", "event_at", "ingested_at",
    )
    events = lag_by_key(
        events, "application_id", "event_at", event_order_tiebreak(stages), ["event_at"],
        prefix="previous_", hot=hot,
    )
    owned = in_set("previous_stage", stages.owned)
    hours = whole_units_between("HOUR", F.col("previous_event_at"), F.col("event_at"))
    durations = events.filter(F.col("previous_event_at").isNotNull() & F.col("previous_stage").isNotNull()).select(
        "application_id", "action", "previous_status", "current_status",
        F.col("previous_stage").alias("stage_name"),
        "previous_stage", "current_stage",
        F.col("previous_event_at").alias("stage_started_at"),
        F.col("event_at").alias("stage_ended_at"),
        hours.alias("duration_hours"),
        (hours / F.lit(24.0)).alias("duration_days"),
        F.coalesce(owned, F.lit(False)).alias("is_recruiter_owned_stage"),
        lookup("previous_stage", {k: float(v) for k, v in stages.sla_days.items()}).cast("double").alias("sla_target_days"),
        "ingested_at",
    )
    apps = fact_app.select("application_id", "candidate_id", "job_id", "recruiter_id", "department_id", "office_id")
    joined = durations.join(apps, on="application_id", how="left")
    if id_hash == "md5":
        parts = F.concat_ws(
            "|",
            F.col("application_id").cast("string"),
            F.coalesce(F.col("stage_name"), F.lit("")),
            F.coalesce(F.unix_micros("stage_started_at").cast("string"), F.lit("")),
            F.coalesce(F.unix_micros("stage_ended_at").cast("string"), F.lit("")),
        )
        tid = F.md5(parts)
    else:
        tid = surrogate_key("application_id", "stage_name", "stage_started_at", "stage_ended_at")
    return joined.select(
        tid.alias("stage_transition_id"),
        *[c for c in STAGE_TRANSITION_COLUMNS if c not in ("stage_transition_id", "sla_met")],
        F.when(F.col("sla_target_days").isNull(), F.lit(None).cast("boolean"))
        .otherwise(F.col("duration_days") <= F.col("sla_target_days"))
        .alias("sla_met"),
    )
