"""Ingestion transforms between the operational store and the raw layer.

All of them are projections, joins and grouped minima over whole tables;
none iterates on the driver. Source columns are picked schema-tolerantly
(the first of several candidate names that exists, P11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.config import NULL_MARKER, OPERATIONAL_SOURCE_MARKER
from talentlake.functions.scalar import first_present, first_truthy, safe_long, safe_timestamp, uuid5
from talentlake.functions.windows import latest_per_key
from talentlake.sources.raw import normalise_raw

# Prefix of the seed event-id name and seed provenance labels.
SEED_EVENT_ID_PREFIX = "mock_greenhouse_seed"
SEED_SOURCE = "mock_api_seed"


def pick(df: DataFrame, *names: str) -> list[Column]:
    """Columns among ``names`` that exist in ``df`` (in the given order)."""
    return [F.col(n) for n in names if n in df.columns]


def _first(df: DataFrame, *names: str, lenient: bool = True) -> Column:
    cols = pick(df, *names)
    if not cols:
        return F.lit(None).cast("string")
    return first_present(*cols) if lenient else first_truthy(*cols)


# -- I1 --------------------------------------------------------------------------

def derive_hired_at(applications: DataFrame) -> DataFrame:
    """Add ``ghap_hired_at`` = last activity (else updated_at) when the status is hired (any case)."""
    status = F.lower(F.coalesce(first_truthy(*pick(applications, "ghap_status", "status")), F.lit("")))
    activity = first_truthy(*pick(applications, "ghap_last_activity_at", "last_activity_at", "updated_at"))
    return applications.withColumn("ghap_hired_at", F.when(status == "hired", activity).cast("string"))


# -- I2 / I3 ---------------------------------------------------------------------

def _earliest_text(events: DataFrame, value_filter: Column | None = None) -> DataFrame:
    """Earliest ``changed_at`` per application, compared as text."""
    ev = events.filter(F.col("application_id").isNotNull() & F.col("changed_at").isNotNull())
    if value_filter is not None:
        ev = ev.filter(value_filter)
    return ev.groupBy("application_id").agg(F.min(F.col("changed_at").cast("string")).alias("first_at"))


# Columns of the operational table that ``ops_to_applications`` reads.
REINGESTED_COLUMNS = ("application_id", "candidate_id", "job_id", "current_stage", "status", "applied_at", "created_at", "hired_at", "updated_at")


def first_events(status_events: DataFrame, stage_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events that ``ops_to_applications`` needs: per application the first "hired" one and the first stage event."""
    hired = _earliest_text(status_events, F.lower(F.coalesce(F.col("new_status").cast("string"), F.lit(""))) == "hired")
    staged = _earliest_text(stage_events)
    return (hired.select("application_id", F.lit("hired").alias("new_status"), F.col("first_at").alias("changed_at")),
            staged.select("application_id", F.col("first_at").alias("changed_at")))


def ops_to_applications(
    ops_applications: DataFrame,
    status_events: DataFrame,
    stage_events: DataFrame,
    batch_id: str,
    ingested_at: str,
) -> DataFrame:
    """Operational applications → raw applications rows.

    hired_at: column, else the first "hired" status event, else updated_at
    when hired. applied_at: column, else created_at, else the first stage
    event. last activity = hired_at for hired applications, else updated_at.
    """
    hired_first = _earliest_text(
        status_events, F.lower(F.coalesce(F.col("new_status").cast("string"), F.lit(""))) == "hired"
    ).withColumnRenamed("first_at", "first_hired_at")
    staged_first = _earliest_text(stage_events).withColumnRenamed("first_at", "first_stage_at")
    a = ops_applications.join(hired_first, "application_id", "left").join(staged_first, "application_id", "left")
    status = F.lower(F.coalesce(F.col("status").cast("string"), F.lit("")))
    hired_at = first_truthy(F.col("hired_at"), F.col("first_hired_at"))
    hired_at = F.when((status == "hired") & hired_at.isNull(), first_truthy(F.col("updated_at"))).otherwise(hired_at)
    applied_at = first_truthy(F.col("applied_at"), F.col("created_at"), F.col("first_stage_at"))
    last_activity = F.when((status == "hired") & hired_at.isNotNull(), hired_at).otherwise(
        F.col("updated_at").cast("string")
    )
    records = a.select(
        F.col("application_id").cast("string").alias("ghap_application_id"),
        F.col("candidate_id").cast("string").alias("ghap_candidate_id"),
        F.col("job_id").cast("string").alias("ghap_job_id"),
        applied_at.alias("ghap_applied_at"),
        F.lit(None).cast("string").alias("ghap_rejected_at"),
        last_activity.alias("ghap_last_activity_at"),
        hired_at.alias("ghap_hired_at"),
        F.lit(OPERATIONAL_SOURCE_MARKER).alias("ghap_source"),
        F.lit(None).cast("string").alias("ghap_rejection_reason"),
        F.col("status").cast("string").alias("ghap_status"),
        F.col("current_stage").alias("ghap_application_current_stage"),
        F.lit(None).cast("string").alias("ghap_jobs_count"),
    )
    return normalise_raw(records, "applications", batch_id, ingested_at, source_system=OPERATIONAL_SOURCE_MARKER,
                         loaded_by="operational_sync", marker=None)


def ops_to_events(stage_events: DataFrame, batch_id: str, ingested_at: str,
                  organization_name: str = "Operational source") -> DataFrame:
    """Operational stage events → raw webhook-shaped events (statuses fixed to active)."""
    records = stage_events.select(
        F.lit(None).cast("string").alias("organization_id"),
        F.lit(organization_name).alias("organization_name"),
        F.lit("candidate_stage_change").alias("action"),
        F.col("application_id").cast("string").alias("application_id"),
        F.lit("active").alias("previous_status"),
        F.lit("active").alias("current_status"),
        F.col("changed_at").cast("string").alias("last_activity_at"),
        F.lit(None).cast("string").alias("rejected_at"),
        F.lit(None).cast("string").alias("rejection_reason"),
        F.lit(None).cast("string").alias("rejection_details"),
        F.col("previous_stage"),
        F.col("new_stage").alias("current_stage"),
    )
    return normalise_raw(records, "application_stage_events", batch_id, ingested_at,
                         source_system=OPERATIONAL_SOURCE_MARKER, loaded_by="operational_sync", marker=None)


# -- I4 / I5 ---------------------------------------------------------------------

OPS_APPLICATION_COLUMNS = (
    "application_id", "candidate_id", "job_id", "candidate_full_name", "candidate_name", "job_title",
    "current_stage", "status", "recruiter", "recruiter_name", "recruiter_email", "office", "office_name",
    "department", "department_name", "applied_at", "created_at", "hired_at", "updated_at",
)


def job_context(jobs: DataFrame) -> DataFrame:
    """One context row per job id (display fields), ids parsed leniently."""
    ctx = jobs.select(
        safe_long(_first(jobs, "ghjb_job_id", "job_id", "id")).alias("ctx_job_id"),
        _first(jobs, "ghjb_job_name", "job_name", "title").alias("job_title"),
        _first(jobs, "ghjb_recruiter_name", "recruiter_name").alias("ctx_recruiter_name"),
        _first(jobs, "ghjb_recruiter_email", "recruiter_email").alias("recruiter_email"),
        _first(jobs, "ghjb_gh_office_name", "office_name").alias("ctx_office_name"),
        _first(jobs, "ghjb_gh_department_name", "department_name").alias("ctx_department_name"),
    ).filter(F.col("ctx_job_id").isNotNull())
    # one row per job id; a repeated id keeps its largest context (deterministic)
    return latest_per_key(ctx, ["ctx_job_id"], [F.col(c) for c in ctx.columns if c != "ctx_job_id"])


def candidate_context(candidates: DataFrame) -> DataFrame:
    first = _first(candidates, "ghca_first_name", "first_name")
    last = _first(candidates, "ghca_last_name", "last_name")
    parts = F.array_compact(F.array(F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))
    name = F.nullif(F.trim(F.array_join(parts, " ")), F.lit(""))
    ctx = candidates.select(
        safe_long(_first(candidates, "ghca_candidate_id", "candidate_id", "id")).alias("ctx_candidate_id"),
        name.alias("ctx_candidate_name"),
        _first(candidates, "ghca_created_at", "created_at").alias("ctx_created_at"),
    ).filter(F.col("ctx_candidate_id").isNotNull())
    return latest_per_key(ctx, ["ctx_candidate_id"], [F.col("ctx_candidate_name"), F.col("ctx_created_at")])


def seed_applications(raw_applications: DataFrame, raw_jobs: DataFrame, raw_candidates: DataFrame,
                      as_of: str) -> DataFrame:
    """I4: raw applications + job and candidate context → operational applications rows."""
    a = raw_applications
    base = a.select(
        safe_long(_first(a, "ghap_application_id", "application_id", "id")).alias("application_id"),
        safe_long(_first(a, "ghap_job_id", "job_id")).alias("job_id"),
        safe_long(_first(a, "ghap_candidate_id", "candidate_id")).alias("candidate_id"),
        _first(a, "ghap_last_activity_at", "last_activity_at", "updated_at").alias("_updated"),
        _first(a, "ghap_applied_at", "applied_at", "created_at").alias("applied_at"),
        _first(a, "created_at").alias("_created"),
        F.coalesce(F.nullif(_first(a, "ghap_status", "status"), F.lit("")), F.lit("active")).alias("status"),
        _first(a, "ghap_application_current_stage", "current_stage").alias("current_stage"),
    ).filter(F.col("application_id").isNotNull())
    j = job_context(raw_jobs)
    c = candidate_context(raw_candidates)
    joined = base.join(j, base.job_id == j.ctx_job_id, "left").join(c, base.candidate_id == c.ctx_candidate_id, "left")
    return joined.select(
        "application_id", "candidate_id", "job_id",
        F.col("ctx_candidate_name").alias("candidate_full_name"),
        F.col("ctx_candidate_name").alias("candidate_name"),
        "job_title", "current_stage", "status",
        F.col("ctx_recruiter_name").alias("recruiter"),
        F.col("ctx_recruiter_name").alias("recruiter_name"),
        "recruiter_email",
        F.col("ctx_office_name").alias("office"),
        F.col("ctx_office_name").alias("office_name"),
        F.col("ctx_department_name").alias("department"),
        F.col("ctx_department_name").alias("department_name"),
        safe_timestamp(F.col("applied_at")).alias("applied_at"),
        safe_timestamp(F.coalesce(F.col("_created"), F.col("applied_at"), F.col("ctx_created_at"))).alias("created_at"),
        safe_timestamp(F.when(F.col("status") == "hired", F.col("_updated"))).alias("hired_at"),
        safe_timestamp(F.coalesce(F.col("_updated"), F.lit(as_of))).alias("updated_at"),
    )


def seed_stage_events(raw_events: DataFrame, as_of: str) -> DataFrame:
    """Webhook events → operational stage events with a deterministic UUIDv5 id."""
    e = raw_events
    app_id = safe_long(_first(e, "application_id"))
    new_stage = _first(e, "current_stage", "new_stage")
    prev_stage = _first(e, "previous_stage")
    changed_at = F.coalesce(_first(e, "last_activity_at", "changed_at"), F.lit(as_of))
    name = F.concat_ws(
        ":", F.lit(SEED_EVENT_ID_PREFIX), app_id.cast("string"), F.coalesce(prev_stage, F.lit("None")),
        new_stage, changed_at,
    )
    rows = e.select(
        app_id.alias("application_id"), prev_stage.alias("previous_stage"), new_stage.alias("new_stage"),
        changed_at.alias("changed_at_text"), name.alias("_name"),
        F.create_map(
            F.lit("mock_action"), _first(e, "action"),
            F.lit("previous_status"), _first(e, "previous_status"),
            F.lit("current_status"), _first(e, "current_status"),
        ).alias("metadata"),
    ).filter(F.col("application_id").isNotNull() & (F.coalesce(F.col("new_stage"), F.lit("")) != ""))
    return rows.select(
        uuid5(F.col("_name")).alias("event_id"),
        "application_id", "previous_stage", "new_stage",
        F.lit(SEED_SOURCE).alias("changed_by_email"),
        safe_timestamp(F.col("changed_at_text")).alias("changed_at"),
        F.lit(SEED_SOURCE).alias("source"),
        "metadata",
    )


def latest_event_per_application(events: DataFrame, time_col: str = "last_activity_at",
                                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """The latest event of each application (grouped ``max_by``, skew-safe)."""
    order = [F.coalesce(F.col(time_col).cast("string"), F.lit("")), *[F.col(c) for c in tiebreak]]
    return latest_per_key(events, ["application_id"], order)


__all__ = [
    "derive_hired_at", "first_events", "ops_to_applications", "ops_to_events", "seed_applications", "seed_stage_events",
    "latest_event_per_application", "job_context", "candidate_context", "NULL_MARKER",
]
