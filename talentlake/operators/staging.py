"""Staging: typed, renamed projections of the raw tables.

Casts are ``try_cast`` (bad text → NULL, like a safe cast); C1 also removes
duplicate event deliveries, keeping the latest load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.scalar import full_name, safe_double, safe_long, safe_timestamp
from talentlake.functions.windows import latest_per_key

EVENT_DEDUP_KEY = (
    "application_id", "action", "previous_status", "current_status", "previous_stage", "current_stage", "event_at",
)


def _metadata() -> list:
    return [
        F.col("_ingestion_batch_id"),
        safe_timestamp("_ingested_at").alias("ingested_at"),
        F.col("_source_system"),
        F.col("_source_object"),
        F.col("_loaded_by"),
    ]


def stg_events_typed(raw_events: DataFrame) -> DataFrame:
    """C1 without the de-duplication."""
    return raw_events.select(
        F.col("organization_id"),
        F.col("organization_name"),
        F.col("action"),
        safe_long("application_id").alias("application_id"),
        F.col("previous_status"),
        F.col("current_status"),
        F.col("previous_stage"),
        F.col("current_stage"),
        safe_timestamp("last_activity_at").alias("event_at"),
        safe_timestamp("rejected_at").alias("rejected_at"),
        F.col("rejection_reason"),
        F.col("rejection_details"),
        *_metadata(),
    )


def event_load_order() -> list[Column]:
    """Complete order of deliveries of one event: load time, then the remaining columns."""
    return [F.col(c) for c in (
        "ingested_at", "_ingestion_batch_id", "organization_id", "organization_name", "rejected_at", "rejection_reason",
        "rejection_details", "_source_system", "_source_object", "_loaded_by",
    )]


def stg_events(raw_events: DataFrame) -> DataFrame:
    """Typed events, one row per 7-column key, latest load wins.

    Ties on the load time are broken by the remaining columns, so the result
    is deterministic. Implemented as a grouped ``max_by`` (skew-safe: copies
    are merged before the shuffle).
    """
    return latest_per_key(stg_events_typed(raw_events), EVENT_DEDUP_KEY, event_load_order())


def stg_applications(raw: DataFrame) -> DataFrame:
    """C2."""
    return raw.select(
        safe_long("ghap_application_id").alias("application_id"),
        safe_long("ghap_candidate_id").alias("candidate_id"),
        safe_long("ghap_job_id").alias("job_id"),
        safe_timestamp("ghap_applied_at").alias("applied_at"),
        safe_timestamp("ghap_rejected_at").alias("rejected_at"),
        safe_timestamp("ghap_last_activity_at").alias("last_activity_at"),
        safe_timestamp("ghap_hired_at").alias("hired_at"),
        F.col("ghap_source").alias("application_source"),
        F.col("ghap_rejection_reason").alias("rejection_reason"),
        F.col("ghap_status").alias("application_status"),
        F.col("ghap_application_current_stage").alias("current_stage"),
        safe_long("ghap_jobs_count").alias("jobs_count"),
        *_metadata(),
    )


def stg_candidates(raw: DataFrame) -> DataFrame:
    """C3 (full name is SQL concat of coalesced parts: untrimmed)."""
    return raw.select(
        safe_long("ghca_candidate_id").alias("candidate_id"),
        F.col("ghca_first_name").alias("first_name"),
        F.col("ghca_last_name").alias("last_name"),
        full_name("ghca_first_name", "ghca_last_name").alias("candidate_full_name"),
        safe_long("ghca_recruiter_id").alias("recruiter_id"),
        F.col("ghca_recruiter_name").alias("recruiter_name"),
        safe_timestamp("ghca_created_at").alias("created_at"),
        safe_timestamp("ghca_updated_at").alias("updated_at"),
        *_metadata(),
    )


def stg_jobs(raw: DataFrame) -> DataFrame:
    """C4."""
    return raw.select(
        safe_long("ghjb_job_id").alias("job_id"),
        F.col("ghjb_job_name").alias("job_name"),
        safe_long("ghjb_requisition_id").alias("requisition_id"),
        F.col("ghjb_job_status").alias("job_status"),
        safe_timestamp("ghjb_created_at").alias("created_at"),
        safe_timestamp("ghjb_opened_at").alias("opened_at"),
        safe_timestamp("ghjb_closed_at").alias("closed_at"),
        safe_long("ghjb_gh_department_id").alias("department_id"),
        F.col("ghjb_gh_department_name").alias("department_name"),
        safe_long("ghjb_gh_office_id").alias("office_id"),
        F.col("ghjb_gh_office_name").alias("office_name"),
        safe_long("ghjb_hiring_manager_id").alias("hiring_manager_id"),
        F.col("ghjb_hiring_manager_name").alias("hiring_manager_name"),
        safe_long("ghjb_recruiter_id").alias("recruiter_id"),
        F.col("ghjb_recruiter_name").alias("recruiter_name"),
        F.col("ghjb_employment_type").alias("employment_type"),
        F.col("ghjb_budget_owner").alias("budget_owner"),
        F.col("ghjb_executive").alias("executive"),
        safe_double("ghjb_fte").alias("fte"),
        F.col("ghjb_job_type").alias("job_type"),
        *_metadata(),
    )


def stg_offers(raw: DataFrame) -> DataFrame:
    """C5."""
    return raw.select(
        safe_long("ghof_offer_id").alias("offer_id"),
        safe_long("ghof_application_id").alias("application_id"),
        F.col("ghof_status").alias("offer_status"),
        safe_timestamp("ghof_created_at").alias("created_at"),
        safe_timestamp("ghof_updated_at").alias("updated_at"),
        safe_timestamp("ghof_resolved_at").alias("resolved_at"),
        safe_timestamp("ghof_starts_at").alias("starts_at"),
        *_metadata(),
    )


def stg_openings(raw: DataFrame) -> DataFrame:
    """C6 (``opening_id`` is text like ``10000-1`` and therefore NULL once typed)."""
    return raw.select(
        safe_long("ghop_id").alias("opening_row_id"),
        safe_long("ghop_opening_id").alias("opening_id"),
        safe_long("ghop_job_id").alias("job_id"),
        safe_long("ghop_application_id").alias("application_id"),
        F.col("ghop_status").alias("opening_status"),
        F.col("ghop_close_reason_name").alias("close_reason_name"),
        F.col("ghop_priority").alias("priority"),
        F.col("ghop_additional_hire_replacement").alias("additional_hire_replacement"),
        safe_timestamp("ghop_opened_at").alias("opened_at"),
        safe_timestamp("ghop_closed_at").alias("closed_at"),
        *_metadata(),
    )
