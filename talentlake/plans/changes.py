"""Batch change workflows: validate → plan (dry run) → approve → apply.

Transactional row-by-row procedures become set-based plans here: each step
is one plan over whole tables:

* eligibility is a filter; the selection is a top-k (``orderBy().limit(n)``
  with n ≤ 500, planned as TakeOrderedAndProject: each task keeps n rows);
* the focused group is a grouped count and a top-1 (partial aggregation, no
  per-row window over the table);
* a multi-stage apply is a ``posexplode`` of each item's sequence;
* a per-row exception becomes an ``error_message`` column, so one bad item
  never fails the batch;
* request counters come from one grouped aggregate over the items.

Parameter checks that do not depend on data (blank reason, unknown mode …)
raise ``ValueError`` on the driver before any job runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.config import (
    DEFAULT_STAGES,
    HIRE_ELIGIBLE_STAGES,
    HIRE_LIMIT,
    HIRE_MODE_STAGES,
    ITEM_APPLIED,
    ITEM_FAILED,
    ITEM_PENDING,
    ITEM_SKIPPED,
    LATE_STAGE_PRIORITY,
    MODE_FOCUSED,
    MODE_GLOBAL,
    MODE_MANUAL_OUTCOME,
    MODE_MANUAL_STAGE,
    MSG_BACKWARD_STAGE,
    MSG_EMPTY_SEQUENCE,
    MSG_HIRE_INELIGIBLE,
    MSG_INVALID_STAGE,
    MSG_OUTCOME_IN_SEQUENCE,
    MSG_REJECT_INELIGIBLE,
    OPERATIONAL_SOURCE_MARKER,
    OUTCOME_STAGE_LABELS,
    REJECT_ELIGIBLE_STAGES,
    REJECT_LIMIT,
    REJECT_MODE_STAGES,
    REQ_APPLIED,
    REQ_APPROVED,
    REQ_DRY_RUN,
    REQ_FAILED,
    REQ_PARTIAL,
    STAGE_LIMIT,
    STAGE_MANUAL_LIMIT_FLOOR,
    STATUS_ACTIVE,
    STATUS_HIRED,
    STATUS_REJECTED,
    UNKNOWN_DEPARTMENT,
    UNKNOWN_OFFICE,
    UNKNOWN_RECRUITER,
    StageConfig,
)
from talentlake.functions.scalar import clamp, lookup, merge_json, stage_rank
from talentlake.functions.windows import first_rows
from talentlake.session import freeze
from talentlake.sources.buckets import BucketedTable

# Workflow labels written into events and requests.
WORKFLOW_SOURCE = "supabase_admin_workflow"
HIRE_REQUEST_SOURCE = "supabase_hiring_outcome_workflow"
REJECT_REQUEST_SOURCE = "supabase_rejection_outcome_workflow"
MSG_MANUAL_STAGE_INELIGIBLE = "Manual application selection contains ineligible application IDs"
MSG_MANUAL_OUTCOME_INELIGIBLE = "Manual candidate selection contains ineligible application IDs"
NULL_TEXT = "<NULL>"


# -- F1 / F2 ------------------------------------------------------------------------

def stage_rank_column(col: Column | str, stages: StageConfig = DEFAULT_STAGES) -> Column:
    """rank 1..12 of a stage, NULL when unknown."""
    return stage_rank(col, stages.order)


def sequence_error(seq: Column | str, stages: StageConfig = DEFAULT_STAGES) -> Column:
    """first validation error of a stage sequence, NULL when valid.

    Non-empty; no outcome label; every stage known; ranks never decrease
    (equal adjacent stages are allowed).
    """
    s = F.col(seq) if isinstance(seq, str) else seq

    def element_error(x: Column, i: Column) -> Column:
        rank = stage_rank(x, stages.order)
        prev_rank = stage_rank(F.element_at(s, i), stages.order)  # 1-based: element i is the previous one
        return (
            F.when(x.isin(list(OUTCOME_STAGE_LABELS)), F.lit(MSG_OUTCOME_IN_SEQUENCE))
            .when(rank.isNull(), F.concat(F.lit(MSG_INVALID_STAGE), F.coalesce(x, F.lit(NULL_TEXT))))
            .when((i > 0) & (rank < prev_rank), F.concat(F.lit(MSG_BACKWARD_STAGE), x))
        )

    errors = F.filter(F.transform(s, element_error), lambda e: e.isNotNull())
    return F.when(s.isNull() | (F.size(s) <= 0), F.lit(MSG_EMPTY_SEQUENCE)).otherwise(F.try_element_at(errors, F.lit(1)))


def validate_sequence(sequence: Sequence[str | None], stages: StageConfig = DEFAULT_STAGES) -> str | None:
    """F2 for a request parameter (a short list on the driver); same rules as ``sequence_error``."""
    if not sequence:
        return MSG_EMPTY_SEQUENCE
    ranks = stages.rank_of()
    previous = 0
    for stage in sequence:
        if stage in OUTCOME_STAGE_LABELS:
            return MSG_OUTCOME_IN_SEQUENCE
        rank = ranks.get(stage) if stage is not None else None
        if rank is None:
            return MSG_INVALID_STAGE + (stage if stage is not None else NULL_TEXT)
        if rank < previous:
            return MSG_BACKWARD_STAGE + stage
        previous = rank
    return None


# -- F3-F5: eligibility ------------------------------------------------------------------

def _differs(col: str, value: str | None) -> Column:
    """``coalesce(col, '') IS DISTINCT FROM coalesce(value, '')``."""
    return F.coalesce(F.col(col), F.lit("")) != F.lit(value or "")


def eligible_stage_change(apps: DataFrame, final_stage: str) -> DataFrame:
    """active applications not already at the final stage of the sequence."""
    return apps.filter((F.col("status") == STATUS_ACTIVE) & _differs("current_stage", final_stage))


def hire_stages(mode: str) -> tuple[str, ...]:
    if mode == MODE_MANUAL_OUTCOME:
        return HIRE_ELIGIBLE_STAGES
    if mode not in HIRE_MODE_STAGES:
        raise ValueError(f"Invalid hiring outcome selection mode: {mode}")
    return HIRE_MODE_STAGES[mode]


def reject_stages(mode: str) -> tuple[str, ...]:
    if mode == MODE_MANUAL_OUTCOME:
        return REJECT_ELIGIBLE_STAGES
    if mode not in REJECT_MODE_STAGES:
        raise ValueError(f"Invalid rejection outcome selection mode: {mode}")
    return REJECT_MODE_STAGES[mode]


def _outcome_eligible(apps: DataFrame, stages: Iterable[str]) -> DataFrame:
    status = F.col("status")
    return apps.filter(
        (status == STATUS_ACTIVE) & ~status.isin(STATUS_HIRED, STATUS_REJECTED) & F.col("current_stage").isin(list(stages))
    )


def eligible_hire(apps: DataFrame, mode: str) -> DataFrame:
    """active applications in the stages the hiring mode admits."""
    return _outcome_eligible(apps, hire_stages(mode))


def eligible_reject(apps: DataFrame, mode: str) -> DataFrame:
    """active applications in the stages the rejection mode admits."""
    return _outcome_eligible(apps, reject_stages(mode))


def late_stage_priority(col: str = "current_stage") -> Column:
    return lookup(col, LATE_STAGE_PRIORITY, 0)


# -- requests -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    """A dry-run request (one row) and its items."""

    request: DataFrame
    items: DataFrame


ITEM_STAGE_SCHEMA = ("request_id", "application_id", "previous_stage", "planned_stage_sequence",
                     "apply_status", "error_message", "applied_at")
ITEM_OUTCOME_SCHEMA = ("request_id", "application_id", "previous_status", "previous_stage", "planned_outcome",
                       "apply_status", "error_message", "applied_at")


def _ids_frame(spark: SparkSession, application_ids) -> DataFrame:
    """Requested ids as a distinct one-column frame (a list or any frame with ``application_id``)."""
    if isinstance(application_ids, DataFrame):
        return application_ids.select(F.col("application_id").cast("long")).distinct()
    schema = T.StructType([T.StructField("application_id", T.LongType())])
    return spark.createDataFrame([(int(i),) for i in application_ids], schema).distinct()


def _has_ids(application_ids) -> bool:
    if application_ids is None:
        return False
    if isinstance(application_ids, DataFrame):
        return True
    return len(list(application_ids)) > 0


def _request_row(counts: DataFrame, literals: dict[str, object], error: Column | None = None) -> DataFrame:
    """One request row from a one-row counts frame plus literal fields."""
    cols = []
    for k, v in literals.items():
        if isinstance(v, Column):
            cols.append(v.alias(k))
        elif v is None or isinstance(v, str):
            cols.append(F.lit(v).cast("string").alias(k))
        else:
            cols.append(F.lit(v).alias(k))
    err = error if error is not None else F.lit(None).cast("string")
    return counts.select(*cols, "eligible_count", "selected_count", err.alias("error_message"))


def _counts(eligible: DataFrame, items: DataFrame, eligible_count: Column | None = None,
            extra: DataFrame | None = None) -> DataFrame:
    """Eligible and selected counts in one aggregate over a tagged union (no joins)."""
    parts = eligible.select(F.lit("e").alias("_t"), F.col("application_id").cast("long").alias("_id"))
    parts = parts.unionByName(items.select(F.lit("i").alias("_t"), F.col("application_id").cast("long").alias("_id")))
    if extra is not None:
        parts = parts.unionByName(extra.select(F.lit("x").alias("_t"), F.col("application_id").cast("long").alias("_id")))
    return parts.agg(
        (eligible_count if eligible_count is not None else F.count_if(F.col("_t") == "e")).alias("eligible_count"),
        F.count_if(F.col("_t") == "i").alias("selected_count"),
        F.count_if(F.col("_t") == "x").alias("ineligible_count"),
    )


def plan_stage_change(
    apps: DataFrame,
    target_stage: str,
    next_stage: str | None = None,
    requested_limit: int | None = 100,
    selection_mode: str = MODE_FOCUSED,
    reason: str | None = None,
    application_ids=None,
    request_id: str = "request",
    requested_by: str | None = None,
    stages: StageConfig = DEFAULT_STAGES,
    bounds: tuple[int | None, int, int | None] = STAGE_LIMIT,
) -> Plan:
    """dry-run a stage change; modes Manual / Global impact / Focused group.

    ``bounds`` are the default, floor and ceiling of ``requested_limit``; with
    neither a limit nor a default nor a ceiling (None) everything selected is
    planned, without a sort.  The request's ``selected_count`` against its
    ``eligible_count`` shows what a limit left out.
    """
    if not (reason or "").strip():
        raise ValueError("Reason is required")
    if next_stage and next_stage == target_stage:
        raise ValueError("Target stage and next stage must be different.")
    if selection_mode == MODE_MANUAL_STAGE and not _has_ids(application_ids):
        raise ValueError("Manual application selection requires at least one application_id")
    sequence = [target_stage] if not next_stage else [target_stage, next_stage]
    problem = validate_sequence(sequence, stages)
    if problem:
        raise ValueError(problem)
    final_stage = sequence[-1]
    limit = clamp(requested_limit, *bounds)
    eligible = eligible_stage_change(apps, final_stage)
    seq_lit = F.array(*[F.lit(s) for s in sequence])

    ineligible = None
    eligible_count = None
    if selection_mode == MODE_MANUAL_STAGE:
        ids = _ids_frame(apps.sparkSession, application_ids)
        live = ids.join(apps.select("application_id", "status", "current_stage"), "application_id", "left")
        ineligible = live.filter(
            F.col("status").isNull() | (F.col("status") != STATUS_ACTIVE) | ~_differs("current_stage", final_stage)
        )
        manual_limit = clamp(requested_limit, bounds[0], STAGE_MANUAL_LIMIT_FLOOR, bounds[2])
        order = [F.col("updated_at").asc_nulls_last(), F.col("application_id").asc()]
        chosen = first_rows(eligible.join(ids, "application_id", "left_semi"), order, manual_limit)
        eligible_count = F.count_if(F.col("_t") == "e")
        basis = ids
    else:
        if selection_mode == MODE_GLOBAL:
            pool = eligible
        else:
            groups = eligible.groupBy("recruiter", "office", "department").agg(F.count(F.lit(1)).alias("group_count"))
            top = groups.orderBy(
                F.col("group_count").desc_nulls_last(),
                F.col("recruiter").asc_nulls_last(),
                F.col("office").asc_nulls_last(),
                F.col("department").asc_nulls_last(),
            ).limit(1)
            # the selected group is a single row: broadcasting it is bounded
            g = F.broadcast(top.select(*[F.coalesce(F.col(c), F.lit("")).alias(f"_g_{c}")
                                         for c in ("recruiter", "office", "department")]))
            pool = eligible.join(
                g,
                [F.coalesce(F.col(c), F.lit("")) == F.col(f"_g_{c}") for c in ("recruiter", "office", "department")],
                "inner",
            ).drop("_g_recruiter", "_g_office", "_g_department")
        chosen = first_rows(pool, [F.col("updated_at").desc_nulls_first(), F.col("application_id").asc()], limit)
        basis = eligible

    items = chosen.select(
        F.lit(request_id).alias("request_id"),
        "application_id",
        F.col("current_stage").alias("previous_stage"),
        seq_lit.alias("planned_stage_sequence"),
        F.lit(ITEM_PENDING).alias("apply_status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("timestamp").alias("applied_at"),
    )
    counts = _counts(basis, items, eligible_count, ineligible)
    error = (
        F.when(F.col("ineligible_count") > 0, F.lit(MSG_MANUAL_STAGE_INELIGIBLE))
        if selection_mode == MODE_MANUAL_STAGE else None
    )
    request = _request_row(
        counts,
        {
            "request_id": request_id,
            "requested_by": requested_by,
            "target_stage": target_stage,
            "next_stage": next_stage,
            "selection_mode": selection_mode,
            "requested_limit": F.lit(limit).cast("int"),
            "reason": reason,
            "status": REQ_DRY_RUN,
            "source": OPERATIONAL_SOURCE_MARKER,
        },
        error,
    )
    if selection_mode == MODE_MANUAL_STAGE:
        request, items = _all_or_nothing(request, items)
    return Plan(request, items)


def _all_or_nothing(request: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An ineligible id rejects the whole manual request: its one row is decided now, and then no items are planned."""
    selected = F.when(F.col("error_message").isNull(), F.col("selected_count")).otherwise(F.lit(0))
    request = freeze(request.withColumn("selected_count", selected))
    refused = request.select("error_message").first()[0] is not None
    return request, items.where(F.lit(not refused))


def plan_record_form(apps: DataFrame, jobs: DataFrame, sequence: Sequence[str], requested_limit: int,
                     selection_mode: str = MODE_FOCUSED, request_id: str = "request") -> Plan:
    """plan a stage change in record form.

    Candidates are the distinct active applications with a known job that are
    not at the final stage (status and stage compared trimmed, in any case);
    NULL and '' scope parts read "Unknown ...". Focused mode takes the largest
    (recruiter, office, department) scope, ties by name; global mode takes
    every candidate. Items are the first ``requested_limit`` by application id.
    The request row carries ``eligible_count``, the chosen scope and
    ``selected_group_count`` (both NULL in global mode). ``jobs`` has ``job_id``.
    """
    def clean(col: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(col).cast("string"), F.lit(""))))

    def named(col: str, unknown: str) -> Column:
        return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(unknown)).alias(col)

    scope = ("recruiter", "office", "department")
    valid = apps.filter(F.col("application_id").isNotNull() & (clean("status") == STATUS_ACTIVE))
    if sequence:
        valid = valid.filter(clean("current_stage") != sequence[-1].lower())
    rows = valid.join(jobs.select("job_id"), "job_id", "left_semi").select(
        "application_id", "job_id", "status", "current_stage", named("recruiter", UNKNOWN_RECRUITER),
        named("office", UNKNOWN_OFFICE), named("department", UNKNOWN_DEPARTMENT),
    )
    rest = [c for c in rows.columns if c != "application_id"]
    candidates = rows.groupBy("application_id").agg(F.min(F.struct(*rest)).alias("_r")).select("application_id", "_r.*")
    sizes = candidates.groupBy(*scope).agg(F.count(F.lit(1)).alias("group_count"))
    eligible = F.coalesce(F.sum("group_count"), F.lit(0)).alias("eligible_count")
    focused = selection_mode != MODE_GLOBAL
    if focused:
        # the largest group, as one aggregate: the smallest (-count, names)
        top = F.min(F.struct((-F.col("group_count")).alias("n"), *scope)).alias("_g")
        request = sizes.agg(eligible, top).select(
            "eligible_count", *[F.col(f"_g.{c}").alias(c) for c in scope],
            F.coalesce(-F.col("_g.n"), F.lit(0)).alias("selected_group_count"))
        # one row at every size
        pool = candidates.join(F.broadcast(request.select(*scope)), list(scope), "left_semi")
    else:
        nothing = F.lit(None).cast("string")
        request = sizes.agg(eligible).select("eligible_count", *[nothing.alias(c) for c in scope],
                                             F.lit(None).cast("bigint").alias("selected_group_count"))
        pool = candidates
    items = first_rows(pool, [F.col("application_id")], requested_limit).select(
        F.lit(request_id).alias("request_id"), "application_id", "job_id", "current_stage", *scope,
        F.array(*[F.lit(stage) for stage in sequence]).alias("planned_stage_sequence"),
    )
    return Plan(request.select(F.lit(request_id).alias("request_id"), F.lit(selection_mode).alias("selection_mode"), "*"), items)


def _plan_outcome(apps: DataFrame, stages_for_mode: tuple[str, ...], selection_mode: str, reason: str | None,
                  application_ids, manual_requires_eligible: bool):
    """Candidates, their order, the count basis and the manual ineligible rows of an outcome plan."""
    if not (reason or "").strip():
        raise ValueError("Reason is required")
    if selection_mode == MODE_MANUAL_OUTCOME and not _has_ids(application_ids):
        raise ValueError("Manual candidate selection requires at least one application_id")
    eligible = _outcome_eligible(apps, stages_for_mode)
    ineligible = None
    eligible_count = None
    if selection_mode == MODE_MANUAL_OUTCOME:
        ids = _ids_frame(apps.sparkSession, application_ids)
        live = ids.join(apps.select("application_id", "status", "current_stage"), "application_id", "left")
        status = F.col("status")
        bad = (
            status.isNull()
            | (status != STATUS_ACTIVE)
            | status.isin(STATUS_HIRED, STATUS_REJECTED)
            | ~F.col("current_stage").isin(list(stages_for_mode))
        )
        # three-valued: a NULL stage makes the test NULL, which does not count as ineligible
        ineligible = live.filter(F.coalesce(bad, F.lit(False)))
        pool = (eligible if manual_requires_eligible else apps).join(ids, "application_id", "left_semi")
        order = [F.col("application_id").asc()]
        eligible_count = F.count_if(F.col("_t") == "e")
        basis = ids
    else:
        pool = eligible
        order = [late_stage_priority().desc(), F.col("updated_at").asc_nulls_last(), F.col("application_id").asc()]
        basis = eligible
    return pool, order, basis, ineligible, eligible_count


def _finish_outcome(apps, pool, order, basis, ineligible, eligible_count, outcome, selection_mode, limit, reason,
                    request_id, requested_by, source) -> Plan:
    items = first_rows(pool, order, limit).select(
        F.lit(request_id).alias("request_id"),
        "application_id",
        F.col("status").alias("previous_status"),
        F.col("current_stage").alias("previous_stage"),
        F.lit(outcome).alias("planned_outcome"),
        F.lit(ITEM_PENDING).alias("apply_status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("timestamp").alias("applied_at"),
    )
    counts = _counts(basis, items, eligible_count, ineligible)
    error = (
        F.when(F.col("ineligible_count") > 0, F.lit(MSG_MANUAL_OUTCOME_INELIGIBLE))
        if selection_mode == MODE_MANUAL_OUTCOME else None
    )
    request = _request_row(
        counts,
        {
            "request_id": request_id,
            "requested_by": requested_by,
            "outcome": outcome,
            "selection_mode": selection_mode,
            "requested_limit": F.lit(limit).cast("int"),
            "reason": reason,
            "status": REQ_DRY_RUN,
            "source": source,
        },
        error,
    )
    if selection_mode == MODE_MANUAL_OUTCOME:
        request, items = _all_or_nothing(request, items)
    return Plan(request, items)


def plan_hire(apps: DataFrame, selection_mode: str = "Offer only", requested_limit: int | None = 10,
              reason: str | None = None, application_ids=None, request_id: str = "request",
              requested_by: str | None = None,
              bounds: tuple[int | None, int, int | None] = HIRE_LIMIT) -> Plan:
    """F8: dry-run a hiring outcome (Offer only / Late-stage candidates / Manual)."""
    stages_for_mode = hire_stages(selection_mode)
    parts = _plan_outcome(apps, stages_for_mode, selection_mode, reason, application_ids, True)
    return _finish_outcome(apps, *parts, STATUS_HIRED, selection_mode, clamp(requested_limit, *bounds), reason,
                           request_id, requested_by, HIRE_REQUEST_SOURCE)


def plan_reject(apps: DataFrame, selection_mode: str = "Reference Check only", requested_limit: int | None = 1,
                reason: str | None = None, application_ids=None, request_id: str = "request",
                requested_by: str | None = None,
                bounds: tuple[int | None, int, int | None] = REJECT_LIMIT) -> Plan:
    """dry-run a rejection outcome (Early / Reference Check / Late-stage / Manual).

    Manual mode inserts the requested ids that passed the (three-valued)
    check without re-filtering them, so an active application without a
    stage is planned and later rejected.
    """
    stages_for_mode = reject_stages(selection_mode)
    parts = _plan_outcome(apps, stages_for_mode, selection_mode, reason, application_ids, False)
    return _finish_outcome(apps, *parts, STATUS_REJECTED, selection_mode, clamp(requested_limit, *bounds),
                           reason, request_id, requested_by, REJECT_REQUEST_SOURCE)


# -- F10: approve ---------------------------------------------------------------------------------

def approve_requests(requests: DataFrame, request_ids: Iterable[str], approved_by: str | None, as_of: str) -> DataFrame:
    """dry_run → approved for the given ids; other rows unchanged.

    ``approval_error`` is set on the given ids that were not in dry_run.
    """
    ids = list(request_ids)
    chosen = F.col("request_id").isin(ids)
    can = chosen & (F.col("status") == REQ_DRY_RUN)
    others = [c for c in requests.columns if c not in ("status", "approved_by", "approved_at", "approval_error")]
    return requests.select(
        *others,
        F.when(can, F.lit(REQ_APPROVED)).otherwise(F.col("status")).alias("status"),
        F.when(can, F.lit(approved_by).cast("string")).alias("approved_by"),
        F.when(can, F.lit(as_of).cast("timestamp")).alias("approved_at"),
        F.when(chosen & ~can, F.lit("Request must exist and be in dry_run status")).alias("approval_error"),
    )


def request_status(applied: Column, skipped: Column, failed: Column, outcome: bool) -> Column:
    """applied / partially_applied / failed (an empty request ends as applied)."""
    clean = (failed == 0) & (skipped == 0) if outcome else (failed == 0)
    return F.when(clean, F.lit(REQ_APPLIED)).when(applied > 0, F.lit(REQ_PARTIAL)).otherwise(F.lit(REQ_FAILED))


@dataclass(frozen=True)
class Applied:
    """Outputs of an apply: new events, the changed applications, items and the request."""

    stage_events: DataFrame
    status_events: DataFrame | None
    applications: DataFrame
    items: DataFrame
    request: DataFrame
    changed: DataFrame  # the changed applications only: their id and new values


def merge_applied(table: BucketedTable, applied: Applied, commit: str) -> list[int]:
    """The changes of an apply merged into a bucketed applications table: it rewrites the buckets that hold
    changed applications, and nothing if the commit has been done before."""
    columns = [c for c in applied.changed.columns if c != "application_id"]
    return table.merge(applied.changed, commit, ["application_id"], columns)


def _item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("request_id").agg(
        F.count_if(F.col("apply_status") == ITEM_APPLIED).alias("applied_count"),
        F.count_if(F.col("apply_status") == ITEM_SKIPPED).alias("skipped_count"),
        F.count_if(F.col("apply_status") == ITEM_FAILED).alias("failed_count"),
    )


def _close_request(request: DataFrame, items: DataFrame, as_of: str, outcome: bool) -> DataFrame:
    counts = _item_counts(items)
    r = request.drop("applied_count", "skipped_count", "failed_count", "applied_at").join(counts, "request_id", "left").na.fill(0, ["applied_count", "skipped_count", "failed_count"])
    return r.withColumn(
        "status",
        request_status(F.col("applied_count"), F.col("skipped_count"), F.col("failed_count"), outcome),
    ).withColumn("applied_at", F.lit(as_of).cast("timestamp"))


REQUEST_COUNTS = ("applied_count", "skipped_count", "failed_count")


def request_metadata(requests: DataFrame, counts: Sequence[str] = REQUEST_COUNTS) -> DataFrame:
    """``metadata`` (JSON text) of applied requests with their item counts merged in."""
    before = F.col("metadata") if "metadata" in requests.columns else F.lit(None).cast("string")
    return requests.withColumn("metadata", merge_json(before, F.to_json(F.struct(*counts))))


def _update_applications(apps: DataFrame, changes: DataFrame, set_cols: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Apply per-application changes (one row per application) to the applications table; and the changes alone."""
    alone = changes.join(apps.select("application_id"), "application_id", "left_semi").select(
        "application_id", *[expr.cast(apps.schema[c].dataType).alias(c) for c, expr in set_cols.items() if c in apps.columns])
    renamed = changes.select("application_id", *[expr.alias(f"_new_{c}") for c, expr in set_cols.items()])
    marked = renamed.withColumn("_changed", F.lit(True))
    joined = apps.join(marked, "application_id", "left")
    cols = []
    for c in apps.columns:
        if c in set_cols:
            cols.append(F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols), alone


def _request_order(*first: Column):
    """An application's items in the order in which their requests are applied."""
    return Window.partitionBy("application_id").orderBy(*first, F.col("_approved_at").asc_nulls_last(), F.col("request_id"))


def apply_stage_change(request: DataFrame, items: DataFrame, apps: DataFrame, as_of: str,
                       changed_by: str | None = None, stages: StageConfig = DEFAULT_STAGES) -> Applied:
    """one event per item and stage; the application ends at the last stage
    of its last approved request (by approval time, then request id).

    Only an approved request is applied; pending and failed items are
    (re)tried. Status and stage are not re-checked (items were checked at
    planning time). A sequence error fails just that item.
    """
    now = F.lit(as_of).cast("timestamp")
    approved = request.filter(F.col("status") == REQ_APPROVED).select("request_id", F.col("approved_at").alias("_approved_at"))
    todo = items.filter(F.col("apply_status").isin(ITEM_PENDING, ITEM_FAILED)).join(
        approved, "request_id"
    )
    todo = todo.withColumn("_error", sequence_error("planned_stage_sequence", stages))
    ok = todo.filter(F.col("_error").isNull())
    events = ok.select(
        "request_id", "application_id", "previous_stage", "planned_stage_sequence",
        F.posexplode("planned_stage_sequence").alias("pos", "new_stage"),
    ).select(
        "application_id",
        F.when(F.col("pos") == 0, F.col("previous_stage"))
        .otherwise(F.element_at(F.col("planned_stage_sequence"), F.col("pos")))
        .alias("previous_stage"),
        "new_stage",
        F.lit(changed_by).alias("changed_by_email"),
        now.alias("changed_at"),
        F.lit(WORKFLOW_SOURCE).alias("source"),
        "request_id",
        F.create_map(
            F.lit("idempotency_key"),
            F.concat_ws(":", F.col("request_id"), F.col("application_id").cast("string"), F.col("new_stage")),
        ).alias("metadata"),
        F.col("pos").alias("sequence_position"),
    )
    later = F.lead("request_id").over(_request_order())
    final = ok.withColumn("_later", later).filter(F.col("_later").isNull()).select(
        "application_id", F.element_at("planned_stage_sequence", -1).alias("current_stage"), now.alias("updated_at")
    )
    new_apps, changed = _update_applications(apps, final, {"current_stage": F.col("current_stage"), "updated_at": now})
    done = todo.select(
        "request_id", "application_id", "previous_stage", "planned_stage_sequence",
        F.when(F.col("_error").isNull(), F.lit(ITEM_APPLIED)).otherwise(F.lit(ITEM_FAILED)).alias("apply_status"),
        F.col("_error").alias("error_message"),
        F.when(F.col("_error").isNull(), now).alias("applied_at"),
    )
    untouched = items.join(done.select("request_id", "application_id"), ["request_id", "application_id"], "left_anti")
    new_items = untouched.select(*ITEM_STAGE_SCHEMA).unionByName(done.select(*ITEM_STAGE_SCHEMA))
    new_request = _close_request(request.join(approved, "request_id", "left_semi"), done, as_of, False)
    return Applied(events, None, new_apps, new_items, new_request, changed)


STAGE_EVENT_SCHEMA = (
    "application_id long, previous_stage string, new_stage string, changed_by_email string, changed_at timestamp, "
    "source string, request_id string, metadata map<string,string>"
)


def _apply_outcome(request: DataFrame, items: DataFrame, apps: DataFrame, as_of: str, outcome: str,
                   changed_by: str | None) -> Applied:
    now = F.lit(as_of).cast("timestamp")
    approved = request.filter((F.col("status") == REQ_APPROVED) & (F.col("outcome") == outcome)).select(
        "request_id", F.col("reason").alias("_reason"), F.col("selection_mode").alias("_mode"),
        F.col("approved_at").alias("_approved_at"),
    )
    todo = items.filter(F.col("apply_status").isin(ITEM_PENDING, ITEM_FAILED)).join(
        approved, "request_id", "inner"
    )
    live = apps.select("application_id", F.col("status").alias("_live_status"), F.col("current_stage").alias("_live_stage"))
    todo = todo.join(live, "application_id", "left")
    status, stage = F.col("_live_status"), F.col("_live_stage")
    not_active = F.coalesce(status, F.lit("")) != STATUS_ACTIVE  # IS DISTINCT FROM 'active'
    if outcome == STATUS_HIRED:
        skip_first = not_active | ~stage.isin(list(HIRE_ELIGIBLE_STAGES))
        updatable = (status == STATUS_ACTIVE) & stage.isin(list(HIRE_ELIGIBLE_STAGES))
        message = MSG_HIRE_INELIGIBLE
    else:
        skip_first = not_active | ~stage.isin(list(REJECT_ELIGIBLE_STAGES))
        updatable = status == STATUS_ACTIVE
        message = MSG_REJECT_INELIGIBLE
    applies = ~F.coalesce(skip_first, F.lit(False)) & F.coalesce(updatable, F.lit(False))
    # The first approved request that can changes the application; for later ones it is no longer active.
    todo = todo.withColumn("_can", applies)
    first = F.row_number().over(_request_order(F.col("_can").desc())) == 1
    todo = todo.withColumn("_applies", F.col("_can") & first)
    done_rows = todo.select(
        "request_id", "application_id", "previous_status", "previous_stage", "planned_outcome",
        F.when(F.col("_applies"), F.lit(ITEM_APPLIED)).otherwise(F.lit(ITEM_SKIPPED)).alias("apply_status"),
        F.when(F.col("_applies"), F.lit(None).cast("string")).otherwise(F.lit(message)).alias("error_message"),
        now.alias("applied_at"),
    )
    applied = todo.filter(F.col("_applies"))
    if outcome == STATUS_HIRED:
        meta = F.create_map(F.lit("previous_stage"), F.col("previous_stage"), F.lit("new_stage"), F.lit("Offer"),
                            F.lit("workflow"), F.lit("hiring_outcome"))
        changes = applied.select("application_id")
        new_apps, changed = _update_applications(apps, changes, {"status": F.lit(STATUS_HIRED), "current_stage": F.lit("Offer"),
                                                                 "hired_at": now, "updated_at": now})
        stage_events = applied.select(
            "application_id", "previous_stage", F.lit("Offer").alias("new_stage"),
            F.lit(changed_by).alias("changed_by_email"), now.alias("changed_at"), F.lit(WORKFLOW_SOURCE).alias("source"),
            "request_id", F.create_map(F.lit("workflow"), F.lit("hiring_outcome")).alias("metadata"),
        )
    else:
        meta = F.create_map(F.lit("previous_stage"), F.col("previous_stage"), F.lit("workflow"), F.lit("rejection_outcome"),
                            F.lit("rejection_reason"), F.col("_reason"), F.lit("selection_mode"), F.col("_mode"))
        changes = applied.select("application_id")
        new_apps, changed = _update_applications(apps, changes, {"status": F.lit(STATUS_REJECTED), "updated_at": now})
        stage_events = apps.sparkSession.createDataFrame([], STAGE_EVENT_SCHEMA)  # a rejection moves no stage
    status_events = applied.select(
        "application_id", "previous_status", F.lit(outcome).alias("new_status"),
        F.lit(changed_by).alias("changed_by_email"), now.alias("changed_at"), F.lit(WORKFLOW_SOURCE).alias("source"),
        "request_id", meta.alias("metadata"),
    )
    keys = ["request_id", "application_id"]
    untouched = items.join(done_rows.select(*keys), keys, "left_anti")
    new_items = untouched.select(*ITEM_OUTCOME_SCHEMA).unionByName(done_rows.select(*ITEM_OUTCOME_SCHEMA))
    new_request = _close_request(request.join(approved.select("request_id"), "request_id", "left_semi"),
                                 done_rows, as_of, True)
    return Applied(stage_events, status_events, new_apps, new_items, new_request, changed)


def apply_hire(request: DataFrame, items: DataFrame, apps: DataFrame, as_of: str,
               changed_by: str | None = None) -> Applied:
    """re-check each item, hire (stage → Offer, hired_at) or skip; status and stage events."""
    return _apply_outcome(request, items, apps, as_of, STATUS_HIRED, changed_by)


def apply_reject(request: DataFrame, items: DataFrame, apps: DataFrame, as_of: str,
                 changed_by: str | None = None) -> Applied:
    """re-check each item, reject (stage unchanged) or skip; status event only."""
    return _apply_outcome(request, items, apps, as_of, STATUS_REJECTED, changed_by)


# -- F15 / F16 ------------------------------------------------------------------------------

def audit_rows(request: DataFrame, action: str, object_type: str, actor: str | None, as_of: str,
               payload_cols: Sequence[str] = ()) -> DataFrame:
    """one audit row per request."""
    payload = F.create_map(*[x for c in payload_cols for x in (F.lit(c), F.col(c).cast("string"))]) if payload_cols \
        else F.create_map().cast("map<string,string>")
    return request.select(
        F.lit(actor).alias("email"), F.lit(action).alias("action"), F.lit(object_type).alias("object_type"),
        F.col("request_id").alias("object_id"), payload.alias("payload"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def record_apply_status(results: DataFrame, key: str = "request_id") -> DataFrame:
    """F16: per request, applied / partially_applied / failed from attempted item results."""
    counts = results.groupBy(key).agg(
        F.count_if(F.col("apply_status") == ITEM_APPLIED).alias("applied_count"),
        F.count_if(F.col("apply_status") == ITEM_FAILED).alias("failed_count"),
        F.count_if(F.col("apply_status") == ITEM_SKIPPED).alias("skipped_count"),
    )
    return counts.withColumn(
        "status",
        F.when(F.col("failed_count") == 0, F.lit(REQ_APPLIED))
        .when(F.col("applied_count") > 0, F.lit(REQ_PARTIAL))
        .otherwise(F.lit(REQ_FAILED)),
    )


# -- F17 ----------------------------------------------------------------------------------------

COMMAND_STAGE = "stage_change"
COMMAND_REJECT = "reject"
COMMAND_HIRE = "hire"
COMMAND_ACTION = {
    COMMAND_STAGE: "candidate_stage_change",
    COMMAND_REJECT: "reject_candidate",
    COMMAND_HIRE: "hire_candidate",
}


MSG_UNKNOWN_APPLICATION = "Application not found"
MSG_NO_TARGET_STAGE = "Stage change requires new_stage or current_stage."
# Equal event times: the event that was loaded last counts as the latest.
EVENT_ARRIVAL = ("_ingested_at", "_ingestion_batch_id", "current_stage", "current_status")


def events_from_commands(commands: DataFrame, events: DataFrame, applications: DataFrame, organization_id: int,
                         arrival: Sequence[str] = EVENT_ARRIVAL) -> DataFrame:
    """commands (stage change / reject / hire) → new webhook events.

    ``commands``: application_id, command, new_stage, current_status, reason,
    issued_at. Each command starts from the application's latest event (else
    the application row; equal times by ``arrival``); commands on one
    application chain in issue order (equal times: by command, then stage).
    A command on an unknown application, or a stage change without a target,
    gives a row with ``error_message`` and no event; later commands ignore it.
    """
    from talentlake.plans.ingest import latest_event_per_application

    ids = commands.select("application_id").distinct()
    typed_events = events.withColumn("application_id", F.col("application_id").try_cast("long"))
    latest = latest_event_per_application(typed_events.join(ids, "application_id", "left_semi"), tiebreak=arrival).select(
        "application_id", F.struct("current_stage", "current_status").alias("_event"))
    app_state = applications.select(
        F.col("ghap_application_id").try_cast("long").alias("application_id"),
        F.struct(F.col("ghap_application_current_stage").alias("current_stage"),
                 F.col("ghap_status").alias("current_status")).alias("_app"),
    ).join(ids, "application_id", "left_semi")
    base = latest.join(app_state, "application_id", "full_outer").select(
        "application_id", F.coalesce("_event", "_app").alias("_start"))
    cmd = commands.join(base, "application_id", "left")
    is_stage = F.col("command") == COMMAND_STAGE
    error = F.when(F.col("_start").isNull(), F.lit(MSG_UNKNOWN_APPLICATION)).when(
        is_stage & (F.coalesce(F.col("new_stage"), F.lit("")) == ""), F.lit(MSG_NO_TARGET_STAGE))
    result_status = (
        F.when(is_stage, F.col("current_status"))
        .when(F.col("command") == COMMAND_REJECT, F.lit(STATUS_REJECTED))
        .otherwise(F.lit(STATUS_HIRED))
    )
    cmd = cmd.withColumn("error_message", error)
    ok = F.col("error_message").isNull()
    # commands per application within one batch are few; the window is per application
    w = Window.partitionBy("application_id").orderBy("issued_at", "command", "new_stage")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    moved = F.last(F.when(ok & is_stage, F.col("new_stage")), ignorenulls=True).over(earlier)
    decided = F.last(F.when(ok, F.struct(result_status.alias("status"))), ignorenulls=True).over(earlier)
    cmd = cmd.select(
        "*", result_status.alias("_result_status"),
        F.coalesce(moved, F.col("_start.current_stage")).alias("_stage_before"),
        F.when(decided.isNotNull(), decided["status"]).otherwise(F.col("_start.current_status")).alias("_status_before"),
    )
    is_reject = F.col("command") == COMMAND_REJECT
    return cmd.select(
        F.lit(organization_id).cast("long").alias("organization_id"),
        F.col("command").alias("command"),
        F.when(ok, lookup("command", COMMAND_ACTION)).alias("action"),
        "application_id",
        F.when(ok, F.col("_status_before")).alias("previous_status"),
        F.when(ok, F.col("_result_status")).alias("current_status"),
        F.col("issued_at").alias("last_activity_at"),
        F.when(ok & is_reject, F.col("issued_at")).alias("rejected_at"),
        F.when(ok & is_reject, F.col("reason")).alias("rejection_reason"),
        F.lit(None).cast("string").alias("rejection_details"),
        F.when(ok, F.col("_stage_before")).alias("previous_stage"),
        F.when(ok & is_stage, F.col("new_stage")).when(ok, F.col("_stage_before")).alias("current_stage"),
        "error_message",
    )


# -- frozen plans and durable apply outputs -------------------------------------------------------

def freeze_plan(plan: Plan) -> Plan:
    """Checkpoint a dry run (request and items) into the shared checkpoint folder.

    A plan is a top-k over live applications; re-evaluating it after the
    applications table changes could select other rows. Freezing it first
    makes approve / apply / every output derive from the same selection, and
    a lost executor re-reads the checkpoint instead of re-planning.
    """
    return Plan(freeze(plan.request), freeze(plan.items))


def write_applied(result: Applied, root: str, version: str) -> dict[str, str]:
    """Write the outputs of one apply under ``root/<output>/version=<version>``.

    Events and audit-style outputs are appended per version; the new
    applications table is a new version (never an in-place overwrite of the
    table the apply read).
    """
    outputs = {
        "stage_events": result.stage_events,
        "status_events": result.status_events,
        "applications": result.applications,
        "items": result.items,
        "requests": result.request,
    }
    paths = {}
    for name, df in outputs.items():
        if df is None:
            continue
        path = f"{root.rstrip('/')}/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths
