"""Marts (K1-K9).

Plans are written aggregate-first: facts are reduced to the grain of the
mart before any dimension join, so the joins see a handful of rows per group
instead of one per event. Distinct counts that Catalyst would expand several
times over (``count(distinct case when … then id end)``) are computed as a
de-duplication on (group, id) followed by a plain count, which shuffles each
input row once and spreads a hot group over its ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.config import (
    DEFAULT_STAGES,
    OPERATIONAL_SOURCE_MARKER,
    UNKNOWN_DEPARTMENT,
    UNKNOWN_OFFICE,
    UNKNOWN_RECRUITER,
    StageConfig,
)
from talentlake.functions.scalar import safe_divide, stage_rank


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def _mean(total: Column, count: Column, scale: float = 1.0) -> Column:
    """sum / count / scale as a double, NULL when nothing was counted."""
    mean = F.try_divide(total.cast("double"), count.cast("double"))
    return mean / F.lit(scale) if scale != 1.0 else mean


def _count_when(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


# -- K1 ---------------------------------------------------------------------------

def mart_status_by_scope(fact_app: DataFrame, dim_job_df: DataFrame) -> DataFrame:
    """K1: distinct applications per status within (office, department) and their share.

    Names come from the job (defaulted); the grouping uses the defaulted names.
    """
    a = fact_app.select("application_id", "job_id", "office_id", "department_id", "application_status").alias("a")
    j = dim_job_df.select("job_id", "office_name", "department_name").alias("j")
    counts = (
        a.join(j, F.col("a.job_id") == F.col("j.job_id"), "left")
        .select(
            F.col("a.office_id").alias("office_id"),
            F.coalesce(F.col("j.office_name"), F.lit(UNKNOWN_OFFICE)).alias("office_name"),
            F.col("a.department_id").alias("department_id"),
            F.coalesce(F.col("j.department_name"), F.lit(UNKNOWN_DEPARTMENT)).alias("department_name"),
            F.col("a.application_status").alias("application_status"),
            F.col("a.application_id").alias("application_id"),
        )
        .groupBy("office_id", "office_name", "department_id", "department_name", "application_status")
        .agg(F.count_distinct("application_id").alias("applications_count"))
    )
    scope = Window.partitionBy("office_id", "department_id")
    return counts.select(
        "*", safe_divide(F.col("applications_count"), F.sum("applications_count").over(scope)).alias("status_share")
    )


# -- K2 / K3 -------------------------------------------------------------------------

def _overview_inputs(fact_app: DataFrame, dim_job_df: DataFrame, fact_offer_df: DataFrame,
                     fact_transitions: DataFrame, scope_cols: list[str]) -> DataFrame:
    """Jobs, applications, offers and transitions as one tagged row set (one aggregate pass)."""
    empty_b = F.lit(None).cast("boolean")
    empty_l = F.lit(None).cast("bigint")
    empty_s = F.lit(None).cast("string")

    def rows(df: DataFrame, src: str, job_status=empty_s, hired=empty_b, active=empty_b, rejected=empty_b,
             tth=empty_l, source=empty_s, accepted=empty_b, owned=empty_b, met=empty_b) -> DataFrame:
        return df.select(
            *scope_cols,
            F.lit(src).alias("src"),
            job_status.alias("job_status"),
            active.alias("is_active"),
            rejected.alias("is_rejected"),
            hired.alias("is_hired"),
            tth.alias("time_to_hire_days"),
            source.alias("application_source"),
            accepted.alias("is_accepted"),
            owned.alias("is_owned"),
            met.alias("sla_met"),
        )

    return (
        rows(dim_job_df, "job", job_status=F.col("job_status"))
        .unionByName(rows(fact_app, "app", hired=F.col("is_hired"), active=F.col("is_active"),
                          rejected=F.col("is_rejected"), tth=F.col("time_to_hire_days"),
                          source=F.col("application_source")))
        .unionByName(rows(fact_offer_df, "offer", accepted=F.col("is_accepted")))
        .unionByName(rows(fact_transitions, "stage", owned=F.col("is_recruiter_owned_stage"),
                          met=F.col("sla_met")))
    )


def _overview_measures() -> list[Column]:
    src = F.col("src")
    job, app, offer, stage = (src == "job"), (src == "app"), (src == "offer"), (src == "stage")
    hired = app & F.col("is_hired")
    valid = hired & F.col("time_to_hire_days").isNotNull()
    is_marker = F.col("application_source") == F.lit(OPERATIONAL_SOURCE_MARKER)
    not_marker = F.coalesce(F.col("application_source"), F.lit("")) != F.lit(OPERATIONAL_SOURCE_MARKER)
    owned = stage & F.col("is_owned")
    tth_hired = F.when(hired, F.col("time_to_hire_days"))
    return [
        _count_when(job).alias("total_jobs"),
        _count_when(job & (F.col("job_status") == "open")).alias("open_jobs"),
        _count_when(job & (F.col("job_status") == "closed")).alias("closed_jobs"),
        _count_when(app).alias("total_applications"),
        _count_when(app & F.col("is_active")).alias("active_applications"),
        _count_when(app & F.col("is_rejected")).alias("rejected_applications"),
        _count_when(hired).alias("hired_applications"),
        _count_when(valid).alias("hired_applications_with_valid_time_to_hire"),
        _count_when(valid & not_marker).alias("historical_hired_applications_with_valid_time_to_hire"),
        _count_when(valid & is_marker).alias("supabase_outcome_hired_applications_with_valid_time_to_hire"),
        _mean(F.sum(tth_hired), F.count(tth_hired)).alias("avg_time_to_hire_days"),
        _count_when(offer).alias("total_offers"),
        _count_when(offer & F.col("is_accepted")).alias("accepted_offers"),
        _count_when(owned).alias("recruiter_owned_stage_cases"),
        _count_when(owned & F.col("sla_met")).alias("recruiter_sla_met_cases"),
        _count_when(owned & ~F.col("sla_met")).alias("recruiter_sla_breached_cases"),
    ]


OVERVIEW_COLUMNS = (
    "total_jobs", "open_jobs", "closed_jobs", "total_applications", "active_applications",
    "rejected_applications", "hired_applications", "hired_applications_with_valid_time_to_hire",
    "historical_hired_applications_with_valid_time_to_hire",
    "supabase_outcome_hired_applications_with_valid_time_to_hire", "avg_time_to_hire_days",
    "total_offers", "accepted_offers", "recruiter_owned_stage_cases", "recruiter_sla_met_cases",
    "recruiter_sla_breached_cases", "recruiter_sla_compliance_rate",
)


def mart_exec_overview(fact_app: DataFrame, dim_job_df: DataFrame, fact_offer_df: DataFrame,
                       fact_transitions: DataFrame, as_of=None) -> DataFrame:
    """K2: one row of KPIs. Compliance = met / owned, NULL when nothing is owned."""
    return _overview_row(_overview_inputs(fact_app, dim_job_df, fact_offer_df, fact_transitions, []).agg(*_overview_measures()), as_of)


def _overview_row(agg: DataFrame, as_of) -> DataFrame:
    return agg.select(
        _as_of(as_of).alias("generated_at"),
        *[c for c in OVERVIEW_COLUMNS if c != "recruiter_sla_compliance_rate"],
        safe_divide(F.col("recruiter_sla_met_cases"), F.col("recruiter_owned_stage_cases"))
        .alias("recruiter_sla_compliance_rate"),
    )


def mart_exec_overview_by_scope(fact_app: DataFrame, dim_job_df: DataFrame, fact_offer_df: DataFrame,
                                fact_transitions: DataFrame, as_of=None) -> DataFrame:
    """K3: K2 per (office, department) pair that exists on a job with both ids.

    Applications, offers and transitions outside those pairs are not shown
    (totals need not reconcile with K2). Counts default to 0; the average
    and the rate stay NULL when there is nothing to average.
    """
    keys = ["office_id", "department_id"]
    agg = (
        _overview_inputs(fact_app, dim_job_df, fact_offer_df, fact_transitions, keys)
        .filter(F.col("office_id").isNotNull() & F.col("department_id").isNotNull())
        .groupBy(*keys)
        .agg(*_overview_measures())
    )
    return _overview_scopes(agg, dim_job_df, as_of)


def _overview_scopes(agg: DataFrame, dim_job_df: DataFrame, as_of) -> DataFrame:
    keys = ["office_id", "department_id"]
    scope = (
        dim_job_df.filter(F.col("office_id").isNotNull() & F.col("department_id").isNotNull())
        .select("office_id", "office_name", "department_id", "department_name")
        .distinct()
    )
    joined = scope.join(agg, on=keys, how="left")
    measures = []
    for c in OVERVIEW_COLUMNS:
        if c == "avg_time_to_hire_days":
            measures.append(F.col(c))
        elif c == "recruiter_sla_compliance_rate":
            measures.append(safe_divide(F.col("recruiter_sla_met_cases"), F.col("recruiter_owned_stage_cases")).alias(c))
        else:
            measures.append(F.coalesce(F.col(c), F.lit(0)).alias(c))
    return joined.select(
        _as_of(as_of).alias("generated_at"),
        "office_id",
        F.coalesce(F.col("office_name"), F.lit(UNKNOWN_OFFICE)).alias("office_name"),
        "department_id",
        F.coalesce(F.col("department_name"), F.lit(UNKNOWN_DEPARTMENT)).alias("department_name"),
        *measures,
    )


# -- K4 ----------------------------------------------------------------------------------

def mart_recruiter_performance(fact_transitions: DataFrame, dim_recruiter_df: DataFrame,
                               dim_job_df: DataFrame) -> DataFrame:
    """K4: per recruiter × department × office × owned stage.

    Rate = met / all cases. Names come from the recruiter and job dimensions
    (NULL stays NULL). Transitions are first reduced to (recruiter, job,
    stage) before the dimension joins; the dimensions may fan out (one id,
    several names), which multiplies the partial sums exactly as it would
    multiply the rows.
    """
    partial = (
        fact_transitions.filter(F.col("is_recruiter_owned_stage"))
        .groupBy("recruiter_id", "department_id", "office_id", "stage_name", "sla_target_days", "job_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("duration_hours").alias("hours_sum"),
            F.count("duration_hours").alias("hours_n"),
            F.count_if(F.col("sla_met")).alias("met"),
            F.count_if(~F.col("sla_met")).alias("breached"),
        )
        .alias("t")
    )
    r = dim_recruiter_df.alias("r")
    j = dim_job_df.select("job_id", "department_name", "office_name").alias("j")
    joined = partial.join(r, F.col("t.recruiter_id") == F.col("r.recruiter_id"), "left").join(
        j, F.col("t.job_id") == F.col("j.job_id"), "left"
    )
    grouped = joined.groupBy(
        F.col("t.recruiter_id").alias("recruiter_id"),
        F.col("r.recruiter_name").alias("recruiter_name"),
        F.col("t.department_id").alias("department_id"),
        F.col("j.department_name").alias("department_name"),
        F.col("t.office_id").alias("office_id"),
        F.col("j.office_name").alias("office_name"),
        F.col("t.stage_name").alias("stage_name"),
        F.col("t.sla_target_days").alias("sla_target_days"),
    ).agg(
        F.sum("n").alias("total_cases"),
        _mean(F.sum("hours_sum"), F.sum("hours_n"), 24.0).alias("avg_duration_days"),
        F.sum("met").alias("sla_met_cases"),
        F.sum("breached").alias("sla_breached_cases"),
    )
    return grouped.withColumn("sla_compliance_rate", safe_divide(F.col("sla_met_cases"), F.col("total_cases")))


# -- K5 -----------------------------------------------------------------------------------

def mart_recruiter_workload(fact_app: DataFrame, fact_transitions: DataFrame, fact_offer_df: DataFrame,
                            dim_recruiter_df: DataFrame, dim_office_df: DataFrame,
                            dim_department_df: DataFrame) -> DataFrame:
    """K5: per recruiter × office × department (spine = application groups).

    Stage and offer metrics join on all three ids with plain equality, so a
    group with a NULL id gets 0 / NULL for them. Names default to "Unknown …".
    """
    keys = ["recruiter_id", "office_id", "department_id"]
    per_app = fact_app.groupBy(*keys, "application_id").agg(
        F.max("is_active").alias("a"), F.max("is_rejected").alias("r"), F.max("is_hired").alias("h")
    )
    app_metrics = per_app.groupBy(*keys).agg(
        F.count("application_id").alias("total_applications"),
        F.count_if(F.col("a")).alias("active_applications"),
        F.count_if(F.col("r")).alias("rejected_applications"),
        F.count_if(F.col("h")).alias("hired_applications"),
    )
    jobs_touched = (
        fact_app.filter(F.col("job_id").isNotNull())
        .select(*keys, "job_id").distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("jobs_touched"))
    )
    stage_metrics = (
        fact_transitions.filter(F.col("is_recruiter_owned_stage"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("recruiter_owned_stage_cases"),
            F.count_if(F.col("sla_met")).alias("sla_met_cases"),
            F.count_if(~F.col("sla_met")).alias("sla_breached_cases"),
            _mean(F.sum("duration_hours"), F.count("duration_hours"), 24.0).alias("avg_recruiter_stage_duration_days"),
        )
        .withColumn("sla_compliance_rate", safe_divide(F.col("sla_met_cases"), F.col("recruiter_owned_stage_cases")))
    )
    per_offer = fact_offer_df.groupBy(*keys, "offer_id").agg(F.max("is_accepted").alias("acc"))
    offer_metrics = per_offer.groupBy(*keys).agg(
        F.count("offer_id").alias("total_offers"), F.count_if(F.col("acc")).alias("accepted_offers")
    )

    def eq_join(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        r = right.alias(name)
        cond = [F.col(f"base.{k}") == F.col(f"{name}.{k}") for k in keys]
        return left.join(r, cond, "left")

    base = app_metrics.alias("base")
    # jobs_touched is keyed exactly like app_metrics (same source rows), NULL keys included
    base = base.join(jobs_touched.alias("jt"), [F.col(f"base.{k}").eqNullSafe(F.col(f"jt.{k}")) for k in keys], "left")
    base = eq_join(base, stage_metrics, "sm")
    base = eq_join(base, offer_metrics, "om")
    base = base.join(dim_recruiter_df.alias("rec"), F.col("base.recruiter_id") == F.col("rec.recruiter_id"), "left")
    base = base.join(dim_office_df.alias("off"), F.col("base.office_id") == F.col("off.office_id"), "left")
    base = base.join(dim_department_df.alias("dep"), F.col("base.department_id") == F.col("dep.department_id"), "left")
    return base.select(
        F.col("base.recruiter_id").alias("recruiter_id"),
        F.coalesce(F.col("rec.recruiter_name"), F.lit(UNKNOWN_RECRUITER)).alias("recruiter_name"),
        F.col("base.office_id").alias("office_id"),
        F.coalesce(F.col("off.office_name"), F.lit(UNKNOWN_OFFICE)).alias("office_name"),
        F.col("base.department_id").alias("department_id"),
        F.coalesce(F.col("dep.department_name"), F.lit(UNKNOWN_DEPARTMENT)).alias("department_name"),
        F.col("base.total_applications").alias("total_applications"),
        F.col("base.active_applications").alias("active_applications"),
        F.col("base.rejected_applications").alias("rejected_applications"),
        F.col("base.hired_applications").alias("hired_applications"),
        F.coalesce(F.col("jt.jobs_touched"), F.lit(0)).cast("bigint").alias("jobs_touched"),
        F.coalesce(F.col("sm.recruiter_owned_stage_cases"), F.lit(0)).alias("recruiter_owned_stage_cases"),
        F.coalesce(F.col("sm.sla_met_cases"), F.lit(0)).alias("sla_met_cases"),
        F.coalesce(F.col("sm.sla_breached_cases"), F.lit(0)).alias("sla_breached_cases"),
        F.col("sm.avg_recruiter_stage_duration_days").alias("avg_recruiter_stage_duration_days"),
        F.col("sm.sla_compliance_rate").alias("sla_compliance_rate"),
        F.coalesce(F.col("om.total_offers"), F.lit(0)).alias("total_offers"),
        F.coalesce(F.col("om.accepted_offers"), F.lit(0)).alias("accepted_offers"),
    )


# -- K6 / K7 -----------------------------------------------------------------------------------

def _stage_order(col: str, stages: StageConfig) -> Column:
    return stage_rank(col, stages.order, stages.unknown_order).cast("bigint")


def mart_funnel(stg_events_df: DataFrame, stages: StageConfig = DEFAULT_STAGES) -> DataFrame:
    """K6: distinct applications that had an event into each stage."""
    return (
        stg_events_df.filter(F.col("current_stage").isNotNull())
        .groupBy(F.col("current_stage").alias("stage_name"))
        .agg(F.count_distinct("application_id").alias("applications_reached"))
        .select(_stage_order("stage_name", stages).alias("stage_order"), "stage_name", "applications_reached")
    )


def mart_funnel_by_scope(stg_events_df: DataFrame, fact_app: DataFrame, dim_job_df: DataFrame,
                         stages: StageConfig = DEFAULT_STAGES) -> DataFrame:
    """K7: K6 per (office, department); events inner-joined to applications.

    Events are first reduced to distinct (application, stage) pairs, so the
    join sees one row per pair instead of one per event.
    """
    reached = (
        stg_events_df.filter(F.col("current_stage").isNotNull() & F.col("application_id").isNotNull())
        .select("application_id", F.col("current_stage").alias("stage_name")).distinct()
        .alias("e")
    )
    a = fact_app.select("application_id", "job_id", "office_id", "department_id").alias("a")
    j = dim_job_df.select("job_id", "office_name", "department_name").alias("j")
    classified = reached.join(a, F.col("e.application_id") == F.col("a.application_id"), "inner").join(
        j, F.col("a.job_id") == F.col("j.job_id"), "left"
    )
    return classified.groupBy(
        F.col("a.office_id").alias("office_id"),
        F.coalesce(F.col("j.office_name"), F.lit(UNKNOWN_OFFICE)).alias("office_name"),
        F.col("a.department_id").alias("department_id"),
        F.coalesce(F.col("j.department_name"), F.lit(UNKNOWN_DEPARTMENT)).alias("department_name"),
        _stage_order("e.stage_name", stages).alias("stage_order"),
        F.col("e.stage_name").alias("stage_name"),
    ).agg(F.count_distinct("e.application_id").alias("applications_reached"))


# -- K8 -----------------------------------------------------------------------------------------

def mart_sla_breaches(fact_transitions: DataFrame, fact_app: DataFrame, dim_candidate_df: DataFrame,
                      dim_job_df: DataFrame, dim_recruiter_df: DataFrame) -> DataFrame:
    """K8: owned transitions that missed their SLA, with display names."""
    t = fact_transitions.filter(F.col("is_recruiter_owned_stage") & (F.col("sla_met") == F.lit(False))).alias("t")
    a = fact_app.select("application_id", "candidate_id", "job_id", "application_status", "current_stage").alias("a")
    c = dim_candidate_df.select("candidate_id", "candidate_full_name").alias("c")
    j = dim_job_df.select("job_id", "job_name", "department_name", "office_name").alias("j")
    r = dim_recruiter_df.alias("r")
    joined = (
        t.join(a, F.col("t.application_id") == F.col("a.application_id"), "left")
        .join(c, F.col("a.candidate_id") == F.col("c.candidate_id"), "left")
        .join(j, F.col("a.job_id") == F.col("j.job_id"), "left")
        .join(r, F.col("t.recruiter_id") == F.col("r.recruiter_id"), "left")
    )
    return joined.select(
        F.col("t.application_id").alias("application_id"),
        F.col("a.candidate_id").alias("candidate_id"),
        F.col("c.candidate_full_name").alias("candidate_full_name"),
        F.col("a.job_id").alias("job_id"),
        F.col("j.job_name").alias("job_name"),
        F.col("t.recruiter_id").alias("recruiter_id"),
        F.col("r.recruiter_name").alias("recruiter_name"),
        F.col("t.department_id").alias("department_id"),
        F.col("j.department_name").alias("department_name"),
        F.col("t.office_id").alias("office_id"),
        F.col("j.office_name").alias("office_name"),
        F.col("t.stage_name").alias("stage_name"),
        F.col("t.stage_started_at").alias("stage_started_at"),
        F.col("t.stage_ended_at").alias("stage_ended_at"),
        F.col("t.duration_days").alias("duration_days"),
        F.col("t.sla_target_days").alias("sla_target_days"),
        F.col("a.application_status").alias("application_status"),
        F.col("a.current_stage").alias("current_stage"),
    )


# -- K9 -------------------------------------------------------------------------------------------

def mart_tth_diagnostics(fact_app: DataFrame, as_of=None) -> DataFrame:
    """K9: hired applications with / without a valid time to hire, split by source."""
    hired = F.col("is_hired")
    valid = hired & F.col("time_to_hire_days").isNotNull()
    tth_hired = F.when(hired, F.col("time_to_hire_days"))
    not_marker = F.coalesce(F.col("application_source"), F.lit("")) != F.lit(OPERATIONAL_SOURCE_MARKER)
    is_marker = F.col("application_source") == F.lit(OPERATIONAL_SOURCE_MARKER)
    return fact_app.agg(
        _count_when(hired).alias("total_hired_applications"),
        _count_when(valid).alias("hired_applications_with_valid_time_to_hire"),
        _mean(F.sum(tth_hired), F.count(tth_hired)).alias("avg_time_to_hire_days"),
        _count_when(valid & not_marker).alias("historical_hired_applications_included"),
        _count_when(valid & is_marker).alias("supabase_outcome_hired_applications_included"),
        _count_when(hired & F.col("time_to_hire_days").isNull()).alias("hired_applications_excluded_from_avg"),
    ).select(_as_of(as_of).alias("generated_at"), "*")


# -- K1, K2, K3, K9 from one scan ------------------------------------------------------------------

CUBE_KEYS = ("office_id", "office_name", "department_id", "department_name", "application_status")
TOTAL, BY_SCOPE, BY_STATUS = "total", "scope", "status"


def overview_cube(fact_app: DataFrame, dim_job_df: DataFrame, fact_offer_df: DataFrame, fact_transitions: DataFrame) -> DataFrame:
    """The measures of K1, K2, K3 and K9 in one aggregate over one scan of each fact.

    Grouping sets: everything (``grain`` total), (office, department) (scope)
    and named (office, department, status) (status).  A few rows; the four marts
    are selections of it.
    """
    names = dim_job_df.select(F.col("job_id").alias("_job"), F.col("office_name").alias("_office"), F.col("department_name").alias("_department"))
    apps = fact_app.join(names, F.col("job_id") == F.col("_job"), "left").select(
        *fact_app.columns, F.coalesce("_office", F.lit(UNKNOWN_OFFICE)).alias("office_name"),
        F.coalesce("_department", F.lit(UNKNOWN_DEPARTMENT)).alias("department_name"))
    own = ["application_id", "office_name", "department_name", "application_status"]
    none = lambda df: df.select(*[c for c in df.columns if c not in own], *[
        F.lit(None).cast(apps.schema[c].dataType).alias(c) for c in own])
    tagged = _overview_inputs(apps, none(dim_job_df), none(fact_offer_df), none(fact_transitions), ["office_id", "department_id", *own])
    keys = [F.col(c) for c in CUBE_KEYS]
    sets = [[], [F.col("office_id"), F.col("department_id")], keys]
    hired = (F.col("src") == "app") & F.col("is_hired")
    agg = tagged.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_set"), *_overview_measures(),
        F.count_distinct("application_id").alias("distinct_applications"),
        _count_when(hired & F.col("time_to_hire_days").isNull()).alias("hired_applications_excluded_from_avg"),
    )
    # the sets by the keys they leave out: all five, three, none
    grain = F.when(F.col("_set") == 0, F.lit(BY_STATUS)).when(F.bit_count("_set") == 3, F.lit(BY_SCOPE)).otherwise(F.lit(TOTAL))
    return agg.select(grain.alias("grain"), *[c for c in agg.columns if c != "_set"])


def status_from_cube(cube: DataFrame) -> DataFrame:
    """K1."""
    rows = cube.where((F.col("grain") == BY_STATUS) & (F.col("total_applications") > 0))
    scope = Window.partitionBy("office_id", "department_id")
    counts = rows.select(*CUBE_KEYS, F.col("distinct_applications").alias("applications_count"))
    return counts.select("*", safe_divide(F.col("applications_count"), F.sum("applications_count").over(scope)).alias("status_share"))


def overview_from_cube(cube: DataFrame, as_of=None) -> DataFrame:
    """K2."""
    return _overview_row(cube.where(F.col("grain") == TOTAL), as_of)


def overview_scopes_from_cube(cube: DataFrame, dim_job_df: DataFrame, as_of=None) -> DataFrame:
    """K3."""
    rows = cube.where((F.col("grain") == BY_SCOPE) & F.col("office_id").isNotNull() & F.col("department_id").isNotNull())
    return _overview_scopes(rows.drop("grain", "office_name", "department_name", "application_status"), dim_job_df, as_of)


def diagnostics_from_cube(cube: DataFrame, as_of=None) -> DataFrame:
    """K9."""
    return cube.where(F.col("grain") == TOTAL).select(
        _as_of(as_of).alias("generated_at"), F.col("hired_applications").alias("total_hired_applications"),
        "hired_applications_with_valid_time_to_hire", "avg_time_to_hire_days",
        F.col("historical_hired_applications_with_valid_time_to_hire").alias("historical_hired_applications_included"),
        F.col("supabase_outcome_hired_applications_with_valid_time_to_hire").alias("supabase_outcome_hired_applications_included"),
        "hired_applications_excluded_from_avg",
    )
