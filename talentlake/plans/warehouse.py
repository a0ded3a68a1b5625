"""The model graph: raw → staging → core → marts, as lazily built DataFrames.

Each model is a property computed once per ``Warehouse`` from the models it
depends on, in a fixed order (the dependency graph is static). Nothing is
executed until an action runs on a mart; ``refresh.publish`` materialises the
graph layer by layer.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from talentlake.config import DEFAULT_STAGES, StageConfig
from talentlake.functions.windows import HotKeys, hot_keys
from talentlake.operators import core, marts, staging

STAGING_MODELS = ("stg_events", "stg_applications", "stg_candidates", "stg_jobs", "stg_offers", "stg_openings")
CORE_MODELS = (
    "dim_candidate", "dim_job", "dim_office", "dim_department", "dim_recruiter",
    "fact_application", "fact_offer", "fact_stage_transition",
)
MART_MODELS = (
    "mart_status_by_scope", "mart_exec_overview", "mart_exec_overview_by_scope", "mart_recruiter_performance",
    "mart_recruiter_workload", "mart_funnel", "mart_funnel_by_scope", "mart_sla_breaches", "mart_tth_diagnostics",
)

# Written once, in this order, by whatever reads several of them.  De-duplicated events feed the transitions and two
# funnel marts.
MATERIALISED = ("stg_events",) + CORE_MODELS
CUBE_MARTS = ("mart_status_by_scope", "mart_exec_overview", "mart_exec_overview_by_scope", "mart_tth_diagnostics")


class Warehouse:
    """Models over one set of raw tables (``raw[name]`` → all-string DataFrame)."""

    def __init__(self, raw: Mapping[str, DataFrame], stages: StageConfig = DEFAULT_STAGES, as_of=None,
                 transition_id_hash: str = "xxhash64",
                 overrides: Mapping[str, DataFrame] | None = None):
        self.raw = raw
        self.stages = stages
        self.as_of = as_of
        self.transition_id_hash = transition_id_hash
        self.written_events = "stg_events" in (overrides or {})
        # materialised models (e.g. published core tables) replace their definition
        for name, df in (overrides or {}).items():
            self.__dict__[name] = df

    def model(self, name: str) -> DataFrame:
        return getattr(self, name)

    # -- staging --
    @cached_property
    def stg_events(self) -> DataFrame:
        return staging.stg_events(self.raw["application_events"])

    @cached_property
    def stg_applications(self) -> DataFrame:
        return staging.stg_applications(self.raw["applications"])

    @cached_property
    def stg_candidates(self) -> DataFrame:
        return staging.stg_candidates(self.raw["candidates"])

    @cached_property
    def stg_jobs(self) -> DataFrame:
        return staging.stg_jobs(self.raw["jobs"])

    @cached_property
    def stg_offers(self) -> DataFrame:
        return staging.stg_offers(self.raw["offers"])

    @cached_property
    def stg_openings(self) -> DataFrame:
        return staging.stg_openings(self.raw["openings"])

    @cached_property
    def event_hot_keys(self) -> HotKeys:
        """Applications whose events are split: sketched from the written events, or else before the de-duplication."""
        events = self.stg_events if self.written_events else staging.stg_events_typed(self.raw["application_events"])
        return hot_keys(events, "application_id", "event_at", core.event_order_tiebreak(self.stages))

    # -- core --
    @cached_property
    def dim_candidate(self) -> DataFrame:
        return core.dim_candidate(self.stg_candidates)

    @cached_property
    def dim_job(self) -> DataFrame:
        return core.dim_job(self.stg_jobs)

    @cached_property
    def dim_office(self) -> DataFrame:
        return core.dim_office(self.stg_jobs)

    @cached_property
    def dim_department(self) -> DataFrame:
        return core.dim_department(self.stg_jobs)

    @cached_property
    def dim_recruiter(self) -> DataFrame:
        return core.dim_recruiter(self.stg_jobs, self.stg_candidates)

    @cached_property
    def fact_application(self) -> DataFrame:
        return core.fact_application(self.stg_applications, self.stg_jobs, self.stg_candidates)

    @cached_property
    def fact_offer(self) -> DataFrame:
        return core.fact_offer(self.stg_offers, self.fact_application)

    @cached_property
    def fact_stage_transition(self) -> DataFrame:
        return core.fact_stage_transition(
            self.stg_events, self.fact_application, self.stages,
            id_hash=self.transition_id_hash, hot=self.event_hot_keys,
        )

    # -- marts --
    @cached_property
    def mart_status_by_scope(self) -> DataFrame:
        return marts.mart_status_by_scope(self.fact_application, self.dim_job)

    @cached_property
    def mart_exec_overview(self) -> DataFrame:
        return marts.mart_exec_overview(
            self.fact_application, self.dim_job, self.fact_offer, self.fact_stage_transition, self.as_of
        )

    @cached_property
    def mart_exec_overview_by_scope(self) -> DataFrame:
        return marts.mart_exec_overview_by_scope(
            self.fact_application, self.dim_job, self.fact_offer, self.fact_stage_transition, self.as_of
        )

    @cached_property
    def mart_recruiter_performance(self) -> DataFrame:
        return marts.mart_recruiter_performance(self.fact_stage_transition, self.dim_recruiter, self.dim_job)

    @cached_property
    def mart_recruiter_workload(self) -> DataFrame:
        return marts.mart_recruiter_workload(
            self.fact_application, self.fact_stage_transition, self.fact_offer,
            self.dim_recruiter, self.dim_office, self.dim_department,
        )

    @cached_property
    def mart_funnel(self) -> DataFrame:
        return marts.mart_funnel(self.stg_events, self.stages)

    @cached_property
    def mart_funnel_by_scope(self) -> DataFrame:
        return marts.mart_funnel_by_scope(self.stg_events, self.fact_application, self.dim_job, self.stages)

    @cached_property
    def mart_sla_breaches(self) -> DataFrame:
        return marts.mart_sla_breaches(
            self.fact_stage_transition, self.fact_application, self.dim_candidate, self.dim_job, self.dim_recruiter
        )

    @cached_property
    def mart_tth_diagnostics(self) -> DataFrame:
        return marts.mart_tth_diagnostics(self.fact_application, self.as_of)

    # -- marts of one scan --
    @cached_property
    def overview_cube(self) -> DataFrame:
        return marts.overview_cube(self.fact_application, self.dim_job, self.fact_offer, self.fact_stage_transition)

    def from_cube(self, name: str) -> DataFrame:
        """K1, K2, K3 or K9 as a selection of the cube."""
        return {
            "mart_status_by_scope": lambda: marts.status_from_cube(self.overview_cube),
            "mart_exec_overview": lambda: marts.overview_from_cube(self.overview_cube, self.as_of),
            "mart_exec_overview_by_scope": lambda: marts.overview_scopes_from_cube(self.overview_cube, self.dim_job, self.as_of),
            "mart_tth_diagnostics": lambda: marts.diagnostics_from_cube(self.overview_cube, self.as_of),
        }[name]()
