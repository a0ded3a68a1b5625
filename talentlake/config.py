"""Domain configuration: stage order, SLA targets, eligibility sets.

Everything that a user may want to change is a field of ``StageConfig``;
operators take the config as a parameter instead of reading globals.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Recruitment stages in process order (rank 1..12); unknown stages rank 99 in
# the funnel marts and NULL in the change-workflow validation.
STAGE_ORDER = (
    "Application Review",
    "AI Recommendation Review",
    "Recruiter Interview",
    "Hiring Manager Review",
    "Hiring Manager Interview",
    "Take Home Test",
    "Face to Face",
    "HR Interview",
    "Final Interview",
    "Final (Executive) Interview",
    "Reference Check",
    "Offer",
)
UNKNOWN_STAGE_ORDER = 99

# Recruiter-owned stages and their SLA in days.
RECRUITER_OWNED_SLA_DAYS = {"Application Review": 3, "Recruiter Interview": 3}

# Application statuses.
STATUS_ACTIVE = "active"
STATUS_REJECTED = "rejected"
STATUS_HIRED = "hired"

# Outcome labels that a stage sequence may not contain.
OUTCOME_STAGE_LABELS = ("Hired", "Rejected")

# Stages from which an application may be hired.
HIRE_ELIGIBLE_STAGES = (
    "Offer",
    "Reference Check",
    "Final Interview",
    "Final (Executive) Interview",
)

# Stages from which an application may be rejected (all but AI Recommendation Review).
REJECT_ELIGIBLE_STAGES = (
    "Application Review",
    "Recruiter Interview",
    "Hiring Manager Review",
    "Hiring Manager Interview",
    "Take Home Test",
    "Face to Face",
    "HR Interview",
    "Final Interview",
    "Final (Executive) Interview",
    "Reference Check",
    "Offer",
)

# Late-stage priority used when picking outcome candidates (higher first; others 0).
LATE_STAGE_PRIORITY = {
    "Offer": 4,
    "Reference Check": 3,
    "Final (Executive) Interview": 2,
    "Final Interview": 1,
}

# Selection modes of the stage-change workflow.
MODE_MANUAL_STAGE = "Manual application selection"
MODE_GLOBAL = "Global impact"
MODE_FOCUSED = "Focused group"

# Selection modes of the hiring workflow and the stages each one admits.
MODE_OFFER_ONLY = "Offer only"
MODE_LATE_STAGE_HIRE = "Late-stage candidates"
MODE_MANUAL_OUTCOME = "Manual candidate selection"
HIRE_MODE_STAGES = {
    MODE_OFFER_ONLY: ("Offer",),
    MODE_LATE_STAGE_HIRE: HIRE_ELIGIBLE_STAGES,
}

# Selection modes of the rejection workflow and the stages each one admits.
MODE_EARLY_REJECT = "Early process rejection"
MODE_REFERENCE_CHECK_ONLY = "Reference Check only"
MODE_LATE_STAGE_REJECT = "Late-stage rejection"
REJECT_MODE_STAGES = {
    MODE_EARLY_REJECT: ("Application Review", "Recruiter Interview"),
    MODE_REFERENCE_CHECK_ONLY: ("Reference Check",),
    MODE_LATE_STAGE_REJECT: (
        "Final Interview",
        "Final (Executive) Interview",
        "Reference Check",
        "Offer",
    ),
}

# Request limits: (default, floor, ceiling); manual stage selection floors at 1.
STAGE_LIMIT = (100, 10, 500)
STAGE_MANUAL_LIMIT_FLOOR = 1
HIRE_LIMIT = (10, 1, 100)
REJECT_LIMIT = (1, 1, 100)

# Source marker of applications written by the operational workflows.
OPERATIONAL_SOURCE_MARKER = "supabase_operational_source"

# Labels used when a dimension name is missing.
UNKNOWN_OFFICE = "Unknown office"
UNKNOWN_DEPARTMENT = "Unknown department"
UNKNOWN_RECRUITER = "Unknown recruiter"

# Operator roles in priority order (first = highest); other roles rank 99.
ROLE_PRIORITY = ("super_admin", "dev_admin", "hr_manager", "business_manager", "analyst_readonly")

# Raw NULL marker.
NULL_MARKER = "(null)"

# Workflow messages.
MSG_EMPTY_SEQUENCE = "At least one recruitment stage is required"
MSG_OUTCOME_IN_SEQUENCE = "Hired and Rejected outcomes are excluded from this stage workflow"
MSG_INVALID_STAGE = "Invalid recruitment stage: "
MSG_BACKWARD_STAGE = "Invalid backward recruitment stage transition: "
MSG_HIRE_INELIGIBLE = "Application is no longer eligible for hiring outcome"
MSG_REJECT_INELIGIBLE = "Application is no longer eligible for rejection outcome"

# Request / item states.
REQ_DRY_RUN = "dry_run"
REQ_APPROVED = "approved"
REQ_APPLIED = "applied"
REQ_PARTIAL = "partially_applied"
REQ_FAILED = "failed"
ITEM_PENDING = "pending"
ITEM_APPLIED = "applied"
ITEM_SKIPPED = "skipped"
ITEM_FAILED = "failed"

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class StageConfig:
    """Stage order and SLA targets used by the core and mart operators."""

    order: tuple[str, ...] = STAGE_ORDER
    sla_days: dict[str, float] = field(default_factory=lambda: dict(RECRUITER_OWNED_SLA_DAYS))
    unknown_order: int = UNKNOWN_STAGE_ORDER

    @property
    def owned(self) -> tuple[str, ...]:
        return tuple(self.sla_days)

    def rank_of(self) -> dict[str, int]:
        return {name: i + 1 for i, name in enumerate(self.order)}

    def with_sla(self, **days: float) -> "StageConfig":
        return replace(self, sla_days={k.replace("_", " "): v for k, v in days.items()})


DEFAULT_STAGES = StageConfig()

# SLA used on the driver's synthetic tables: its event gaps are hours, not days,
# so a half-day target gives a non-degenerate met / breached split.
DRIVER_TABLE_STAGES = StageConfig(sla_days={"Application Review": 0.5, "Recruiter Interview": 0.5})
