"""Hiring-pipeline analytics on Spark.

Every operator is a plain DataFrame-in / DataFrame-out function. Raw
applicant-tracking tables (all-string columns) are typed in
``operators.staging``, modelled in ``operators.core`` and summarised in
``operators.marts``; batch change workflows live in ``plans.changes``.
"""

from talentlake.config import StageConfig, DEFAULT_STAGES  # noqa: F401
from talentlake.session import build_session, ensure_session_defaults  # noqa: F401
