"""Registered data-quality queries (Q1-Q8) over the raw, staging and core models."""

from __future__ import annotations

from talentlake.operators import quality
from talentlake.config import DRIVER_TABLE_STAGES
from talentlake.oracle import AS_OF, _in, long_sql, with_base
from talentlake.plans.catalog import MART_SQL, facts_written, register, warehouse
from talentlake.plans.catalog_serve import _mart_cte
from talentlake.plans.warehouse import CUBE_MARTS, MART_MODELS, MATERIALISED, Warehouse
from talentlake.session import ensure_session_defaults, stored
from talentlake.sources.driver_tables import RawTables

SUITE = quality.WAREHOUSE_TESTS
RAW_NAMES = {"raw_jobs": "jobs", "raw_candidates": "candidates", "raw_applications": "applications",
             "raw_application_events": "application_events"}
SQL_NAMES = {"raw_application_events": "raw_events"}


def _models(spark, sf_dir):
    w = facts_written(spark, sf_dir)
    raw = RawTables(spark, sf_dir)

    def get(name: str):
        return raw[RAW_NAMES[name]] if name in RAW_NAMES else w.model(name)

    return w, raw, get


def _suite_sql(suite) -> str:
    parts = []
    for t in suite:
        src = SQL_NAMES.get(t.model, t.model)
        for c in t.not_null:
            parts.append(f"SELECT '{t.model}' AS model, '{c}' AS column_name, 'not_null' AS test, "
                         f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS failures FROM {src}")
        for c in t.unique:
            parts.append(f"SELECT '{t.model}' AS model, '{c}' AS column_name, 'unique' AS test, "
                         f"CAST(count(*) AS BIGINT) AS failures FROM (SELECT {c} FROM {src} WHERE {c} IS NOT NULL "
                         f"GROUP BY {c} HAVING count(*) > 1)")
    return "\nUNION ALL\n".join(parts)


MARTS_SQL = ",\n".join(_mart_cte(k, v) for k, v in MART_SQL.items())


@register("dq_suite", with_base(_suite_sql(SUITE), extra_ctes=MARTS_SQL))
def q_dq_suite(spark, sf_dir):
    """All declared tests: not-NULL ones counted while the models are written, the overview marts from one cube."""
    raw, built, watched = RawTables(spark, sf_dir), {}, []
    ensure_session_defaults(spark)
    tests = {t.model: t for t in SUITE}

    def model() -> Warehouse:
        return Warehouse(raw, DRIVER_TABLE_STAGES, as_of=AS_OF, transition_id_hash="md5", overrides=built)

    def build(name: str, df) -> None:
        seen = quality.WatchedTests(df, name, tests[name].not_null if name in tests else ())
        built[name] = stored(seen.df, name)
        watched.extend(seen.results())

    for name in MATERIALISED:
        build(name, model().model(name))
    build("overview_cube", model().overview_cube)
    w = model()
    for name in MART_MODELS:
        build(name, w.from_cube(name) if name in CUBE_MARTS else w.model(name))
    return quality.run_suite(lambda n: raw[RAW_NAMES[n]] if n in RAW_NAMES else built[n], SUITE, watched)


@register("dq_referential", with_base("""
SELECT 'fact_application' AS model, 'job_id' AS column_name, 'relationships' AS test, CAST(count(*) AS BIGINT) AS failures
FROM fact_application f WHERE f.job_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_job d WHERE d.job_id = f.job_id)
UNION ALL
SELECT 'fact_offer', 'application_id', 'relationships', CAST(count(*) AS BIGINT)
FROM fact_offer o WHERE o.application_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fact_application a WHERE a.application_id = o.application_id)
UNION ALL
SELECT 'stg_events', 'application_id', 'relationships', CAST(count(*) AS BIGINT)
FROM stg_events e WHERE e.application_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fact_application a WHERE a.application_id = e.application_id)"""))
def q_dq_referential(spark, sf_dir):
    w = facts_written(spark, sf_dir)
    return (
        quality.referential(w.fact_application, "job_id", w.dim_job, "job_id", "fact_application")
        .unionByName(quality.referential(w.fact_offer, "application_id", w.fact_application, "application_id", "fact_offer"))
        .unionByName(quality.referential(w.stg_events, "application_id", w.fact_application, "application_id", "stg_events"))
    )


ACCEPTED = (
    ("fact_application", "application_status", ("active", "rejected", "hired")),
    ("fact_offer", "offer_status", ("accepted", "sent", "rejected")),
    ("dim_job", "job_status", ("open", "closed")),
    ("stg_openings", "opening_status", ("open", "closed")),
)


@register("dq_accepted_values", with_base("\nUNION ALL\n".join(
    f"SELECT '{m}' AS model, '{c}' AS column_name, 'accepted_values' AS test, "
    f"CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN {_in(v)}) AS BIGINT) AS failures FROM {m}"
    for m, c, v in ACCEPTED)))
def q_dq_accepted_values(spark, sf_dir):
    w = warehouse(spark, sf_dir)
    parts = [quality.accepted_values(w.model(m), c, v, m) for m, c, v in ACCEPTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CASTS = (
    ("applications", "raw_applications", "ghap_jobs_count", "bigint"),
    ("jobs", "raw_jobs", "ghjb_fte", "double"),
    ("openings", "raw_openings", "ghop_opening_id", "bigint"),
    ("applications", "raw_applications", "ghap_applied_at", "timestamp"),
)


def _cast_fail_sql(col: str, to_type: str) -> str:
    if to_type == "bigint":
        return f"{long_sql(col)} IS NULL"
    return f"TRY_CAST({col} AS {to_type.upper()}) IS NULL"


@register("dq_castable", with_base("\nUNION ALL\n".join(
    f"SELECT '{sql_name}' AS model, '{c}' AS column_name, 'castable_{t}' AS test, "
    f"CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND {_cast_fail_sql(c, t)}) AS BIGINT) AS failures FROM {sql_name}"
    for _, sql_name, c, t in CASTS)))
def q_dq_castable(spark, sf_dir):
    raw = RawTables(spark, sf_dir)
    parts = [quality.castable(raw[name], c, t, sql_name) for name, sql_name, c, t in CASTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EVENT_KEY_RAW = ("application_id", "action", "previous_status", "current_status", "previous_stage", "current_stage",
                 "last_activity_at")


@register("dq_duplicate_rate", with_base(f"""
SELECT 'raw_application_events' AS model, count(*) AS rows,
  (SELECT count(*) FROM (SELECT DISTINCT {', '.join(EVENT_KEY_RAW)} FROM raw_events)) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(EVENT_KEY_RAW)} FROM raw_events)) AS duplicate_rows,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(EVENT_KEY_RAW)} FROM raw_events)) AS DOUBLE)
    / CAST(count(*) AS DOUBLE) AS duplicate_rate
FROM raw_events"""))
def q_dq_duplicate_rate(spark, sf_dir):
    raw = RawTables(spark, sf_dir)
    return quality.duplicate_rate(raw["application_events"], EVENT_KEY_RAW, "raw_application_events")
