"""Data-quality checks (Q1-Q8) and the declared test suite of the warehouse.

Every check returns a small DataFrame of failure counts; nothing is
collected except the final per-test result rows by ``gate`` (one row per
declared test, a bounded list). A model is scanned once for all its
not-NULL tests (one aggregate with a ``count_if`` per column), or not at all
where ``WatchedTests`` counts them while it is written; each unique test is a grouped count (partially aggregated, so a hot key is merged on
the map side).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = ("model", "column_name", "test", "failures")


def _result(df: DataFrame, model: str, column: str, test: str, failures: Column) -> DataFrame:
    return df.agg(failures.cast("bigint").alias("failures")).select(
        F.lit(model).alias("model"), F.lit(column).alias("column_name"), F.lit(test).alias("test"), "failures"
    )


def not_null(df: DataFrame, columns: Sequence[str], model: str = "") -> DataFrame:
    """Q1: NULL count per column, one scan; one row per column."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("failures")) for i, c in enumerate(columns)
    ]))
    return agg.select(stacked.alias("r")).select(
        F.lit(model).alias("model"), "r.column_name", F.lit("not_null").alias("test"), F.col("r.failures").cast("bigint").alias("failures")
    )


def unique(df: DataFrame, columns: Sequence[str], model: str = "") -> DataFrame:
    """Q2 / Q7: number of key values (single or composite, all parts non-NULL) that occur more than once."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    dups = df.select(*columns).where(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _result(dups, model, ",".join(columns), "unique", F.count(F.lit(1)))


def referential(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, model: str = "") -> DataFrame:
    """Q3: child keys (non-NULL) with no parent row."""
    keys = child.select(F.col(child_col).alias("_k")).where(F.col("_k").isNotNull())
    orphans = keys.join(parent.select(F.col(parent_col).alias("_k")), "_k", "left_anti")
    return _result(orphans, model, child_col, "relationships", F.count(F.lit(1)))


def accepted_values(df: DataFrame, column: str, values: Iterable[str], model: str = "") -> DataFrame:
    """Q4: non-NULL values outside the accepted set."""
    c = F.col(column)
    return _result(df, model, column, "accepted_values", F.count_if(c.isNotNull() & ~c.isin(list(values))))


def castable(df: DataFrame, column: str, to_type: str, model: str = "") -> DataFrame:
    """Q5: text present but not castable (NULL after ``try_cast``); also the cast-to-NULL rate of N2."""
    c = F.col(column)
    return _result(df, model, column, f"castable_{to_type}", F.count_if(c.isNotNull() & c.try_cast(to_type).isNull()))


def required_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Q6: required columns missing from a schema (schema only, no job)."""
    return [c for c in required if c not in df.columns]


def duplicate_rate(df: DataFrame, key: Sequence[str] | None = None, model: str = "") -> DataFrame:
    """Q8: rows, distinct rows (on ``key`` or all columns), duplicates and their share."""
    cols = list(key or df.columns)
    distinct = df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("v"))
    # two one-row counts combined by one aggregate over a tagged union (no join)
    tagged = (
        df.agg(F.count(F.lit(1)).alias("v")).select(F.lit("rows").alias("k"), "v")
        .unionByName(distinct.select(F.lit("distinct_rows").alias("k"), "v"))
    )
    out = tagged.agg(
        F.max(F.when(F.col("k") == "rows", F.col("v"))).alias("rows"),
        F.max(F.when(F.col("k") == "distinct_rows", F.col("v"))).alias("distinct_rows"),
    )
    return out.select(
        F.lit(model).alias("model"), "rows", "distinct_rows",
        (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"),
        F.try_divide((F.col("rows") - F.col("distinct_rows")).cast("double"), F.col("rows").cast("double")).alias("duplicate_rate"),
    )


@dataclass(frozen=True)
class ModelTests:
    model: str
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()


# The warehouse's declared column tests (sources, core and marts).
WAREHOUSE_TESTS = (
    ModelTests("raw_jobs", ("ghjb_job_id",), ("ghjb_job_id",)),
    ModelTests("raw_candidates", ("ghca_candidate_id",), ("ghca_candidate_id",)),
    ModelTests("raw_applications", ("ghap_application_id",), ("ghap_application_id",)),
    ModelTests("raw_application_events", ("application_id", "action", "last_activity_at")),
    ModelTests("dim_job", ("job_id", "job_name", "job_status"), ("job_id",)),
    ModelTests("dim_candidate", ("candidate_id", "candidate_full_name"), ("candidate_id",)),
    ModelTests("dim_recruiter", ("recruiter_id", "recruiter_name"), ("recruiter_id",)),
    ModelTests("dim_office", ("office_id", "office_name"), ("office_id",)),
    ModelTests("dim_department", ("department_id", "department_name"), ("department_id",)),
    ModelTests("fact_application", ("application_id", "candidate_id", "job_id", "application_status"), ("application_id",)),
    ModelTests("fact_offer", ("offer_id", "application_id", "offer_status"), ("offer_id",)),
    ModelTests("fact_stage_transition", ("stage_transition_id", "application_id", "stage_name", "stage_started_at",
                                         "stage_ended_at"), ("stage_transition_id",)),
    ModelTests("mart_exec_overview", ("generated_at", "total_jobs", "total_applications", "recruiter_sla_compliance_rate")),
    ModelTests("mart_funnel", ("stage_name", "applications_reached")),
    ModelTests("mart_recruiter_performance", ("recruiter_id", "recruiter_name", "stage_name", "total_cases",
                                              "sla_compliance_rate")),
    ModelTests("mart_sla_breaches", ("application_id", "recruiter_name", "stage_name", "duration_days", "sla_target_days")),
    ModelTests("mart_tth_diagnostics", ("generated_at", "total_hired_applications",
                                        "hired_applications_with_valid_time_to_hire")),
    ModelTests("mart_exec_overview_by_scope", ("generated_at", "office_name", "department_name", "total_jobs",
                                               "total_applications")),
    ModelTests("mart_status_by_scope", ("office_name", "department_name", "application_status", "applications_count")),
    ModelTests("mart_funnel_by_scope", ("office_name", "department_name", "stage_name", "applications_reached")),
    ModelTests("mart_recruiter_workload", ("recruiter_name", "office_name", "department_name", "total_applications",
                                           "active_applications", "recruiter_owned_stage_cases")),
)


def not_null_and_unique(df: DataFrame, not_null_cols: Sequence[str], unique_col: str, model: str = "") -> DataFrame:
    """Q1 + Q2 for one model in a single grouped pass.

    Grouping by the unique key gives, per key, its row count and its NULL
    counts; one global aggregate then yields the duplicate-key count and
    the NULL totals (partial aggregation on both levels).
    """
    per_key = df.groupBy(unique_col).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(not_null_cols)],
    )
    totals = per_key.agg(
        F.count_if(F.col(unique_col).isNotNull() & (F.col("_n") > 1)).alias("_dup"),
        *[F.coalesce(F.sum(f"_z{i}"), F.lit(0)).alias(f"_z{i}") for i in range(len(not_null_cols))],
    )
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit("not_null").alias("test"), F.col(f"_z{i}").cast("bigint").alias("failures"))
            for i, c in enumerate(not_null_cols)]
    rows.append(F.struct(F.lit(unique_col).alias("column_name"), F.lit("unique").alias("test"),
                         F.col("_dup").cast("bigint").alias("failures")))
    return totals.select(F.explode(F.array(*rows)).alias("r")).select(
        F.lit(model).alias("model"), "r.column_name", "r.test", "r.failures"
    )


class WatchedTests:
    """Not-NULL, accepted-value and cast tests of a model, counted by the job that writes it (Q1, Q4, Q5).

    ``df`` is the model with the counts observed; once a job has run it to the
    end, ``results`` are the failures.  No second read of the model.
    """

    def __init__(self, df: DataFrame, model: str, not_null: Sequence[str] = (), accepted: Mapping[str, Iterable[str]] | None = None,
                 castable: Mapping[str, str] | None = None):
        self.model = model
        tests = [(c, "not_null", F.col(c).isNull()) for c in not_null]
        tests += [(c, "accepted_values", F.col(c).isNotNull() & ~F.col(c).isin(list(v))) for c, v in (accepted or {}).items()]
        tests += [(c, f"castable_{k}", F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()) for c, k in (castable or {}).items()]
        self.names = [(c, test) for c, test, _ in tests]
        self._seen = Observation(f"tests_{model}")
        counts = [F.coalesce(F.count_if(failed), F.lit(0)).alias(f"t{i}") for i, (_, _, failed) in enumerate(tests)]
        self.df = df.observe(self._seen, *counts) if counts else df

    def results(self) -> list[tuple[str, str, str, int]]:
        seen = self._seen.get if self.names else {}
        return [(self.model, c, test, int(seen[f"t{i}"])) for i, (c, test) in enumerate(self.names)]


def result_rows(spark: SparkSession, rows: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """Observed results (one row per declared test) as a frame like the checks' own."""
    return spark.createDataFrame(list(rows), "model string, column_name string, test string, failures long")


def run_suite(models: Mapping[str, DataFrame] | Callable[[str], DataFrame],
              tests: Sequence[ModelTests] = WAREHOUSE_TESTS, watched: Sequence[tuple[str, str, str, int]] = ()) -> DataFrame:
    """All declared tests → one row per (model, column, test) with its failure count.

    A model with a unique test is read once for all its tests.  ``watched``:
    results counted while writing; of these models only unique tests are left.
    """
    get = models if callable(models) else models.__getitem__
    done = {row[0] for row in watched}
    parts: list[DataFrame] = []
    for t in tests:
        if t.model in done and not t.unique:
            continue
        df = get(t.model)
        if t.model in done:
            parts += [unique(df, [col], t.model) for col in t.unique]
        elif t.unique:
            parts.append(not_null_and_unique(df, t.not_null, t.unique[0], t.model))
            for col in t.unique[1:]:
                parts.append(unique(df, [col], t.model))
        elif t.not_null:
            parts.append(not_null(df, t.not_null, t.model))
    out = parts.pop(0) if not watched else result_rows(get(tests[0].model).sparkSession, watched)
    for p in parts:
        out = out.unionByName(p)
    return out


class QualityError(RuntimeError):
    pass


def gate(results: DataFrame, warn_only: Iterable[tuple[str, str, str]] = ()) -> list[tuple[str, str, str, int]]:
    """Raise ``QualityError`` if a test failed (except ``warn_only`` ones); return all failures.

    Only the per-test result rows (a bounded list) reach the driver.
    """
    failed = [(r.model, r.column_name, r.test, int(r.failures)) for r in results.filter(F.col("failures") > 0).collect()]
    allowed = set(warn_only)
    blocking = [f for f in failed if f[:3] not in allowed]
    if blocking:
        raise QualityError("data-quality tests failed: " + "; ".join(f"{m}.{c} {t}: {n}" for m, c, t, n in blocking))
    return failed
