"""The refresh job: raw → staging → core → gate → marts → gate → publish.

* Staged events and core models are written once, in dependency order, and
  re-read from storage: every later model and mart reads a materialised
  table (lineage is cut; a lost executor re-reads files instead of
  recomputing the event windows, and no fact is computed twice).
* The tests of sources and core tables run before any mart is built, the
  marts' tests before anything is published; a blocking failure stops the run.
  Not-NULL tests are counted by the writes themselves, so only unique tests
  read a table again.
* K1, K2, K3 and K9 are selections of one written cube (one scan of each fact).
* Each run writes to a new version folder; the version becomes current only
  when a marker row is appended to ``_published`` at the end, so readers
  never see a half-written version and the previous one stays readable.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.config import DEFAULT_STAGES, StageConfig
from talentlake.operators import quality
from talentlake.plans.warehouse import CUBE_MARTS, MART_MODELS, MATERIALISED, Warehouse

# Core tables sorted by application within each write task: no extra shuffle
# (files do not carry a partitioning to later readers anyway), but tight
# Parquet min/max statistics, so id lookups (P12) skip most row groups.
SORT_HINTS = {
    "fact_application": "application_id",
    "fact_offer": "application_id",
    "fact_stage_transition": "application_id",
}


NOT_NULL = {t.model: t.not_null for t in quality.WAREHOUSE_TESTS}
RAW_NAMES = {"raw_jobs": "jobs", "raw_candidates": "candidates", "raw_applications": "applications",
             "raw_application_events": "application_events"}


def _write(df: DataFrame, path: str, model: str) -> list[tuple[str, str, str, int]]:
    """Write a model; returns the results of its not-NULL tests, counted by the write."""
    watched = quality.WatchedTests(df, model, NOT_NULL.get(model, ()))
    out = watched.df.sortWithinPartitions(SORT_HINTS[model]) if model in SORT_HINTS else watched.df
    out.write.mode("overwrite").parquet(path)
    return watched.results()


def publish(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    out_root: str,
    version: str,
    stages: StageConfig = DEFAULT_STAGES,
    as_of: str | None = None,
    warn_only: Iterable[tuple[str, str, str]] = (),
) -> dict[str, str]:
    """Run the whole refresh; returns model name → path of the published version."""
    base = f"{out_root.rstrip('/')}/version={version}"
    paths: dict[str, str] = {}
    built: dict[str, DataFrame] = {}
    watched: list[tuple[str, str, str, int]] = []

    def build(name: str, df: DataFrame, layer: str) -> None:
        paths[name] = f"{base}/{layer}/{name}"
        watched.extend(_write(df, paths[name], name))
        built[name] = spark.read.schema(df.schema).parquet(paths[name])

    def passes(layer: str, tests: list[quality.ModelTests]) -> None:
        mine = [r for r in watched if r[0] in {t.model for t in tests}]
        results = quality.run_suite(lambda n: raw[RAW_NAMES[n]] if n in RAW_NAMES else built[n], tests, mine)
        paths[f"quality_{layer}"] = f"{base}/quality/{layer}"
        results.write.mode("overwrite").parquet(paths[f"quality_{layer}"])
        quality.gate(spark.read.parquet(paths[f"quality_{layer}"]), warn_only)

    # dependency order; each model is computed once and later models read the written table
    for name in MATERIALISED:
        build(name, Warehouse(raw, stages, as_of=as_of, overrides=built).model(name), "core")
    passes("core", [t for t in quality.WAREHOUSE_TESTS if t.model not in MART_MODELS])

    w = Warehouse(raw, stages, as_of=as_of, overrides=built)
    build("overview_cube", w.overview_cube, "marts")
    w = Warehouse(raw, stages, as_of=as_of, overrides=built)
    for name in MART_MODELS:
        build(name, w.from_cube(name) if name in CUBE_MARTS else w.model(name), "marts")
    passes("marts", [t for t in quality.WAREHOUSE_TESTS if t.model in MART_MODELS])
    marker = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    marker.write.mode("append").json(f"{out_root.rstrip('/')}/_published")
    return paths


def current_version(spark: SparkSession, out_root: str) -> str | None:
    """Latest published version (reads the small marker table)."""
    try:
        rows = spark.read.json(f"{out_root.rstrip('/')}/_published").orderBy(F.col("published_at").desc()).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing published yet
    return rows[0]["version"] if rows else None


def load_mart(spark: SparkSession, out_root: str, name: str, version: str | None = None) -> DataFrame:
    """A published mart (``version`` defaults to the current one)."""
    v = version or current_version(spark, out_root)
    if v is None:
        raise FileNotFoundError(f"nothing published under {out_root}")
    return spark.read.parquet(f"{out_root.rstrip('/')}/version={v}/marts/{name}")
