"""Raw layer: readers, the raw normaliser, writers and join-based upserts.

Raw contract: every business column is a string, the ``"(null)"`` marker is
NULL, nested values are JSON text, and five ingestion-metadata columns are
appended. Typing happens later, in staging.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.config import NULL_MARKER

METADATA_COLUMNS = ("_ingestion_batch_id", "_ingested_at", "_source_system", "_source_object", "_loaded_by")

# Raw column lists, in landed order.
RAW_COLUMNS: dict[str, tuple[str, ...]] = {
    "jobs": (
        "ghjb_job_id", "ghjb_job_name", "ghjb_requisition_id", "ghjb_job_status", "ghjb_created_at",
        "ghjb_opened_at", "ghjb_closed_at", "ghjb_gh_department_id", "ghjb_gh_department_name",
        "ghjb_gh_office_id", "ghjb_gh_office_name", "ghjb_hiring_manager_id", "ghjb_hiring_manager_name",
        "ghjb_recruiter_id", "ghjb_recruiter_name", "ghjb_employment_type", "ghjb_budget_owner",
        "ghjb_executive", "ghjb_fte", "ghjb_job_type",
    ),
    "candidates": (
        "ghca_candidate_id", "ghca_first_name", "ghca_last_name", "ghca_created_at", "ghca_updated_at",
        "ghca_status", "ghca_recruiter_id", "ghca_recruiter_name", "ghca_application_id",
    ),
    "applications": (
        "ghap_application_id", "ghap_candidate_id", "ghap_applied_at", "ghap_rejected_at",
        "ghap_last_activity_at", "ghap_source", "ghap_rejection_reason", "ghap_job_id", "ghap_status",
        "ghap_application_current_stage", "ghap_jobs_count", "ghap_hired_at",
    ),
    "openings": (
        "ghop_id", "ghop_opening_id", "ghop_status", "ghop_opened_at", "ghop_closed_at",
        "ghop_application_id", "ghop_close_reason_name", "ghop_priority",
        "ghop_additional_hire_replacement", "ghop_job_id",
    ),
    "offers": (
        "ghof_offer_id", "ghof_offer_version", "ghof_application_id", "ghof_created_at", "ghof_updated_at",
        "ghof_sent_at", "ghof_resolved_at", "ghof_starts_at", "ghof_status", "ghof_job_id",
        "ghof_candidate_id", "ghof_opening_row_id", "ghof_opening_id",
    ),
    "application_events": (
        "organization_id", "organization_name", "action", "application_id", "previous_status",
        "current_status", "last_activity_at", "rejected_at", "rejection_reason", "rejection_details",
        "previous_stage", "current_stage",
    ),
}


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


# -- S5: normaliser ---------------------------------------------------------------

def normalise_raw(
    records: DataFrame,
    source_object: str,
    batch_id: str,
    ingested_at: str,
    source_system: str = "greenhouse",
    loaded_by: str = "api_sync",
    marker: str | None = NULL_MARKER,
) -> DataFrame:
    """Landed records → raw table: marker → NULL, scalars → text, nested → JSON, + metadata."""
    cols = []
    for field in records.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            col = F.to_json(col)
        else:
            col = col.cast("string")
        if marker is not None:
            col = F.nullif(col, F.lit(marker))
        cols.append(col.alias(field.name))
    return records.select(
        *cols,
        F.lit(batch_id).alias("_ingestion_batch_id"),
        F.lit(ingested_at).alias("_ingested_at"),
        F.lit(source_system).alias("_source_system"),
        F.lit(source_object).alias("_source_object"),
        F.lit(loaded_by).alias("_loaded_by"),
    )


# -- S1-S4: readers ---------------------------------------------------------------------

def read_event_json(spark: SparkSession, path: str, multiline: bool = True, with_metadata: bool = False) -> DataFrame:
    """Webhook events: one top-level JSON array (``multiline``) or JSON lines (splittable, for scale).

    The file spells the stage column ``current__stage``; it is read as ``current_stage``.
    ``with_metadata`` also reads the five load-metadata columns of an already-landed raw table.
    """
    base = list(RAW_COLUMNS["application_events"])
    extra = list(METADATA_COLUMNS) if with_metadata else []
    df = spark.read.schema(string_schema(base + ["current__stage"] + extra)).option("multiLine", multiline).json(path)
    df = df.withColumn("current_stage", F.coalesce(F.col("current__stage"), F.col("current_stage")))
    return df.drop("current__stage").select(*base, *extra)


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """One landed dataset per table with an explicit all-string schema.

    A missing dataset raises (Spark's path-not-found), like a missing sheet.
    """
    schema = string_schema(RAW_COLUMNS[table])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    if fmt == "json":
        return reader.json(path)
    return spark.read.format(fmt).load(path).select(*[F.col(c).cast("string") for c in RAW_COLUMNS[table]])


def read_paged(spark: SparkSession, path: str, item_schema: T.StructType) -> DataFrame:
    """Landed page files ``{"data": [...], "count": n}`` → one record set."""
    page = T.StructType([T.StructField("data", T.ArrayType(item_schema)), T.StructField("count", T.LongType())])
    return spark.read.schema(page).json(path).select(F.explode("data").alias("r")).select("r.*")


def paged_total_check(spark: SparkSession, path: str) -> DataFrame:
    """Rows landed vs the largest ``count`` the pages announced (one row)."""
    page = T.StructType([
        T.StructField("data", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("count", T.LongType()),
    ])
    return spark.read.schema(page).json(path).agg(
        F.sum(F.size("data")).alias("rows_landed"), F.max("count").alias("rows_announced")
    ).withColumn("complete", F.col("rows_landed") == F.col("rows_announced"))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
              num_partitions: int, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Operational table over JDBC, split on a numeric column."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=dict(properties or {}))


# -- S7, S12, S14: writers ------------------------------------------------------------------

def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> int:
    """Overwrite load; returns the row count observed during the write (no second scan)."""
    from pyspark.sql import Observation

    obs = Observation("rows_written")
    writer = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return int(obs.get["rows"])


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to an event or audit log."""
    df.write.mode("append").format(fmt).save(path)


def request_report(requests: DataFrame, items: DataFrame, key: str = "request_id") -> DataFrame:
    """One JSON-ready row per request with its items nested.

    Items are grouped per request; the size of a request's item list is
    bounded by the workflow's request limit (≤ 500), so the nested list stays
    small whatever the table size.
    """
    nested = items.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in items.columns]))).alias("items")
    )
    return requests.join(nested, on=key, how="left")


# -- S10, S11: join-based upsert -----------------------------------------------------------------

def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    incoming_order: Sequence[Column] | None = None,
) -> DataFrame:
    """MERGE-like upsert as a full outer join on ``keys``.

    Duplicates inside ``incoming`` are merged first (last by ``incoming_order``).
    When ``columns`` is given only those columns take the incoming value on a
    match (a provided NULL overwrites); other columns keep the existing value.
    New keys get the incoming values (NULL for columns it lacks).
    """
    from talentlake.functions.windows import latest_per_key

    if incoming_order:
        incoming = latest_per_key(incoming, keys, incoming_order)
    else:
        incoming = incoming.dropDuplicates(list(keys))
    update_cols = list(columns) if columns is not None else [c for c in incoming.columns if c not in keys]
    inc = incoming.select(*keys, *update_cols, F.lit(True).alias("_matched_incoming"))
    ex = existing.select(*[F.col(c).alias(c if c in keys else f"_old_{c}") for c in existing.columns])
    joined = ex.join(inc, on=list(keys), how="full_outer")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("_matched_incoming"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
        else:
            out.append(F.col(f"_old_{c}").alias(c))
    return joined.select(*out)
