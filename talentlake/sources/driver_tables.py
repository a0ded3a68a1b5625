"""Adapter: derive the applicant-tracking raw tables from the driver's tables.

The test data is TPC-H-like, so the hiring domain is derived from it once,
here in Spark and once as a DuckDB CTE prefix (``talentlake.oracle``), with
identical rules:

==============  ===============================================================
jobs            supplier (+ nation for the office, region ``s_suppkey % 5`` for
                the department); no office when ``s_suppkey % 11 = 0``; no
                recruiter when ``s_suppkey % 7 = 0``
candidates      customer; recruiter ``c_nationkey % 18``, none when ``% 7 = 0``
applications    orders, job = smallest supplier on its lines; status from
                ``o_orderstatus``; stage from ``o_orderpriority``
offers          lineitem, one offer per line (ids repeat, as raw feeds do)
openings        part
stage events    events; stage from ``event_type``; previous stage = stage of
                the user's preceding event; ids ``event_id % 10 = 0`` are
                delivered a second time in a later load
==============  ===============================================================

Every derived value is rendered as raw text, with the ``"(null)"`` marker and
some unparsable text, so the raw → staging path is exercised for real.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.config import NULL_MARKER, OPERATIONAL_SOURCE_MARKER
from talentlake.functions.scalar import add_units, lookup
from talentlake.functions.windows import lag_by_key
from talentlake.sources.raw import RAW_COLUMNS, normalise_raw

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Load metadata of the two simulated event loads and of the other tables.
FIRST_LOAD = ("batch-0001", "2024-02-01 00:00:00")
REDELIVERY_LOAD = ("batch-0002", "2024-02-02 06:00:00")

EVENT_TYPE_STAGE = {
    "signup": "Application Review",
    "view": "Recruiter Interview",
    "click": "Hiring Manager Review",
    "error": "Reference Check",
    "purchase": "Offer",
}
ORDER_PRIORITY_STAGE = {
    "1-URGENT": "Offer",
    "2-HIGH": "Reference Check",
    "3-MEDIUM": "Final Interview",
    "4-NOT SPECIFIED": "Recruiter Interview",
    "5-LOW": "Application Review",
}
ORDER_STATUS = {"O": "active", "F": "hired", "P": "rejected"}
RETURN_FLAG_OFFER_STATUS = {"A": "accepted", "R": "rejected", "N": "sent"}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; ``timestamp_ntz`` columns become session-zone (UTC) timestamps."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cols = [
        F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _s(col) -> F.Column:
    return col.cast("string")


def _or_null(cond, value) -> F.Column:
    """``value`` as text, or the raw NULL marker where ``cond`` holds."""
    return F.when(cond, F.lit(NULL_MARKER)).otherwise(_s(value))


def _ts(text: str) -> F.Column:
    return F.lit(text).cast("timestamp")


def jobs_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_driver_table(spark, sf_dir, "supplier")
    # nation (25 rows) and region (5 rows) have a fixed size at every scale factor
    n = F.broadcast(read_driver_table(spark, sf_dir, "nation"))
    r = F.broadcast(read_driver_table(spark, sf_dir, "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, (s.s_suppkey % 5) == r.r_regionkey, "left")
    no_office = (F.col("s_suppkey") % 11) == 0
    no_recruiter = (F.col("s_suppkey") % 7) == 0
    recruiter = F.col("s_suppkey") % 18
    created = add_units("HOUR", F.col("s_suppkey"), _ts("2020-01-01 00:00:00"))
    closed = F.col("s_acctbal") < 0
    return j.select(
        _s(F.col("s_suppkey")).alias("ghjb_job_id"),
        F.col("s_name").alias("ghjb_job_name"),
        _s(F.col("s_suppkey") + 100000).alias("ghjb_requisition_id"),
        F.when(closed, F.lit("closed")).otherwise(F.lit("open")).alias("ghjb_job_status"),
        _s(created).alias("ghjb_created_at"),
        _s(add_units("DAY", F.lit(1), created)).alias("ghjb_opened_at"),
        F.when(closed, _s(add_units("DAY", F.lit(60), created))).alias("ghjb_closed_at"),
        _s(F.col("s_suppkey") % 5).alias("ghjb_gh_department_id"),
        F.col("r_name").alias("ghjb_gh_department_name"),
        _or_null(no_office, F.col("s_nationkey")).alias("ghjb_gh_office_id"),
        _or_null(no_office, F.col("n_name")).alias("ghjb_gh_office_name"),
        _s(F.col("s_nationkey") + 500).alias("ghjb_hiring_manager_id"),
        F.concat(F.lit("Manager "), _s(F.col("s_nationkey"))).alias("ghjb_hiring_manager_name"),
        _or_null(no_recruiter, recruiter).alias("ghjb_recruiter_id"),
        _or_null(no_recruiter, F.concat(F.lit("Recruiter "), _s(recruiter))).alias("ghjb_recruiter_name"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("Contract")).otherwise(F.lit("Full-time")).alias("ghjb_employment_type"),
        F.col("r_name").alias("ghjb_budget_owner"),
        F.concat(F.lit("Executive "), _s(F.col("s_suppkey") % 5)).alias("ghjb_executive"),
        F.when(F.col("s_suppkey") % 23 == 0, F.lit("12.5x"))
        .when(F.col("s_suppkey") % 9 == 0, F.lit("0.5"))
        .otherwise(F.lit("1.0"))
        .alias("ghjb_fte"),
        F.lit("Permanent").alias("ghjb_job_type"),
    )


def candidates_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_driver_table(spark, sf_dir, "customer")
    no_recruiter = (F.col("c_nationkey") % 7) == 0
    recruiter = F.col("c_nationkey") % 18
    created = add_units("MINUTE", F.col("c_custkey"), _ts("2019-01-01 00:00:00"))
    return c.select(
        _s(F.col("c_custkey")).alias("ghca_candidate_id"),
        F.col("c_mktsegment").alias("ghca_first_name"),
        F.col("c_name").alias("ghca_last_name"),
        _s(created).alias("ghca_created_at"),
        _s(add_units("DAY", F.lit(1), created)).alias("ghca_updated_at"),
        F.lit(NULL_MARKER).alias("ghca_status"),
        _or_null(no_recruiter, recruiter).alias("ghca_recruiter_id"),
        _or_null(no_recruiter, F.concat(F.lit("Recruiter "), _s(recruiter))).alias("ghca_recruiter_name"),
        F.lit(NULL_MARKER).alias("ghca_application_id"),
    )


def applications_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_driver_table(spark, sf_dir, "orders")
    first_supplier = (
        read_driver_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_suppkey").alias("first_suppkey"))
    )
    a = o.join(first_supplier, o.o_orderkey == first_supplier.l_orderkey, "left")
    k = F.col("o_orderkey")
    applied = F.col("o_orderdate")
    status = lookup("o_orderstatus", ORDER_STATUS)
    rejected = F.col("o_orderstatus") == "P"
    last_activity = add_units("HOUR", k % 23, add_units("DAY", k % 53, applied))
    return a.select(
        _s(k).alias("ghap_application_id"),
        _s(F.col("o_custkey")).alias("ghap_candidate_id"),
        _s(applied).alias("ghap_applied_at"),
        F.when(rejected, _s(add_units("DAY", F.lit(10), applied))).alias("ghap_rejected_at"),
        _s(last_activity).alias("ghap_last_activity_at"),
        F.when(k % 4 == 0, F.lit(OPERATIONAL_SOURCE_MARKER))
        .when(k % 4 == 1, F.lit(NULL_MARKER))
        .when(k % 4 == 2, F.lit("Referral"))
        .otherwise(F.lit("LinkedIn"))
        .alias("ghap_source"),
        F.when(rejected, F.lit("Not a fit")).otherwise(F.lit(NULL_MARKER)).alias("ghap_rejection_reason"),
        _or_null(F.col("first_suppkey").isNull(), F.col("first_suppkey")).alias("ghap_job_id"),
        status.alias("ghap_status"),
        lookup("o_orderpriority", ORDER_PRIORITY_STAGE).alias("ghap_application_current_stage"),
        F.when(k % 13 == 0, F.lit("12.5x")).when(k % 17 == 0, F.lit("123.0")).otherwise(F.lit("1")).alias("ghap_jobs_count"),
        _or_null(k % 6 == 0, add_units("DAY", (k % 97) - 5, applied)).alias("ghap_hired_at"),
    )


def offers_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_driver_table(spark, sf_dir, "lineitem")
    shipped = F.col("l_shipdate")
    return li.select(
        _s(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ghof_offer_id"),
        F.lit("1").alias("ghof_offer_version"),
        _s(F.col("l_orderkey")).alias("ghof_application_id"),
        _s(shipped).alias("ghof_created_at"),
        _s(add_units("DAY", F.lit(1), shipped)).alias("ghof_updated_at"),
        F.lit(NULL_MARKER).alias("ghof_sent_at"),
        _or_null(F.col("l_returnflag") == "N", add_units("DAY", F.lit(3), shipped)).alias("ghof_resolved_at"),
        _s(add_units("DAY", F.lit(30), shipped)).alias("ghof_starts_at"),
        lookup("l_returnflag", RETURN_FLAG_OFFER_STATUS).alias("ghof_status"),
        _s(F.col("l_suppkey")).alias("ghof_job_id"),
        F.lit(NULL_MARKER).alias("ghof_candidate_id"),
        F.lit(NULL_MARKER).alias("ghof_opening_row_id"),
        F.lit(NULL_MARKER).alias("ghof_opening_id"),
    )


def openings_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_driver_table(spark, sf_dir, "part")
    opened = add_units("HOUR", F.col("p_partkey"), _ts("2021-01-01 00:00:00"))
    closed = F.col("p_size") > 25
    return p.select(
        _s(F.col("p_partkey")).alias("ghop_id"),
        F.concat(F.lit("10000-"), _s(F.col("p_partkey"))).alias("ghop_opening_id"),
        F.when(closed, F.lit("closed")).otherwise(F.lit("open")).alias("ghop_status"),
        _s(opened).alias("ghop_opened_at"),
        F.when(closed, _s(add_units("DAY", F.lit(30), opened))).alias("ghop_closed_at"),
        F.lit(NULL_MARKER).alias("ghop_application_id"),
        F.when(closed, F.lit("Hire - New Headcount")).otherwise(F.lit(NULL_MARKER)).alias("ghop_close_reason_name"),
        F.col("p_brand").alias("ghop_priority"),
        F.col("p_type").alias("ghop_additional_hire_replacement"),
        _s(F.col("p_partkey") % 100).alias("ghop_job_id"),
    )


def event_records(spark: SparkSession, sf_dir: str, redelivered: bool = False) -> DataFrame:
    """Webhook-shaped stage events; ``redelivered`` gives the second, partial load."""
    loads = _event_loads(spark, sf_dir)
    return loads.filter(F.col("_load") == (2 if redelivered else 1)).drop("_load")


def _event_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both event loads from one pass: ids ``event_id % 10 = 0`` are emitted twice (``_load`` 1 and 2)."""
    e = read_driver_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", lookup("event_type", EVENT_TYPE_STAGE).alias("stage")
    )
    e = lag_by_key(e, "user_id", "ts", [F.col("event_id")], ["stage"], prefix="prev_")
    load = F.explode(
        F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    )
    e = e.select("*", load.alias("_load"))
    first = F.col("prev_stage").isNull()
    return e.select(
        F.lit("7000001").alias("organization_id"),
        F.when(F.col("_load") == 2, F.lit("Acme Talent (redelivered)")).otherwise(F.lit("Acme Talent"))
        .alias("organization_name"),
        F.lit("candidate_stage_change").alias("action"),
        _s(F.col("user_id")).alias("application_id"),
        F.when(first, F.lit(NULL_MARKER)).otherwise(F.lit("active")).alias("previous_status"),
        F.lit("active").alias("current_status"),
        _s(F.col("ts")).alias("last_activity_at"),
        F.lit(NULL_MARKER).alias("rejected_at"),
        F.lit(NULL_MARKER).alias("rejection_reason"),
        F.lit(NULL_MARKER).alias("rejection_details"),
        F.coalesce(F.col("prev_stage"), F.lit(NULL_MARKER)).alias("previous_stage"),
        F.coalesce(F.col("stage"), F.lit(NULL_MARKER)).alias("current_stage"),
        "_load",
    )


_RECORD_BUILDERS = {
    "jobs": jobs_records,
    "candidates": candidates_records,
    "applications": applications_records,
    "offers": offers_records,
    "openings": openings_records,
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One raw (all-string, metadata-stamped) table derived from the driver tables."""
    if name == "application_events":
        # both loads from one pass over the events, each row stamped with its own load's metadata
        return _with_load_metadata(_event_loads(spark, sf_dir))
    records = _RECORD_BUILDERS[name](spark, sf_dir)
    assert tuple(records.columns) == RAW_COLUMNS[name], name
    return normalise_raw(records, name, *FIRST_LOAD)


def _with_load_metadata(loads: DataFrame) -> DataFrame:
    """Normalise both event loads, stamping each row with its own load's metadata."""
    cols = [c for c in loads.columns if c != "_load"]
    normal = [F.nullif(F.col(c).cast("string"), F.lit(NULL_MARKER)).alias(c) for c in cols]
    again = F.col("_load") == 2
    return loads.select(
        *normal,
        F.when(again, F.lit(REDELIVERY_LOAD[0])).otherwise(F.lit(FIRST_LOAD[0])).alias("_ingestion_batch_id"),
        F.when(again, F.lit(REDELIVERY_LOAD[1])).otherwise(F.lit(FIRST_LOAD[1])).alias("_ingested_at"),
        F.lit("greenhouse").alias("_source_system"),
        F.lit("application_events").alias("_source_object"),
        F.lit("api_sync").alias("_loaded_by"),
    )


class RawTables:
    """Lazily built raw tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = raw_table(self.spark, self.sf_dir, name)
        return self._cache[name]
