"""Mergeable exact distinct counts: funnels from stored bitmaps of applications.

A bitmap holds the applications of one range of 32,768 ids.  Bitmaps are built
per day and stage from a batch of events and only ever added to: the union of
bitmaps is the same however often and in whatever order events are delivered,
so a batch needs neither the earlier events nor their de-duplication.  The
funnel of any days is a union and a count; no event is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.config import DEFAULT_STAGES, UNKNOWN_DEPARTMENT, UNKNOWN_OFFICE, StageConfig
from talentlake.operators import marts, staging
from talentlake.sources.buckets import BucketedTable

SCHEMA = "day date, stage_name string, ids long, bitmap binary"
SCOPE = ("office_id", "office_name", "department_id", "department_name")


def _bitmaps(df: DataFrame, *keys: Column | str) -> DataFrame:
    """One bitmap per group and range of ids; a NULL id is in no bitmap but keeps its group."""
    ranged = df.withColumn("ids", F.bitmap_bucket_number("application_id")).withColumn("_at", F.bitmap_bit_position("application_id"))
    return ranged.groupBy(*keys, "ids").agg(F.bitmap_construct_agg("_at").alias("bitmap"))


def stage_bitmaps(events: DataFrame) -> DataFrame:
    """``day, stage_name, ids, bitmap`` of typed events (with or without repeated deliveries)."""
    reached = events.where(F.col("current_stage").isNotNull()).select(
        F.to_date("event_at").alias("day"), F.col("current_stage").alias("stage_name"), "application_id")
    return _bitmaps(reached, "day", "stage_name")


def funnel(bitmaps: DataFrame, stages: StageConfig = DEFAULT_STAGES) -> DataFrame:
    """K6 from stage bitmaps, of any number of days."""
    whole = bitmaps.groupBy("stage_name", "ids").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return whole.groupBy("stage_name").agg(F.sum(F.bitmap_count("bitmap")).alias("applications_reached")).select(
        marts._stage_order("stage_name", stages).alias("stage_order"), "stage_name", "applications_reached")


def scope_bitmaps(fact_app: DataFrame, dim_job_df: DataFrame) -> DataFrame:
    """The applications of each (office, department) as bitmaps."""
    a = fact_app.where(F.col("application_id").isNotNull()).select("application_id", "job_id", "office_id", "department_id")
    j = dim_job_df.select(F.col("job_id").alias("_job"), "office_name", "department_name")
    named = a.join(j, F.col("job_id") == F.col("_job"), "left")
    named = named.withColumn("office_name", F.coalesce("office_name", F.lit(UNKNOWN_OFFICE)))
    return _bitmaps(named.withColumn("department_name", F.coalesce("department_name", F.lit(UNKNOWN_DEPARTMENT))), *SCOPE)


def funnel_by_scope(bitmaps: DataFrame, scopes: DataFrame, stages: StageConfig = DEFAULT_STAGES) -> DataFrame:
    """K7: applications of a scope that reached a stage, the intersection of their bitmaps per range of ids."""
    reached = bitmaps.groupBy("stage_name", "ids").agg(F.bitmap_or_agg("bitmap").alias("_reached"))
    both = scopes.join(reached, "ids").select(*SCOPE, "stage_name", "ids", F.explode(F.array("bitmap", "_reached")).alias("bitmap"))
    common = both.groupBy(*SCOPE, "stage_name", "ids").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
    counted = common.groupBy(*SCOPE, "stage_name").agg(F.sum(F.bitmap_count("bitmap")).alias("applications_reached"))
    return counted.where("applications_reached > 0").select(
        *SCOPE, marts._stage_order("stage_name", stages).alias("stage_order"), "stage_name", "applications_reached")


class FunnelBitmaps:
    """Stored stage bitmaps, dealt by range of ids; also a ``foreachBatch`` handler of raw events."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, folders: int = 8):
        self.folders = folders
        self.table = BucketedTable(spark, path, spark.createDataFrame([], SCHEMA).schema, ["ids"], buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.add(staging.stg_events_typed(batch), f"batch-{batch_id}")

    def add(self, events: DataFrame, commit: str) -> None:
        """Add the bitmaps of a batch; a repeated commit changes nothing."""
        self.table.append(stage_bitmaps(events), commit)
        count: dict[int, int] = {}
        for b, *_ in self.table.manifest().entries:
            count[b] = count.get(b, 0) + 1
        many = [b for b, n in count.items() if n > self.folders]
        if many:
            united = self.table.read(buckets=many).groupBy("day", "stage_name", "ids").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            self.table.replace(united, many, f"unite-{commit}")

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """The bitmaps of all days (events without a time included), or of the days from ``since`` to ``until``."""
        rows = self.table.read()
        if since is not None:
            rows = rows.where(F.col("day") >= F.lit(since).cast("date"))
        return rows if until is None else rows.where(F.col("day") <= F.lit(until).cast("date"))
