"""Incremental event ingestion with Structured Streaming.

* T1 ``LatestEvents``: a ``foreachBatch`` sink that keeps the batch model's
  staged events current in a bucketed table: per 7-column key the latest load,
  so a later delivery replaces the earlier one however late it comes.  A batch
  rewrites the buckets it touches.  ``dedup_stream`` is the bounded form: it
  keeps the *first* arrival and forgets keys behind the watermark.
* T2 ``funnel_stream``: distinct (application, stage) pairs, counted per
  stage; the state holds one entry per pair (bounded by applications x stages).
* T3 ``TransitionsUpdater``: a ``foreachBatch`` sink over two bucketed tables.
  A batch is appended to the event log under its id; the stage transitions of
  the touched buckets are rebuilt from all their events (so late and
  re-delivered events are handled) and replace these buckets in one commit.
  The log is compacted when a bucket has many folders.

Every write is a commit with the batch's id: a killed batch is repeated without
doubling rows, and readers see whole batches only.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.config import DEFAULT_STAGES, StageConfig
from talentlake.operators import core, marts, staging
from talentlake.sources.buckets import BucketedTable
from talentlake.sources.raw import RAW_COLUMNS, METADATA_COLUMNS, string_schema

RAW_EVENT_COLUMNS = tuple(RAW_COLUMNS["application_events"]) + METADATA_COLUMNS


def read_event_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw events landing as files (all-string schema)."""
    reader = spark.readStream.schema(string_schema(RAW_EVENT_COLUMNS)).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def dedup_stream(raw_stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """T1, bounded form: the first delivery of each event; later ones within ``watermark`` of event time are dropped."""
    typed = staging.stg_events_typed(raw_stream)
    return typed.withWatermark("event_at", watermark).dropDuplicatesWithinWatermark(list(staging.EVENT_DEDUP_KEY))


def funnel_stream(raw_stream: DataFrame, stages: StageConfig = DEFAULT_STAGES) -> DataFrame:
    """Applications reached per stage, maintained incrementally (complete / update output)."""
    typed = staging.stg_events_typed(raw_stream).filter(F.col("current_stage").isNotNull())
    pairs = typed.select("application_id", F.col("current_stage").alias("stage_name")).dropDuplicates(
        ["application_id", "stage_name"]
    )
    counted = pairs.groupBy("stage_name").agg(F.count(F.lit(1)).alias("applications_reached"))
    return counted.select(
        marts._stage_order("stage_name", stages).alias("stage_order"), "stage_name", "applications_reached"
    )


TYPED_APPLICATION = "try_cast(application_id as bigint)"  # decides the bucket in both T3 tables


class LatestEvents:
    """``foreachBatch`` handler keeping the staged events of everything delivered so far."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        schema = staging.stg_events_typed(spark.createDataFrame([], string_schema(RAW_EVENT_COLUMNS))).schema
        self.table = BucketedTable(spark, path, schema, staging.EVENT_DEDUP_KEY, buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        typed = staging.stg_events_typed(batch)
        self.table.merge_latest(typed, f"batch-{batch_id}", staging.EVENT_DEDUP_KEY, staging.event_load_order())

    def read(self) -> DataFrame:
        return self.table.read()


class TransitionsUpdater:
    """``foreachBatch`` handler keeping a stage-transition table current."""

    def __init__(self, spark: SparkSession, events_path: str, transitions_path: str, fact_application: Callable[[], DataFrame],
                 stages: StageConfig = DEFAULT_STAGES, buckets: int = 64, id_hash: str = "xxhash64", folders: int = 8):
        self.fact_application = fact_application
        self.stages = stages
        self.id_hash = id_hash
        self.folders = folders
        raw = spark.createDataFrame([], string_schema(RAW_EVENT_COLUMNS))
        self.events = BucketedTable(spark, events_path, raw.schema, [TYPED_APPLICATION], buckets)
        schema = self._transitions(raw).schema
        self.transitions = BucketedTable(spark, transitions_path, schema, [TYPED_APPLICATION], buckets)

    def _transitions(self, events: DataFrame) -> DataFrame:
        return core.fact_stage_transition(staging.stg_events(events), self.fact_application(), self.stages, id_hash=self.id_hash)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        commit = f"batch-{batch_id}"
        touched = self.events.append(batch.select(*RAW_EVENT_COLUMNS), commit)
        if touched:
            self.transitions.replace(self._transitions(self.events.read(buckets=touched)), touched, commit)
        folders = Counter(b for b, *_ in self.events.manifest().entries)
        if max(folders.values(), default=0) > self.folders:
            self.events.compact(f"compact-{batch_id}", self.folders // 2)

    def read(self) -> DataFrame:
        return self.transitions.read()


def run_available_now(stream: DataFrame, checkpoint: str, sink: str | None = None, fmt: str = "parquet",
                      output_mode: str = "append", foreach_batch=None, query_name: str | None = None) -> None:
    """Process everything available, then stop (a bounded, restartable run)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode).trigger(availableNow=True)
    if query_name:
        writer = writer.queryName(query_name)
    if foreach_batch is not None:
        writer = writer.foreachBatch(foreach_batch)
    else:
        writer = writer.format(fmt).option("path", sink)
    q = writer.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def version_each_batch(path: str):
    """``foreachBatch`` sink of a small result table (e.g. a complete aggregate).

    Each batch writes a version of its own and then its marker, so readers
    keep the last whole version while a batch runs or after it failed.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        batch.sparkSession.range(1).select(F.lit(batch_id).alias("version")).write.mode("append").json(f"{path}/_written")

    return write


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version that ``version_each_batch`` wrote."""
    version = spark.read.schema("version long").json(f"{path}/_written").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    from talentlake.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
