"""Registered streaming queries (T1-T3): stream equals batch on the driver tables.

Each query lands the raw events derived from the driver tables as files
(the first load in time-ordered parts, then the re-delivery load) under the
shared checkpoint folder, runs the stream with an available-now trigger,
and returns the sink as a batch DataFrame. The oracle is the batch model.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from talentlake.config import DRIVER_TABLE_STAGES
from talentlake.oracle import with_base
from talentlake.plans.catalog import K6_SQL, K7_SQL, _cte_select, register, warehouse
from talentlake.session import ensure_session_defaults, stored
from talentlake.sources.driver_tables import FIRST_LOAD, REDELIVERY_LOAD, event_records
from talentlake.sources.raw import normalise_raw
from talentlake.streaming import events as st

def land_events(spark: SparkSession, sf_dir: str) -> str:
    """Write the raw event loads as files in arrival order; returns the folder."""
    ensure_session_defaults(spark)
    path = st.scratch_path(spark, "landed-events")
    first = normalise_raw(event_records(spark, sf_dir), "application_events", *FIRST_LOAD)
    again = normalise_raw(event_records(spark, sf_dir, redelivered=True), "application_events", *REDELIVERY_LOAD)
    first.repartitionByRange("last_activity_at").write.mode("append").parquet(path)
    again.write.mode("append").parquet(path)
    return path


def files_a_batch(spark: SparkSession) -> int:
    """Files of one micro-batch: a few batches for what one shuffle's tasks land."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)


def land_few(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A last delivery: the events of one application once more."""
    again = normalise_raw(event_records(spark, sf_dir, redelivered=True), "application_events", *REDELIVERY_LOAD)
    one = again.agg(F.min("application_id")).first()[0]
    again.where(F.col("application_id") == one).write.mode("append").parquet(path)


@register("stream_events_dedup", with_base("SELECT * FROM stg_events"))
def q_stream_events_dedup(spark, sf_dir):
    """All columns of the staged events after both loads; the second, later load replaces rows of the first
    however old they are, and is delivered twice."""
    src = land_events(spark, sf_dir)
    sink = st.LatestEvents(spark, st.scratch_path(spark, "t1-events"), buckets=16)
    stream = st.read_event_stream(spark, src, max_files_per_trigger=files_a_batch(spark))
    checkpoint = st.scratch_path(spark, "t1-ckpt")
    st.run_available_now(stream, checkpoint, foreach_batch=sink)
    land_few(spark, sf_dir, src)
    st.run_available_now(stream, checkpoint, foreach_batch=sink)
    return sink.read()


@register("stream_funnel", with_base(K6_SQL))
def q_stream_funnel(spark, sf_dir):
    src = land_events(spark, sf_dir)
    sink = st.scratch_path(spark, "t2-sink")
    stream = st.funnel_stream(st.read_event_stream(spark, src, max_files_per_trigger=files_a_batch(spark)), DRIVER_TABLE_STAGES)
    st.run_available_now(stream, st.scratch_path(spark, "t2-ckpt"), output_mode="complete",
                         foreach_batch=st.version_each_batch(sink))
    return st.latest_version(spark, sink)


def _stored_bitmaps(spark, sf_dir):
    """Bitmaps of all events, added batch by batch as a stream delivers them; the last delivery repeats events."""
    from talentlake.operators.funnel_bitmaps import FunnelBitmaps

    src = land_events(spark, sf_dir)
    sink = FunnelBitmaps(spark, st.scratch_path(spark, "funnel-bitmaps"), folders=2)
    stream = st.read_event_stream(spark, src, max_files_per_trigger=files_a_batch(spark))
    st.run_available_now(stream, st.scratch_path(spark, "bitmaps-ckpt"), foreach_batch=sink)
    return sink


@register("funnel_bitmaps", with_base(K6_SQL))
def q_funnel_bitmaps(spark, sf_dir):
    from talentlake.operators import funnel_bitmaps

    return funnel_bitmaps.funnel(_stored_bitmaps(spark, sf_dir).read(), DRIVER_TABLE_STAGES)


@register("funnel_by_scope_bitmaps", _cte_select(K7_SQL))
def q_funnel_by_scope_bitmaps(spark, sf_dir):
    from talentlake.operators import funnel_bitmaps

    w = warehouse(spark, sf_dir)
    scopes = funnel_bitmaps.scope_bitmaps(w.fact_application, w.dim_job)
    return funnel_bitmaps.funnel_by_scope(_stored_bitmaps(spark, sf_dir).read(), scopes, DRIVER_TABLE_STAGES)


@register("stream_transitions", with_base("SELECT * FROM fact_stage_transition"))
def q_stream_transitions(spark, sf_dir):
    src = land_events(spark, sf_dir)
    w = warehouse(spark, sf_dir)
    facts = stored(w.fact_application, "fact_application")  # read by every batch
    updater = st.TransitionsUpdater(
        spark, st.scratch_path(spark, "t3-events"), st.scratch_path(spark, "t3-transitions"),
        lambda: facts, DRIVER_TABLE_STAGES, buckets=16, id_hash="md5", folders=4,
    )
    stream = st.read_event_stream(spark, src, max_files_per_trigger=files_a_batch(spark))
    checkpoint = st.scratch_path(spark, "t3-ckpt")
    st.run_available_now(stream, checkpoint, foreach_batch=updater)
    land_few(spark, sf_dir, src)  # a batch that touches one application must leave the others alone
    st.run_available_now(stream, checkpoint, foreach_batch=updater)
    return updater.read()


@register("read_events_json", with_base("SELECT * FROM stg_events"))
def q_read_events_json(spark, sf_dir):
    """Events landed as JSON (lines, splittable) read with an all-string schema, then staged."""
    from talentlake.operators.staging import stg_events
    from talentlake.sources.raw import read_event_json
    from talentlake.sources.driver_tables import raw_table

    path = st.scratch_path(spark, "events-json")
    raw = raw_table(spark, sf_dir, "application_events")
    raw.write.mode("overwrite").json(path)
    landed = read_event_json(spark, path, multiline=False, with_metadata=True)
    return stg_events(landed)
