"""Whole batches, retries, compaction, late deliveries."""

import tempfile

import pytest
from pyspark.sql import functions as F

from talentlake.config import DEFAULT_STAGES
from talentlake.operators import staging
from talentlake.sources.raw import METADATA_COLUMNS, RAW_COLUMNS
from talentlake.streaming import events as st


def _raw(spark, rows):
    cols = [*RAW_COLUMNS["application_events"], *METADATA_COLUMNS]
    given = ["application_id", "action", "previous_stage", "current_stage", "last_activity_at", "_ingested_at"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in given))
    return df.selectExpr(*[c if c in given else f"cast(null as string) {c}" for c in cols])


FACTS = "application_id long, candidate_id long, job_id long, recruiter_id long, department_id long, office_id long"


def _updater(spark, root, **how):
    facts = spark.createDataFrame([], FACTS)
    return st.TransitionsUpdater(spark, f"{root}/events", f"{root}/transitions", lambda: facts, DEFAULT_STAGES, buckets=16, **how)


def test_transitions_of_untouched_applications_stay(spark, tmp_path):
    updater = _updater(spark, tmp_path)
    move = "candidate_stage_change"
    first = [(str(i), move, None, "Application Review", "2025-01-01 00:00:00", "2025-02-01 00:00:00") for i in range(200)]
    first += [(str(i), move, "Application Review", "Recruiter Interview", "2025-01-02 00:00:00", "2025-02-01 00:00:00") for i in range(200)]
    updater(_raw(spark, first), 0)
    assert updater.read().count() == 200
    before = {b: f for b, f, _ in updater.transitions.manifest().entries}
    last = _raw(spark, [("7", move, "Recruiter Interview", "Offer", "2025-01-05 00:00:00", "2025-02-02 00:00:00")])
    for _ in range(2):  # the batch and its retry
        updater(last, 1)
        assert updater.read().count() == 201
        assert updater.events.read().count() == 401
    after = {b: f for b, f, _ in updater.transitions.manifest().entries}
    assert sum(before[b] != after[b] for b in before) == 1  # one bucket's files are new


def test_killed_batch_is_repeated(spark, tmp_path, monkeypatch):
    """A batch that dies between its two commits shows readers the state before, and its retry completes it once."""
    updater = _updater(spark, tmp_path, folders=2)
    move, day = "candidate_stage_change", "2025-01-0{} 00:00:00"
    batch = lambda k, stage, after: _raw(spark, [(str(i), move, stage, after, day.format(k), day.format(k)) for i in range(20)])
    updater(batch(1, None, "Application Review"), 0)
    updater(batch(2, "Application Review", "Recruiter Interview"), 1)
    assert updater.read().count() == 20
    replace = type(updater.transitions).replace

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(type(updater.transitions), "replace", killed)
    with pytest.raises(RuntimeError):
        updater(batch(3, "Recruiter Interview", "Offer"), 2)
    monkeypatch.setattr(type(updater.transitions), "replace", replace)
    assert updater.read().count() == 20
    updater(batch(3, "Recruiter Interview", "Offer"), 2)
    assert updater.read().count() == 40 and updater.events.read().count() == 60
    updater(batch(4, "Offer", "Hired"), 3)  # compaction has joined the log's folders
    assert updater.read().count() == 60 and len({f for _, f, _ in updater.events.manifest().entries}) <= 2


def test_latest_delivery_replaces_earlier_ones(spark, tmp_path):
    """Whatever order deliveries come in, the table equals the batch model of all of them."""
    move, sink = "candidate_stage_change", st.LatestEvents(spark, f"{tmp_path}/t1", buckets=4)
    loads = [
        [("1", move, None, "Offer", "2025-01-01 00:00:00", "2025-03-02 00:00:00"), ("2", move, None, "Offer", "2025-06-01 00:00:00", "2025-06-02 00:00:00")],
        [("1", move, None, "Offer", "2025-01-01 00:00:00", "2025-03-01 00:00:00"), ("2", move, None, "Offer", "2025-06-01 00:00:00", "2025-06-03 00:00:00")],
        [("3", move, None, "Offer", "2024-01-01 00:00:00", "2025-06-04 00:00:00"), (None, move, None, None, None, "2025-06-04 00:00:00")],
    ]
    batches = [_raw(spark, rows).withColumn("_ingestion_batch_id", F.lit(str(k))) for k, rows in enumerate(loads)]
    for k in (0, 1, 1, 2):
        sink(batches[k], k)
    everything = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = staging.stg_events(everything)
    assert sink.read().exceptAll(want).isEmpty() and want.count() == sink.read().count() == 4
    assert {r.application_id: r._ingestion_batch_id for r in sink.read().collect()} == {1: "0", 2: "1", 3: "2", None: "2"}


def test_watermark_evicts_and_drops_late_events(spark):
    """Copies within the watermark are dropped, events older than it are late, other events stay."""
    root = tempfile.mkdtemp(prefix="tl-t1-")
    move = "candidate_stage_change"
    batches = [
        [("1", move, None, "Offer", "2025-01-01 00:00:00", "a"), ("1", move, None, "Offer", "2025-01-01 00:00:00", "b")],
        [("1", move, None, "Offer", "2025-01-01 00:00:00", "c"), ("2", move, None, "Offer", "2025-01-10 00:00:00", "c")],
        [("1", move, None, "Offer", "2025-01-01 00:00:00", "d"), ("3", move, None, "Offer", "2025-01-02 00:00:00", "d"),
         ("4", move, None, "Offer", "2025-01-09 00:00:00", "d")],
    ]
    for rows in batches:  # one run a batch, so the watermark moves in between
        _raw(spark, rows).write.mode("append").parquet(f"{root}/in")
        stream = st.dedup_stream(st.read_event_stream(spark, f"{root}/in"), "2 days")
        st.run_available_now(stream, f"{root}/ckpt", f"{root}/out")
    kept = sorted(r.application_id for r in spark.read.parquet(f"{root}/out").collect())
    assert kept == [1, 2, 4]  # 3 came more than two days behind the newest event
