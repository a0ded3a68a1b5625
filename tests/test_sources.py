"""Raw-layer readers and writers (S1-S14) on small landed files."""

import json
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.sources import raw


def _tmp():
    return tempfile.mkdtemp(prefix="tl-src-")


def test_event_json_array_with_double_underscore_stage(spark):
    path = os.path.join(_tmp(), "events.json")
    events = [
        {"organization_id": 7000001, "action": "candidate_stage_change", "application_id": 555000111222,
         "previous_status": None, "current_status": "active", "last_activity_at": "2025-06-02T08:00:00Z",
         "previous_stage": None, "current__stage": "Application Review"},
        {"organization_id": 7000001, "action": "hire_candidate", "application_id": 555000111222,
         "previous_status": "active", "current_status": "hired", "last_activity_at": "2025-06-05T16:30:00Z",
         "previous_stage": "Offer", "current__stage": "Offer"},
    ]
    with open(path, "w") as f:
        json.dump(events, f, indent=2)
    df = raw.read_event_json(spark, path, multiline=True)
    rows = df.orderBy("last_activity_at").collect()
    assert [r.current_stage for r in rows] == ["Application Review", "Offer"]
    assert rows[0].application_id == "555000111222"  # ids stay exact text (no float detour)
    normal = raw.normalise_raw(df, "application_events", "b", "2026-01-01 00:00:00")
    assert set(raw.METADATA_COLUMNS) <= set(normal.columns)


def test_normaliser_marks_nulls_and_serialises_nested(spark):
    df = spark.createDataFrame([("(null)", {"a": "1"}, 5)], "x string, m map<string,string>, n int")
    r = raw.normalise_raw(df, "t", "b", "2026-01-01 00:00:00").collect()[0]
    assert r.x is None and r.m == '{"a":"1"}' and r.n == "5"


def test_paged_extract_and_completeness(spark):
    d = _tmp()
    for i, chunk in enumerate([[{"id": "1"}, {"id": "2"}], [{"id": "3"}]]):
        with open(os.path.join(d, f"page{i}.json"), "w") as f:
            f.write(json.dumps({"data": chunk, "count": 3}) + "\n")
    item = T.StructType([T.StructField("id", T.StringType())])
    assert sorted(r.id for r in raw.read_paged(spark, d, item).collect()) == ["1", "2", "3"]
    assert raw.paged_total_check(spark, d).collect()[0].complete is True


def test_overwrite_counts_rows_once(spark):
    path = os.path.join(_tmp(), "t")
    assert raw.overwrite_table(spark.range(7).toDF("id"), path) == 7
    assert raw.overwrite_table(spark.range(3).toDF("id"), path) == 3
    assert spark.read.parquet(path).count() == 3


def test_upsert_full_and_column_subset(spark):
    existing = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, name string, status string")
    incoming = spark.createDataFrame([(2, "B", None, 1), (2, "BB", "z", 2), (3, "c", "w", 1)],
                                     "k long, name string, status string, seq int")
    full = raw.upsert(existing, incoming.filter("name != 'B'").drop("seq"), ["k"])
    got = {r.k: (r.name, r.status) for r in full.collect()}
    assert got == {1: ("a", "x"), 2: ("BB", "z"), 3: ("c", "w")}
    # display columns only; the latest incoming row per key wins; a provided NULL overwrites
    subset = raw.upsert(existing, incoming.filter("seq = 1").drop("seq"), ["k"], columns=["name"])
    got = {r.k: (r.name, r.status) for r in subset.collect()}
    assert got == {1: ("a", "x"), 2: ("B", "y"), 3: ("c", None)}
    ordered = raw.upsert(existing, incoming, ["k"], columns=["name", "status"], incoming_order=[F.col("seq")])
    assert {r.k: r.status for r in ordered.collect()}[2] == "z"


def test_request_report_nests_items(spark):
    req = spark.createDataFrame([("r1", "applied")], "request_id string, status string")
    items = spark.createDataFrame([("r1", 2, "applied"), ("r1", 1, "skipped")],
                                  "request_id string, application_id long, apply_status string")
    rep = raw.request_report(req, items).collect()[0]
    assert [i.application_id for i in rep["items"]] == [1, 2]
    out = os.path.join(_tmp(), "report")
    raw.request_report(req, items).write.json(out)
    assert spark.read.json(out).count() == 1
