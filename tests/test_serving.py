"""Orders, pages, display texts, JSON merges, event ids, record-form plans and command errors on small frames."""

import json

from pyspark.sql import functions as F

from talentlake.config import MODE_FOCUSED, MODE_GLOBAL
from talentlake.functions import scalar
from talentlake.operators import quality, serve
from talentlake.plans import changes

APPS = "application_id long, job_id long, status string, current_stage string, recruiter string, office string, department string"


def test_ordered_and_positioned(spark):
    rows = [("r1", 0.5, 2.0), ("r2", None, 1.0), ("r3", 0.5, 9.0), ("r4", 0.1, None), ("r0", 0.5, 2.0)]
    df = spark.createDataFrame(rows, "recruiter_name string, sla_compliance_rate double, avg_duration_days double")
    names = [r.recruiter_name for r in serve.ordered(df, "performance").collect()]
    assert names == ["r2", "r4", "r3", "r0", "r1"]
    placed = serve.positioned(df.withColumn("g", F.lit(1)), "performance", ["g"]).orderBy("position").collect()
    assert [(r.position, r.recruiter_name) for r in placed] == list(enumerate(names, 1))


def test_pages(spark):
    df = spark.range(25).withColumnRenamed("id", "k").repartition(5)
    page, total = serve.page(df, "k", 10, 20)
    assert [r.k for r in page.collect()] == [20, 21, 22, 23, 24] and total.first()["count"] == 25
    seen, after = [], None
    while got := [r.k for r in serve.page_after(df, "k", 10, after).collect()]:
        seen, after = seen + got, got[-1]
    assert seen == list(range(25))


def test_options_are_sorted(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "office string")
    assert [r.office for r in serve.options(df, "office").collect()] == ["a", "b"]


def test_display_texts(spark):
    df = spark.createDataFrame([(1234567, 0.125, 3.04), (None, None, None)], "n long, share double, days double")
    rows = df.select(scalar.format_count("n"), scalar.format_percentage("share"), scalar.format_days("days"),
                     scalar.format_decimal("days", 2)).collect()
    assert [tuple(r) for r in rows] == [("1 234 567", "12.5%", "3.0 days", "3.04"), ("0", "N/A", "N/A", "0")]


def test_blank_name_is_dropped_not_replaced(spark):
    cols = ("application_id", "candidate_id", "candidate_full_name", "candidate_name", "job_id", "job_title", "status",
            "current_stage", "office_name", "office", "department_name", "department", "recruiter_name", "recruiter",
            "updated_at", "created_at", "applied_at")
    values = {"candidate_id": "7", "candidate_full_name": "  ", "candidate_name": "Ann", "job_id": "3", "job_title": ""}
    df = spark.createDataFrame([tuple(values.get(c) for c in cols)], ", ".join(f"{c} string" for c in cols))
    row = serve.display_rows(df).first()
    assert row.candidate_display is None and row.job_display == "Job 3"


def test_merge_json(spark):
    df = spark.createDataFrame(
        [('{"b":1,"a":"x"}', '{"a":null,"c":[1,{"d":2}]}'), (None, '{"n":2}'), ("[1]", None), ("no json", "{}")],
        "base string, added string")
    merged = [json.loads(r[0]) for r in df.select(scalar.merge_json("base", "added")).collect()]
    assert merged == [{"a": None, "b": 1, "c": [1, {"d": 2}]}, {"n": 2}, {}, {}]
    assert [r[0] for r in df.select(scalar.json_field("base", "b")).collect()] == ["1", None, None, None]


def test_event_id(spark):
    df = spark.createDataFrame([("1", "hire", "t"), ("2", None, "u")], "a string, b string, c string")
    assert [r[0] for r in df.select(scalar.event_id("a", "b", "c")).collect()] == ["1_hire_t", "2_None_u"]


def test_required_columns(spark):
    assert quality.required_columns(spark.range(1), ["id", "x"]) == ["x"]


def test_record_form_plan(spark):
    rows = [
        (1, 10, " Active ", "Offer", None, "o", "d"), (2, 10, "active", "offer ", "r", "o", "d"),
        (3, 10, "active", None, "", "o", "d"), (4, 99, "active", "Offer", "r", "o", "d"),
        (5, 10, "hired", "Offer", "r", "o", "d"), (6, None, "active", "Offer", "r", "o", "d"),
        (7, 10, "active", "Reference Check", "r", "o", "d"), (8, 10, "active", "Final Interview", "r", "o", "d"),
        (7, 10, "active", "Reference Check", "r", "o", "d"), (9, 10, None, "Offer", "r", "o", "d"),
    ]
    apps, jobs = spark.createDataFrame(rows, APPS), spark.createDataFrame([(10,)], "job_id long")
    plan = changes.plan_record_form(apps, jobs, ["Offer"], 1, MODE_FOCUSED)
    request = plan.request.first()
    assert (request.eligible_count, request.recruiter, request.selected_group_count) == (3, "r", 2)
    assert [r.application_id for r in plan.items.collect()] == [7]
    plan = changes.plan_record_form(apps, jobs, ["Final Interview"], 10, MODE_GLOBAL)
    assert sorted(r.application_id for r in plan.items.collect()) == [1, 2, 3, 7]
    assert plan.request.first().selected_group_count is None
    plan = changes.plan_record_form(apps.limit(0), jobs, ["Offer"], 10, MODE_FOCUSED)
    request = plan.request.first()
    assert (request.eligible_count, request.selected_group_count, request.office) == (0, 0, None)
    assert plan.items.count() == 0


def test_command_errors_and_ties(spark):
    event = ("application_id string, current_stage string, current_status string, last_activity_at string, "
             "_ingested_at string, _ingestion_batch_id string")
    events = spark.createDataFrame([("1", "Offer", "active", "t1", "2", "b"), ("1", "Final Interview", "active", "t1", "1", "a")], event)
    apps = spark.createDataFrame([("1", "x", "y"), ("2", "Reference Check", "active")],
                                 "ghap_application_id string, ghap_application_current_stage string, ghap_status string")
    commands = spark.createDataFrame(
        [(1, "stage_change", "", "active", None, "2026-01-01"), (1, "reject", None, None, "no", "2026-01-02"),
         (2, "stage_change", "Offer", "active", None, "2026-01-01"), (2, "hire", None, None, None, "2026-01-02"),
         (3, "hire", None, None, None, "2026-01-01")],
        "application_id long, command string, new_stage string, current_status string, reason string, at string",
    ).selectExpr("* except (at)", "cast(at as timestamp) issued_at")
    out = {(r.application_id, r.command): r for r in changes.events_from_commands(commands, events, apps, 5).collect()}
    assert out[1, "stage_change"].error_message == changes.MSG_NO_TARGET_STAGE and out[1, "stage_change"].action is None
    reject = out[1, "reject"]
    assert (reject.previous_stage, reject.previous_status, reject.current_status) == ("Offer", "active", "rejected")
    hire = out[2, "hire"]
    assert (hire.previous_stage, hire.current_stage, hire.current_status, hire.error_message) == ("Offer", "Offer", "hired", None)
    assert out[3, "hire"].error_message == changes.MSG_UNKNOWN_APPLICATION
