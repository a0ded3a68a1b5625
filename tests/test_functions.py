"""Scalar rules: casts (N1), whole-unit differences (N4/N5), ratios (N7), rounding (N17), ids (N15, UUIDv5)."""

import uuid

from pyspark.sql import functions as F

from talentlake.functions import scalar as S
from talentlake.plans import changes


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).collect()[0]["v"]


def test_safe_casts_turn_bad_text_into_null(spark):
    df = spark.createDataFrame([("12.5x",), ("(null)",), ("123.0",), ("10000-1",), ("42",)], "t string")
    got = [r.v for r in df.select(S.safe_long(S.null_marker("t")).alias("v")).collect()]
    assert got == [None, None, None, None, 42]
    assert one(spark, S.safe_double(F.lit("12.5x"))) is None
    assert one(spark, S.safe_timestamp(F.lit("not a time"))) is None


def test_whole_hours_and_days_truncate(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:00:00", "2024-01-04 00:00:00"), ("2024-01-01 00:00:00", "2024-01-04 00:59:00"),
         ("2024-01-01 00:00:00", "2024-01-01 23:59:00"), ("2024-01-02 00:00:00", "2024-01-01 00:30:00")],
        "a string, b string",
    ).select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    rows = df.select(S.whole_units_between("HOUR", "a", "b").alias("h"), S.whole_units_between("DAY", "a", "b").alias("d")).collect()
    assert [(r.h, r.d) for r in rows] == [(72, 3), (72, 3), (23, 0), (-23, 0)]


def test_ratios(spark):
    assert one(spark, S.safe_divide(F.lit(1), F.lit(0))) is None
    assert one(spark, S.safe_rate(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, S.safe_divide(F.lit(1), F.lit(4))) == 0.25


def test_half_even_rounding(spark):
    assert one(spark, F.bround(F.lit(0.125), 2)) == 0.12
    assert one(spark, F.bround(F.lit(12.25), 1)) == 12.2


def test_uuid5_matches_python(spark):
    names = ["abc", "mock_greenhouse_seed:1:None:Offer:2024-01-01 00:00:00", "é"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.u for r in df.select(S.uuid5("n").alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_surrogate_key_is_deterministic(spark):
    a = one(spark, S.surrogate_key(F.lit(1), F.lit("Offer"), F.lit(None)))
    b = one(spark, S.surrogate_key(F.lit(1), F.lit("Offer"), F.lit(None)))
    assert a == b and isinstance(a, int)


def test_stage_rank_and_sequence_validation(spark):
    assert one(spark, changes.stage_rank_column(F.lit("Offer"))) == 12
    assert one(spark, changes.stage_rank_column(F.lit("Foo"))) is None
    seqs = [(["Offer", "Reference Check"],), (["Hired"],), ([],), (["Foo"],), (["Offer", "Offer"],)]
    df = spark.createDataFrame(seqs, "s array<string>")
    got = [r.e for r in df.select(changes.sequence_error("s").alias("e")).collect()]
    assert got == [
        "Invalid backward recruitment stage transition: Reference Check",
        "Hired and Rejected outcomes are excluded from this stage workflow",
        "At least one recruitment stage is required",
        "Invalid recruitment stage: Foo",
        None,
    ]
    for s, e in zip([x[0] for x in seqs], got):
        assert changes.validate_sequence(s) == e


def test_limit_clamps():
    assert S.clamp(None, 100, 10, 500) == 100
    assert S.clamp(5, 100, 10, 500) == 10
    assert S.clamp(1000, 100, 10, 500) == 500
    assert S.clamp(0, 100, 1, 500) == 1


def test_clean_stage_list_keeps_first_occurrence_order(spark):
    df = spark.createDataFrame([([" Offer", "Reference Check", "", "Offer ", None, "Final Interview"],)], "s array<string>")
    got = df.select(S.clean_stage_list("s").alias("v")).collect()[0].v
    assert got == ["Offer", "Reference Check", "Final Interview"]
