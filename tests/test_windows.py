"""The skew-tolerant helpers equal the plain windows they replace."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentlake.functions import windows
from talentlake.functions.windows import first_rows, hot_keys, lag_by_key, latest_per_key


def _events(spark, n=600, seed=7):
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = rnd.choice([None, 1, 1, 1, 1, 2, 3, 4])  # one hot key, a NULL key group
        ts = None if rnd.random() < 0.03 else base + timedelta(hours=rnd.randint(0, 24 * 20), minutes=rnd.choice([0, 0, 30]))
        rows.append((key, ts, rnd.randint(0, 3), i, f"v{i}"))
    return spark.createDataFrame(rows, "k long, ts timestamp, tb int, id int, v string")


def _hot(df, tiebreak, **how):
    return hot_keys(df, "k", "ts", tiebreak, **{"small_bytes": 0, **how})


def test_lag_by_key_equals_window_lag(spark):
    df = _events(spark)
    tiebreak = [F.col("tb"), F.col("id")]
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_first(), F.col("tb").asc_nulls_first(), F.col("id").asc_nulls_first())
    expected = {r.id: (r.lag_v, r.lag_ts) for r in df.select("id", F.lag("v").over(w).alias("lag_v"), F.lag("ts").over(w).alias("lag_ts")).collect()}
    for least in (1, 70, 10**9):  # every key split, the largest only, none
        hot = _hot(df, tiebreak, min_rows=least)
        assert (hot.table is None) == (least == 10**9)
        got = lag_by_key(df, "k", "ts", tiebreak, ["v", "ts"], hot=hot)
        assert got.columns == [*df.columns, "lag_v", "lag_ts"]
        assert {r.id: (r.lag_v, r.lag_ts) for r in got.collect()} == expected, least


def test_latest_per_key_equals_row_number(spark):
    df = _events(spark).withColumn("g", F.col("id") % 13)
    w = Window.partitionBy("g", "k").orderBy(F.col("ts").desc_nulls_last(), F.col("id").desc())
    expected = sorted(r.id for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect())
    got = sorted(r.id for r in latest_per_key(df, ["g", "k"], [F.col("ts"), F.col("id")]).collect())
    assert got == expected


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lag_reads_and_shuffles_once(spark, tmp_path):
    """Without hot keys: one scan, one exchange, one window."""
    _events(spark).write.parquet(f"{tmp_path}/e")
    plan = _plan(lag_by_key(spark.read.parquet(f"{tmp_path}/e"), "k", "ts", [F.col("id")], ["v"]))
    assert plan.count("FileScan") == plan.count("Exchange") == 1 and "SinglePartition" not in plan


def test_hot_key_of_one_day_is_spread(spark):
    """One key holds 90% of the rows, all on one day and many at one instant: its largest part stays small."""
    rows = spark.range(60_000).selectExpr(
        "if(id % 10 = 0, id, 1) k", "timestamp_micros(1704067200000000 + if(id % 3 = 0, 0, id * 400000)) ts", "cast(id as int) id", "cast(id as string) v")
    hot = _hot(rows, [F.col("id")], min_rows=20_000)
    assert [len(r._cuts) > 500 for r in hot.table.collect()] == [True]
    out = lag_by_key(rows, "k", "ts", [F.col("id")], ["id"], hot=hot)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = rows.withColumn("lag_id", F.lag("id").over(w))
    assert out.exceptAll(want).isEmpty() and out.count() == 60_000
    own = F.struct(F.unix_micros("ts").alias("t"), F.col("id").alias("b0"))
    parts = rows.where("k = 1").join(hot.table, F.xxhash64("k") == F.col("_h")).groupBy(windows._cuts_up_to("_cuts", own)).count()
    assert parts.agg(F.max("count")).first()[0] < 0.01 * 54_000
    plan = _plan(out)
    assert all("_range" in line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line)


def test_first_rows(spark):
    """A large limit is cut from a sorted table and gives the same rows as a top-k; no limit gives all."""
    df = spark.range(50_000).selectExpr("id", "id % 7 g").repartition(6)
    order = [F.col("g").desc(), F.col("id")]
    want = {r.id for r in df.orderBy(*order).limit(30_000).collect()}
    got = first_rows(df, order, 30_000)
    assert "TakeOrdered" not in _plan(got) and {r.id for r in got.collect()} == want
    assert first_rows(df, order, 10).count() == 10 and first_rows(df, order, None).count() == first_rows(df, order, 60_000).count() == 50_000
    assert first_rows(df, order, 0).count() == 0


def test_text_key(spark):
    """A key that is no number keeps its own values; '' and NULL are different keys."""
    rows = [(k, datetime(2024, 1, day), day) for k in ("a1", "", None) for day in (1, 2, 5)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int")
    out = lag_by_key(df, "k", "ts", [F.col("id")], ["id"]).collect()
    assert {(r.k, r.id, r.lag_id) for r in out} == {(k, d, p) for k in ("a1", "", None) for d, p in ((1, None), (2, 1), (5, 2))}
