"""Skew-tolerant replacements for per-key windows.

A plain ``lag() over (partition by application_id ...)`` or
``row_number() over (partition by <dedup key> ...)`` puts every row of one key
into one task. At scale one application (or one group of exact copies) may
hold a large share of all rows, so both are expressed here in a form whose
largest task is bounded:

* ``latest_per_key`` is a grouped ``max_by``: partial aggregation collapses
  copies on the map side, so only one row per key and map task is shuffled.
* ``lag_by_key`` windows over the key, with one exchange.  Keys that a sketch
  of the rows shows to hold a large share are cut into ranges of their own
  order, so a hot key is spread over as many tasks as it has ranges, even
  where all its rows are of one day; one boundary row per range is carried on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.session import freeze

# Rows that a top-k may hold in each task's buffer; more are taken from a sorted table.
TOP_K = 10_000


def first_rows(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows of ``df`` by ``order`` (a complete order); all of them, unsorted, where ``n`` is None.

    A top-k keeps ``n`` rows in every task and all its candidates in one, so it
    serves small limits only.  Above ``TOP_K`` the rows are sorted by range into
    a written table; counts per sorted part (as many rows as parts) tell which
    parts are kept whole and how much of the part that crosses the limit.
    """
    if n is None:
        return df
    if n <= TOP_K:
        return df.orderBy(*order).limit(n)
    # partition number in the upper bits, place in the partition in the lower 33
    placed = freeze(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(2**33 - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")).where(F.col("_before") < n)
    kept = placed.withColumn("_part", part).join(F.broadcast(cuts), "_part").where(F.col("_before") + place < n)
    return kept.select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per ``keys`` (NULLs form one group): the row with the largest ``order``.

    ``order`` is compared as a struct with NULL smallest, i.e. the SQL
    ``row_number() over (partition by keys order by o1 desc nulls last, ...) = 1``.
    Columns keep their names and positions.
    """
    payload = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_latest"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_latest.{c}").alias(c) for c in df.columns])


# -- lag ------------------------------------------------------------------------------------

SKETCH_ROWS = 16_384  # rows of the sketch, and so a bound on what reaches the driver
HOT_SHARE = 1 / 1024  # a key with this share of the rows is split, into parts of about this share
HOT_ROWS = 1_000_000  # a key with fewer rows is never split
SMALL_BYTES = 64 << 20  # an input that Spark estimates below this is not sketched


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the keys that hold many rows, each with the orders at which its rows are cut into parts.

    ``table``: ``_h long, _cuts array<struct>``, at most ``1 / HOT_SHARE`` rows
    and twice as many cuts in all, or None where no key is hot.
    """

    table: DataFrame | None = None


def _order_struct(time_col: str, tiebreak: Sequence[Column]) -> Column:
    return F.struct(F.unix_micros(F.col(time_col)).alias("t"), *[c.alias(f"b{i}") for i, c in enumerate(tiebreak)])


def _cuts_up_to(cuts: str, own: Column) -> Column:
    """How many of the ascending cuts (at most 4095) are not above ``own``, by halving; 0 where there are none (NULL)."""
    def step(at: Column, width: Column) -> Column:
        return F.when(F.get(cuts, at + width - 1) <= own, at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(2**i) for i in range(11, -1, -1)]), F.lit(0), step)


def hot_keys(df: DataFrame, key: str, time_col: str, tiebreak: Sequence[Column], min_rows: int = HOT_ROWS,
             small_bytes: int = SMALL_BYTES) -> HotKeys:
    """Quantile sketch of (key, order): the ``SKETCH_ROWS`` rows with the smallest hashes.

    These are a uniform sample whose largest hash also estimates the number of
    rows.  Keys with a share of ``HOT_SHARE`` of it and an estimated ``min_rows``
    rows are hot; their cuts are quantiles of their sampled orders.  The sketch
    only balances the work: results are the same whatever it holds, so ``df`` may
    also be a cheaper frame than the one that is lagged.
    """
    spark = df.sparkSession
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < small_bytes:
        return HotKeys()
    rows = df.select(F.xxhash64(key).alias("_h"), _order_struct(time_col, tiebreak).alias("_o"))
    rows = rows.withColumn("_r", F.xxhash64("_h", "_o"))
    sketch = rows.orderBy("_r", "_h", "_o").limit(SKETCH_ROWS).collect()
    if not sketch:
        return HotKeys()
    seen = (sketch[-1]["_r"] + 2**63 + 1) / 2**64  # share of the hash range that the sketch covers
    total = len(sketch) if len(sketch) < SKETCH_ROWS else len(sketch) / seen
    by_key: dict[int, list] = {}
    for r in sketch:
        by_key.setdefault(r["_h"], []).append(r["_o"])
    hot = []
    for h, orders in by_key.items():
        share = len(orders) / len(sketch)
        if share < HOT_SHARE or share * total < min_rows:
            continue
        parts = min(len(orders), max(1, round(share / HOT_SHARE)))
        orders.sort(key=lambda o: tuple((v is not None, v) for v in o))  # NULL first, as in Spark
        hot.append((h, [orders[len(orders) * i // parts] for i in range(1, parts)]))
    if not any(cuts for _, cuts in hot):
        return HotKeys()
    kind = T.StructType([T.StructField("_h", T.LongType()), T.StructField("_cuts", T.ArrayType(rows.schema["_o"].dataType))])
    return HotKeys(spark.createDataFrame(hot, kind).withColumn("_cuts", F.sort_array("_cuts")))


def lag_by_key(
    df: DataFrame,
    key: str,
    time_col: str,
    tiebreak: Sequence[Column],
    values: Sequence[str],
    prefix: str = "lag_",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``prefix + v`` = value of ``v`` on the preceding row of the same ``key``.

    Rows of a key (NULL is a key) are ordered by ``time_col`` then ``tiebreak``
    (all ascending, NULL first).  One exchange by key.  A hot key's rows are cut
    into ranges of that order and dealt by (key, range); the first row of a range
    takes its values from a boundary row, the last one of the ranges before,
    which are as many as the hot keys' ranges.  ``hot`` defaults to a sketch of
    ``df``; callers with a cheaper frame of the same rows give its sketch.
    """
    if hot is None:
        hot = hot_keys(df, key, time_col, tiebreak)
    order = [F.col(time_col).asc_nulls_first(), *[t.asc_nulls_first() for t in tiebreak]]
    if hot.table is None:
        w = Window.partitionBy(key).orderBy(*order)
        return df.select("*", *[F.lag(v).over(w).alias(prefix + v) for v in values])

    cuts = F.broadcast(hot.table)  # bounded by the sketch
    own = _order_struct(time_col, tiebreak)
    ranged = df.withColumn("_h", F.xxhash64(key)).join(cuts, "_h", "left")
    ranged = ranged.withColumn("_range", _cuts_up_to("_cuts", own))

    w = Window.partitionBy(key, "_range").orderBy(*order)
    lagged = ranged.select(
        *df.columns, "_h", "_range", F.col("_cuts").isNotNull().alias("_hot"),
        (F.row_number().over(w) == 1).alias("_first"), *[F.lag(v).over(w).alias(f"_in_{v}") for v in values],
    )

    # the hot keys' rows only: one row per range, the value of which the next range begins with
    last = F.max_by(F.struct(*[F.col(v) for v in values]), own).alias("_last")
    ends = ranged.where(F.col("_cuts").isNotNull()).groupBy("_h", F.col(key).alias("_key"), "_range").agg(last)
    across = Window.partitionBy("_h", "_key").orderBy("_range")
    boundary = ends.select("_h", "_key", F.col("_range").alias("_at"), F.lag("_last").over(across).alias("_prev"))
    same = (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_range") == F.col("_at")) & F.col("_first") & F.col("_hot")
    joined = lagged.join(F.broadcast(boundary.withColumnRenamed("_h", "_bh")), (F.col("_h") == F.col("_bh")) & same, "left")
    return joined.select(
        *df.columns,
        *[F.when(F.col("_first"), F.col(f"_prev.{v}")).otherwise(F.col(f"_in_{v}")).alias(prefix + v) for v in values],
    )
