"""Counted overwrites, page ranges, ranged reports, catalog layers, the overview cube and the funnel bitmaps."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from talentlake.config import DEFAULT_STAGES
from talentlake.operators import funnel_bitmaps, marts
from talentlake.plans.catalog import warehouse
from talentlake.plans.catalog_tables import catalog_tables
from talentlake.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counted_overwrite_swaps(spark, tmp_path):
    table = tables.CountedTable(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.overwrite(spark.range(7).toDF("id")) == 7
    fails = spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        table.overwrite(fails)
    assert table.read().count() == 7  # a failed write leaves the old version
    assert table.overwrite(spark.range(3).toDF("other")) == 3 and table.read().columns == ["other"]
    assert table.overwrite(spark.range(0).toDF("id")) == 0 and table.read().count() == 0
    table.overwrite(spark.range(100).repartition(4).toDF("id"))
    table._files.delete(sorted(glob.glob(f"{tmp_path}/t/{table.manifest()['folder']}/part-*.parquet"))[0])
    with pytest.raises(tables.CountMismatch):
        table.read()


def _brute_ranges(pages):
    out = []
    for extract in {p[0] for p in pages}:
        own = [p for p in pages if p[0] == extract]
        total = max(p[3] for p in own)
        held = {}
        for _, offset, items, _ in own:
            for i in range(offset, offset + items):
                held[i] = held.get(i, 0) + 1
        top = max([total, *(i + 1 for i in held)])
        kinds = {
            "missing": [i for i in range(total) if i not in held], "overlap": [i for i in held if held[i] > 1], "surplus": range(max(total, 0), top),
        }
        for kind, at in kinds.items():
            run = []
            for i in sorted(at):
                if run and i != run[-1] + 1:
                    out.append((extract, kind, run[0], run[-1]))
                    run = []
                run.append(i)
            if run:
                out.append((extract, kind, run[0], run[-1]))
    return sorted(out)


def _joined(rows):
    """Overlaps that touch count as one range."""
    out = []
    for extract, kind, first, last in sorted(rows):
        if out and out[-1][:2] == (extract, kind) and first <= out[-1][3] + 1:
            out[-1] = (extract, kind, out[-1][2], max(last, out[-1][3]))
        else:
            out.append((extract, kind, first, last))
    return out


@pytest.mark.parametrize("blocks", [1024, 3])
def test_page_ranges_as_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(tables, "BLOCKS", blocks)
    rnd = random.Random(3)
    pages = [("a", 0, 10, 30), ("a", 10, 10, 30), ("a", 20, 10, 30), ("b", 0, 0, 0), ("c", 5, 0, 4), ("d", 3, 4, 20), ("d", 3, 4, 20)]
    for extract in "efghij":
        total = rnd.randrange(50, 400)
        pages += [(extract, rnd.randrange(0, total + 30), rnd.choice([0, 1, 5, 20]), total) for _ in range(25)]
    df = spark.createDataFrame(pages, "extract string, offset long, items long, total long").repartition(5)
    assert _joined(map(tuple, tables.page_ranges(df).collect())) == _brute_ranges(pages)
    assert tables.page_ranges(df.limit(0)).count() == 0


def test_request_report_of_any_size(spark, tmp_path):
    """Header, then items in order, over many files; one request's items are not gathered in one row or task."""
    requests = spark.createDataFrame([("r1", "applied"), ("r2", "failed"), ("r0", "applied")], "request_id string, status string")
    items = spark.range(200_000).selectExpr("if(id % 1000 = 7, 'r2', 'r1') request_id", "200000 - id application_id", "'applied' apply_status")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.write_request_report(requests, items, f"{tmp_path}/r")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(glob.glob(f"{tmp_path}/r/part-*.json"))
    lines = [[json.loads(x) for x in open(f)] for f in files]
    assert max(map(len, lines)) < 0.5 * 200_000 and len(files) > 3
    rows = [x for part in lines for x in part]
    key = [(x["request_id"], x["line"], x.get("item", {}).get("application_id", 0)) for x in rows]
    assert key == sorted(key) and len(rows) == 200_003
    assert rows[0] == {"request_id": "r0", "line": 0, "request": {"request_id": "r0", "status": "applied"}}


def test_bucketed_tables_join_without_exchange(spark, sf_dir):
    names = catalog_tables(spark, sf_dir, buckets=4)
    t, f = spark.table(names["fact_stage_transition"]), spark.table(names["fact_application"])
    plan = _plan(t.hint("merge").join(f, "application_id"))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark.table(names["stg_applications"]).count() == f.count()
    kinds = {r.name: r.tableType for r in spark.catalog.listTables(names["stg_applications"].split(".")[0].strip("`"))}
    assert kinds == {"stg_applications": "VIEW"}


def test_cube_reads_each_fact_once(spark, sf_dir, tmp_path):
    w = warehouse(spark, sf_dir)
    w.fact_application.write.parquet(f"{tmp_path}/f")
    own = spark.read.parquet(f"{tmp_path}/f")
    none = spark.createDataFrame([], w.fact_offer.schema), spark.createDataFrame([], w.fact_stage_transition.schema)
    cube = marts.overview_cube(own, spark.createDataFrame([], w.dim_job.schema), *none)
    assert _plan(cube).count("FileScan") == 1 and "Expand" in _plan(cube)
    assert marts.overview_from_cube(cube).first().total_applications == own.count()


def test_bitmaps_merge_in_any_order(spark, tmp_path):
    """Late, repeated and id-less events: the stored bitmaps give the distinct counts of all events, and of some days."""
    rnd = random.Random(8)
    rows = [(rnd.choice([None, rnd.randrange(-70_000, 200_000)]), rnd.choice(["Offer", "Final Interview", None]), f"2025-01-0{rnd.randint(1, 9)} 10:00:00") for _ in range(3000)]
    rows += [(None, "Hired", "2025-01-01 00:00:00"), (5, "Offer", None)]
    events = spark.createDataFrame(rows, "application_id long, current_stage string, t string").withColumn("event_at", F.col("t").cast("timestamp"))
    stored = funnel_bitmaps.FunnelBitmaps(spark, f"{tmp_path}/b", buckets=4, folders=2)
    parts = events.randomSplit([1.0] * 5, seed=1)
    for k in (3, 0, 4, 1, 2, 0, 3):
        stored.add(parts[k], f"batch-{k}")
    stored.add(events.limit(500), "again")  # delivered a second time
    assert max(len([1 for e in stored.table.manifest().entries if e[0] == b]) for b in range(4)) <= 2
    want = marts.mart_funnel(events, DEFAULT_STAGES)
    assert sorted(map(tuple, funnel_bitmaps.funnel(stored.read()).collect())) == sorted(map(tuple, want.collect()))
    some = events.where("event_at >= '2025-01-03' and event_at < '2025-01-06'")
    got = funnel_bitmaps.funnel(stored.read("2025-01-03", "2025-01-05"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, marts.mart_funnel(some, DEFAULT_STAGES).collect()))
