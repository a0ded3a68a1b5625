"""The bucketed table: whole commits, untouched files, retries, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from talentlake.sources.buckets import BucketedTable, ConcurrentCommit
from talentlake.sources.raw import upsert


def _files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def _live(table):
    return {f for f in _files(table.path) for b, folder, _ in table.manifest().entries if f"/{folder}/_bucket={b}/" in f}


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def table(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('v', id) name", "cast(id % 5 as int) g")
    t = BucketedTable(spark, f"{tmp_path}/t", df.schema, ["id"], buckets=16)
    t.append(df, "load")
    return t


def test_merge_rewrites_touched_buckets_only(spark, table):
    before, old = _live(table), table.read()
    incoming = spark.createDataFrame([(7, "new7", 1), (7, "newer7", 2), (5000, "added", 3), (None, "no key", 4)], "id long, name string, t int")
    want = _rows(upsert(old, incoming, ["id"], ["name"], [F.col("t")]))
    touched = table.merge(incoming, "m1", ["id"], ["name"], [F.col("t")])
    assert 1 <= len(touched) <= 3 and _rows(table.read()) == want
    after = _live(table)
    kept = {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert kept <= after and len(kept) >= 13  # untouched files keep their names
    assert _rows(table.read(version=1)) == _rows(old)  # the version before stays readable
    assert table.merge(incoming, "m1", ["id"], ["name"]) == touched and table.manifest().version == 2  # done once
    assert table.read(buckets=touched).count() < 400


def test_append_twice_changes_nothing(spark, table):
    rows = spark.range(1000, 1010).selectExpr("id", "'x' name", "0 g")
    touched = table.append(rows, "batch-1")
    assert table.append(rows, "batch-1") == touched and table.read().count() == table.manifest().rows() == 1010
    assert table.append(rows, "batch-2") == touched and table.read().count() == 1020
    assert table.append(rows.limit(0), "empty") == [] and table.read().count() == 1020


def test_killed_commits(spark, table, monkeypatch):
    """Files without a manifest are never read; a manifest without its note counts as done."""
    rows = spark.range(2000, 2010).selectExpr("id", "'x' name", "0 g")
    write = type(table._files).write

    def killed(self, path, text):
        raise RuntimeError("killed")

    monkeypatch.setattr(type(table._files), "write", killed)
    with pytest.raises(RuntimeError):
        table.append(rows, "b")
    monkeypatch.setattr(type(table._files), "write", write)
    assert table.read().count() == 1000 and table.committed("b") is None
    table.append(rows, "b")
    assert table.read().count() == 1010
    table._files.delete(table._done("b"))
    assert len(table.append(rows, "b")) > 0 and table.read().count() == 1010
    with pytest.raises(ConcurrentCommit):
        table._files.write(f"{table.path}/_manifest/v00000002.json", "{}")
    assert table.vacuum(keep=1) and table.read().count() == 1010 and _files(table.path) == _live(table)


def test_compaction_keeps_rows(spark, table):
    for k in range(5):
        table.append(spark.range(k * 10, k * 10 + 10).selectExpr("id", "'x' name", "0 g"), f"b{k}")
    want = _rows(table.read())
    many = table.compact("c", most=3)
    folders = [b for b, *_ in table.manifest().entries]
    assert many and max(folders.count(b) for b in set(folders)) <= 3 and _rows(table.read()) == want
    assert table.compact("c", most=0) == many  # the commit is known


def test_merge_latest_with_null_keys(spark, tmp_path):
    schema = "a string, b long, v string, t int"
    t = BucketedTable(spark, f"{tmp_path}/l", spark.createDataFrame([], schema).schema, ["a", "b"], buckets=4)
    assert t.read().count() == 0
    t.merge_latest(spark.createDataFrame([("x", 1, "old", 1), (None, None, "n1", 1), ("x", 1, "older", 0)], schema), "1", ["a", "b"], [F.col("t")])
    t.merge_latest(spark.createDataFrame([("x", 1, "new", 2), (None, None, "n0", 0), ("y", None, "y", 5)], schema), "2", ["a", "b"], [F.col("t")])
    assert _rows(t.read()) == sorted([("x", 1, "new", 2), (None, None, "n1", 1), ("y", None, "y", 5)], key=str)


def test_replace(spark, table):
    b = table.manifest().buckets()[0]
    rows = table.read(buckets=[b])
    n = rows.count()
    table.replace(rows.limit(1), [b], "r")
    assert table.read().count() == 1000 - n + 1
    table.replace(rows.limit(0), [b], "r2")
    assert table.read().count() == 1000 - n and b not in table.manifest().buckets()


def test_merge_by_the_key_needs_no_shuffle_to_write(spark, table, monkeypatch):
    """Incoming rows land as they come, with the needed columns; what is merged by the key is written as the join leaves it."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, parquet = [], DataFrameWriter.parquet

    def spied(self, path, *args, **kwargs):
        plans.append((path.rsplit("/", 1)[1].split("-")[0], self._df.columns, self._df._jdf.queryExecution().optimizedPlan().toString()))
        return parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    incoming = spark.range(500, 1500).selectExpr("id", "concat('n', id) name", "0 g", "'not needed' extra", "2 t")
    want = _rows(upsert(table.read(), incoming, ["id"], ["name"], [F.col("t")]))
    assert len(table.merge(incoming, "m", ["id"], ["name"], [F.col("t")])) == 16
    assert [p[0] for p in plans] == ["landed", "merged"] and not any("RebalancePartitions" in p[2] for p in plans)
    assert set(plans[0][1]) == {"id", "name", "_order", "_bucket"}
    assert _rows(table.read()) == want and table.manifest().rows() == 1500
    # every row is where its bucket says
    for b in table.manifest().buckets():
        assert table.read(buckets=[b]).filter(table.bucket_of() != b).count() == 0
    empty = table.merge(incoming.limit(0), "none", ["id"], ["name"], [F.col("t")])
    assert empty == [] and table.manifest().rows() == 1500


def test_table_dealt_by_the_former_hash(spark, tmp_path, monkeypatch):
    import json

    df = spark.range(100).selectExpr("id", "'old' name")
    t = BucketedTable(spark, f"{tmp_path}/t", df.schema, ["id"], buckets=4)
    with monkeypatch.context() as m:
        m.setattr("talentlake.sources.buckets.F.hash", F.xxhash64)
        t.append(df, "load")
    path = next((tmp_path / "t" / "_manifest").glob("v*.json"))
    raw = json.loads(path.read_text())
    assert raw.pop("hash") == "hash"
    path.write_text(json.dumps(raw))
    for crc in (tmp_path / "t" / "_manifest").glob(".*.crc"):
        crc.unlink()
    t.merge(spark.range(50, 150).selectExpr("id", "'new' name"), "m", ["id"], ["name"])
    t.merge(spark.range(40, 60).selectExpr("id", "'newer' name"), "m2", ["id"], ["name"])
    assert t.manifest().hash == "xxhash64"
    assert dict(_rows(t.read())) == {i: "newer" if 40 <= i < 60 else "new" if i >= 50 else "old" for i in range(150)}
    assert t.read().count() == 150
