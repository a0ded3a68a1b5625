"""Counted overwrites (S7), page continuity (S3), request reports of any size (S14), layers in a catalog."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.sources.buckets import _Files

# -- S7: counted overwrite with a swap --------------------------------------------------------


class CountMismatch(RuntimeError):
    """The files of a version do not hold the rows that were counted while writing it."""


class CountedTable:
    """A table that is overwritten as a whole: a folder per version and a manifest with the observed row count.

    The count is taken by the write itself.  A version exists once its manifest
    does, so a write that fails leaves the one before; readers check the files'
    row count (footers only) against the manifest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = _Files(spark, self.path)

    def _versions(self) -> list[str]:
        return [n for n in self._files.names(f"{self.path}/_manifest") if n.startswith("v")]

    def overwrite(self, df: DataFrame) -> int:
        """Write a new version; returns the number of rows written."""
        seen, folder = Observation("rows_written"), f"rows-{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{folder}")
        rows = int(seen.get["rows"])
        version = int(self._versions()[-1][1:-5]) + 1 if self._versions() else 1
        manifest = {"folder": folder, "rows": rows, "schema": df.schema.jsonValue()}
        self._files.write(f"{self.path}/_manifest/v{version:08d}.json", json.dumps(manifest))
        return rows

    def manifest(self) -> dict | None:
        versions = self._versions()
        return json.loads(self._files.read(f"{self.path}/_manifest/{versions[-1]}")) if versions else None

    def read(self) -> DataFrame:
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"no version of {self.path}")
        df = self.spark.read.schema(T.StructType.fromJson(now["schema"])).parquet(f"{self.path}/{now['folder']}")
        if (found := df.count()) != now["rows"]:
            raise CountMismatch(f"{self.path}: {now['rows']} rows written, {found} found")
        return df


# -- S3: continuity of a paged extract ----------------------------------------------------------

BLOCKS = 1024  # of offsets, per extract


def page_ranges(pages: DataFrame) -> DataFrame:
    """``extract, kind, first, last``: ranges of row numbers that the pages leave out or hold too often.

    ``pages``: one row per landed page: extract, offset, items (rows it holds)
    and total (rows announced; the largest counts).  ``missing``: below the
    total and on no page; ``overlap``: on more than one page; ``surplus``: beyond
    the total.  Empty pages and repeated ones are allowed.

    The pages of an extract are dealt to blocks of offsets, so a large extract
    spreads over tasks.  What reaches into a block from the ones before is one
    row per block (its highest end), at most ``BLOCKS`` rows an extract.
    """
    own = pages.select("extract", F.col("offset").cast("long"), F.col("items").cast("long"), F.col("total").cast("long"))
    end = F.max(F.when(F.col("items") > 0, F.col("offset") + F.col("items")))
    totals = own.groupBy("extract").agg(F.max("total").alias("_total"), F.coalesce(end, F.lit(0)).alias("_end"))
    width = F.greatest(F.lit(1), F.ceil(F.greatest("_total", "_end") / F.lit(BLOCKS))).cast("long")
    spans = own.where("items > 0").join(totals, "extract").select(
        "extract", F.col("offset").alias("b"), (F.col("offset") + F.col("items")).alias("e"), F.floor(F.col("offset") / width).alias("_block"),
    )
    # how far the pages before reach: within the block, and from earlier blocks
    inside = Window.partitionBy("extract", "_block").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.groupBy("extract", "_block").agg(F.max("e").alias("_e"))
    before = Window.partitionBy("extract").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    reach = ends.select("extract", "_block", F.max("_e").over(before).alias("_reach"))
    seen = spans.withColumn("_in", F.max("e").over(inside)).join(reach, ["extract", "_block"])
    seen = seen.select("extract", "b", "e", F.coalesce(F.greatest("_in", "_reach"), F.lit(0)).alias("r"))
    at = lambda kind, first, end: F.struct(F.lit(kind).alias("kind"), first.alias("first"), (end - 1).alias("last"))
    b, e, r = F.col("b"), F.col("e"), F.col("r")
    found = seen.select("extract", F.explode(F.array(
        F.when(r < b, at("missing", r, b)), F.when(b < r, at("overlap", b, F.least(r, e))))).alias("x"))
    tail = totals.select("extract", F.explode(F.array(
        F.when(F.col("_end") < F.col("_total"), at("missing", F.col("_end"), F.col("_total"))),
        F.when(F.col("_end") > F.col("_total"), at("surplus", F.greatest(F.col("_total"), F.lit(0)), F.col("_end"))))).alias("x"))
    # gaps beyond the total are part of the surplus
    cut = found.join(totals, "extract").where((F.col("x.kind") == "overlap") | (F.col("x.first") < F.col("_total")))
    last = F.when(F.col("x.kind") == "missing", F.least(F.col("x.last"), F.col("_total") - 1)).otherwise(F.col("x.last"))
    cut = cut.select("extract", "x.kind", "x.first", last.alias("last"))
    return cut.unionByName(tail.where("x is not null").select("extract", "x.kind", "x.first", "x.last"))


# -- S14: request reports ------------------------------------------------------------------------


def write_request_report(requests: DataFrame, items: DataFrame, path: str, key: str = "request_id", order: Sequence[str] = ("application_id",)) -> None:
    """JSON lines, sorted by range over files: each request's line, then one line per item in ``order``.

    A request of any number of items spreads over files and tasks.  Lines are
    ``{"request_id": ..., "line": 0, "request": {...}}`` and ``{..., "line": 1, "item": {...}}``.
    """
    head = requests.select(F.col(key), F.lit(0).alias("line"), F.struct(*requests.columns).alias("request"))
    rows = items.select(F.col(key), F.lit(1).alias("line"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*items.columns).alias("item"))
    lines = head.unionByName(rows, allowMissingColumns=True)
    place = [F.col(key), F.col("line"), *[F.col(f"_o{i}") for i in range(len(order))]]
    lines.repartitionByRange(*place).sortWithinPartitions(*place).select(key, "line", "request", "item").write.json(path)


# -- S8: layers in a catalog ----------------------------------------------------------------------


def materialise(spark: SparkSession, models: Mapping[str, DataFrame], layers: Mapping[str, str], path: str,
                keys: Mapping[str, str] | None = None, buckets: int = 16, prefix: str = "") -> dict[str, str]:
    """Models as tables or views of one schema per layer; returns model name -> qualified name.

    ``layers``: model -> layer.  The layer ``staging`` holds views, defined over
    tables that must be in the catalog too; all other layers hold tables below
    ``path``.  A model with a key in ``keys`` is bucketed and sorted by it, so
    joins of such tables on the key need no exchange.
    """
    names = {}
    for model, df in models.items():
        schema = f"{prefix}{layers[model]}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}` LOCATION '{path}/{layers[model]}'")
        names[model] = f"`{schema}`.`{model}`"
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{path}/{layers[model]}/{model}-{uuid.uuid4().hex}")
        if keys and model in keys:
            # one task per bucket, so that each bucket is one sorted file
            writer = df.repartition(buckets, keys[model]).write.mode("overwrite").format("parquet").option(
                "path", f"{path}/{layers[model]}/{model}-{uuid.uuid4().hex}").bucketBy(buckets, keys[model]).sortBy(keys[model])
        writer.saveAsTable(names[model])
    return names


def staging_view(spark: SparkSession, name: str, over: str, select: str, prefix: str = "") -> str:
    """A view of the staging layer over a catalog table; returns its qualified name."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{prefix}staging`")
    spark.sql(f"CREATE OR REPLACE VIEW `{prefix}staging`.`{name}` AS SELECT {select} FROM {over}")
    return f"`{prefix}staging`.`{name}`"
