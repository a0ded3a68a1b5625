"""A bucketed table with versioned manifests: appends, copy-on-write merges, compaction.

Rows are dealt to buckets by a hash of the table's key, the one by which Spark
shuffles: a task of a merge by that key holds rows of few buckets and writes
them without another shuffle.  Every commit writes Parquet files to a folder of
its own and then one manifest, which lists the folders that make up each bucket:

``data/<commit folder>/bucket=<b>/part-*.parquet``
``_manifest/v<n>.json``       what version n consists of
``_commits/<hash>.json``      the commits done, by their key

* Readers open one manifest, so they see whole commits only; old versions stay
  readable until ``vacuum``.
* ``merge``, ``merge_latest`` and ``replace`` read and rewrite the touched
  buckets only; the others keep their files.  ``append`` adds a folder.  What is
  merged is written first, as it comes and with the needed columns only, so
  that its buckets are known.
* A commit has a key: repeating it changes nothing.  A commit that was killed
  has left files that no manifest lists; its repetition starts anew.
* Manifests have a row per bucket and folder, which ``compact`` bounds; that,
  and the numbers of the touched buckets, is all that reaches the driver.

One writer at a time: a manifest is published by a rename that fails where the
version exists, so of two writers the later one gets ``ConcurrentCommit``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentlake.functions.windows import latest_per_key
from talentlake.sources.raw import upsert

_BUCKET = "_bucket"
_ORDER = "_order"


class ConcurrentCommit(RuntimeError):
    """Another writer has published this version first."""


class _Files:
    """Small files and folders of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write under another name, then rename: the file is there whole or not at all, and never replaced."""
        draft = self._path(f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        options = getattr(self._hadoop, "Options$Rename")
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(draft, self._path(path), self._gateway.new_array(options, 0))
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentCommit(path) from None
            raise

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


@dataclass(frozen=True)
class Manifest:
    version: int
    commit: str
    entries: tuple[tuple[int, str, int], ...]  # bucket, folder, rows
    hash: str = "hash"  # tables written before it was noted are dealt by xxhash64

    def buckets(self) -> list[int]:
        return sorted({b for b, *_ in self.entries})

    def rows(self) -> int:
        return sum(n for *_, n in self.entries)


class BucketedTable:
    """``keys`` are SQL expressions over the columns; their hash decides a row's bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.n_buckets = spark, path.rstrip("/"), tuple(keys), buckets
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self._files = _Files(spark, self.path)

    # -- reading --

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._files.names(f"{self.path}/_manifest") if n.startswith("v")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the one asked for; an empty one before the first commit."""
        if version is None:
            version = max(self.versions(), default=0)
        text = self._files.read(f"{self.path}/_manifest/v{version:08d}.json") if version else None
        if text is None:
            return Manifest(0, "", ())
        raw = json.loads(text)
        entries = tuple((b, f, n) for b, f, n in raw["entries"])
        return Manifest(raw["version"], raw["commit"], entries, raw.get("hash", "xxhash64"))

    def bucket_of(self) -> Column:
        by = F.xxhash64 if self.manifest().hash == "xxhash64" else F.hash
        return F.pmod(by(*[F.expr(k) for k in self.keys]), F.lit(self.n_buckets)).cast("int")

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Whole commits up to a version; only the given buckets' files are opened."""
        wanted = None if buckets is None else set(buckets)
        return self._open([e for e in self.manifest(version).entries if wanted is None or e[0] in wanted])

    def _open(self, entries) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/{_BUCKET}={b}" for b, folder, _ in entries]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # -- writing --

    def append(self, rows: DataFrame, commit: str) -> list[int]:
        """Add rows; returns the buckets that have got some."""
        def change(now: Manifest):
            new = self._write(rows, "in")
            return [*now.entries, *new], new
        return self._commit(commit, change)

    def merge(self, incoming: DataFrame, commit: str, on: Sequence[str], columns: Sequence[str] | None = None,
              order: Sequence[Column] | None = None) -> list[int]:
        """``upsert`` of the touched buckets (``on`` must decide the bucket); returns them."""
        if order:
            incoming = incoming.withColumn(_ORDER, F.struct(*order))
        if columns is not None:
            incoming = incoming.select(*dict.fromkeys((*on, *columns)), *([_ORDER] if order else []))
        else:
            columns = [c for c in incoming.columns if c not in on and c != _ORDER]
        by = [F.col(_ORDER)] if order else None
        return self._rewrite(incoming, commit, on, lambda old, new: upsert(old, new, on, columns, by))

    def merge_latest(self, incoming: DataFrame, commit: str, on: Sequence[str], order: Sequence[Column]) -> list[int]:
        """Per key (NULLs are equal) the row with the largest ``order`` among the stored and the incoming rows."""
        return self._rewrite(incoming, commit, on, lambda old, new: latest_per_key(old.unionByName(new), on, order))

    def replace(self, rows: DataFrame, buckets: Sequence[int], commit: str) -> list[int]:
        """New contents of the given buckets (``rows`` holds rows of these only)."""
        def change(now: Manifest):
            touched = set(buckets)
            new = self._write(rows, "new")
            return [*(e for e in now.entries if e[0] not in touched), *new], [(b, "", 0) for b in touched]
        return self._commit(commit, change)

    def compact(self, commit: str, most: int = 4) -> list[int]:
        """Buckets of more than ``most`` folders in one folder each."""
        def change(now: Manifest):
            folders: dict[int, int] = {}
            for b, *_ in now.entries:
                folders[b] = folders.get(b, 0) + 1
            many = {b for b, n in folders.items() if n > most}
            new = self._write(self._open([e for e in now.entries if e[0] in many]), "compact") if many else []
            return [*(e for e in now.entries if e[0] not in many), *new], [(b, "", 0) for b in many]
        return self._commit(commit, change)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the last ``keep`` versions lists, and the older manifests."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for _, f, _ in self.manifest(v).entries}
        gone = [f for f in self._files.names(f"{self.path}/data") if f not in used]
        for folder in gone:
            self._files.delete(f"{self.path}/data/{folder}")
        for v in versions[:-keep]:
            self._files.delete(f"{self.path}/_manifest/v{v:08d}.json")
        return gone

    # -- commits --

    def _done(self, commit: str) -> str:
        return f"{self.path}/_commits/{hashlib.sha256(commit.encode()).hexdigest()}.json"

    def committed(self, commit: str) -> list[int] | None:
        """The buckets that a commit has touched, or None if it has not been done."""
        text = self._files.read(self._done(commit))
        return None if text is None else json.loads(text)["touched"]

    def _settle(self) -> Manifest:
        """The newest version, with its commit noted even if its writer was killed in between."""
        now = self.manifest()
        if now.version and self.committed(now.commit) is None:
            raw = json.loads(self._files.read(f"{self.path}/_manifest/v{now.version:08d}.json"))
            self._files.write(self._done(now.commit), json.dumps({"commit": now.commit, "touched": raw["touched"]}))
        return now

    def _commit(self, commit: str, change: Callable) -> list[int]:
        now = self._settle()
        done = self.committed(commit)
        if done is not None:
            return done
        entries, touched = change(now)
        touched = sorted({b for b, *_ in touched})
        new = {"version": now.version + 1, "commit": commit, "touched": touched, "entries": sorted(entries), "hash": now.hash}
        self._files.write(f"{self.path}/_manifest/v{now.version + 1:08d}.json", json.dumps(new))
        self._files.write(self._done(commit), json.dumps({"commit": commit, "touched": touched}))
        return touched

    def _rewrite(self, incoming: DataFrame, commit: str, on: Sequence[str], merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        def change(now: Manifest):
            path = f"{self.path}/data/landed-{uuid.uuid4().hex}"
            dealt = incoming.withColumn(_BUCKET, self.bucket_of())
            dealt.write.parquet(path)
            landed = self.spark.read.schema(dealt.schema).parquet(path)
            touched = {r[0] for r in landed.select(_BUCKET).distinct().collect()}
            if not touched:
                return now.entries, []
            rows = merged(self._open([e for e in now.entries if e[0] in touched]), landed.drop(_BUCKET))
            # shuffled by the table's key already, each task has rows of few buckets
            new = self._write(rows, "merged", even=tuple(on) != self.keys)
            self._files.delete(path)
            return [*(e for e in now.entries if e[0] not in touched), *new], [(b, "", 0) for b in touched]
        return self._commit(commit, change)

    def _write(self, rows: DataFrame, what: str, even: bool = True) -> list[tuple[int, str, int]]:
        """Write rows by bucket to a new folder, with all of the table's columns, in its types."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        folder = f"{what}-{uuid.uuid4().hex}"
        path = f"{self.path}/data/{folder}"
        dealt = rows.withColumn(_BUCKET, self.bucket_of())
        if even:  # tasks of even size, each with few buckets: a large bucket is dealt to several tasks
            dealt = dealt.hint("rebalance", F.col(_BUCKET))
        dealt.write.partitionBy(_BUCKET).parquet(path)
        names = self._files.names(path)
        if not any(n.startswith(f"{_BUCKET}=") for n in names):
            return []
        sizes = self.spark.read.schema(f"{_BUCKET} int").parquet(path).groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n"))
        return sorted((r[_BUCKET], folder, r["n"]) for r in sizes.collect())
