"""Token-id shards with a minimal perfect hash index for keyed access.

Files below one folder:

* ``payload/shard-*.bin``: raw little-endian ids (16 bits where the vocabulary
  allows, else 32), documents in ascending doc_id order, shards in range order;
* ``index/bucket-*.mph``: minimal perfect hash of the keys of one hash bucket,
  with a fingerprint, shard, offset and length per slot;
* ``entries`` and ``shards``: Parquet tables of all documents and shards; the
  latter says how wide the ids are, so readers need no tokenizer.

A key is (doc_id, copy): copy counts the rows of one doc_id from 0.  Files are
written by ``pyarrow.fs`` under a name of their own per task attempt; only
names that a committed task returned are ever read, so a retried task or a
lost executor leaves at most an unread file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentlake.llm.common import as_texts, mix64, shared_path, small_batches
from talentlake.llm.pieces import PieceEncoder, by_bytes, id_width

MAGIC = b"TLMPH001"
KEYS_A_BUCKET = 100_000
LEVELS = 48


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path.rstrip("/")


# -- minimal perfect hash ------------------------------------------------------------


def _level_hash(key: np.ndarray, copy: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = mix64(key.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        return mix64(a ^ (copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)))


def build_mph(key: np.ndarray, copy: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """Bytes of the index of distinct (key, copy) pairs: levels of bit arrays, a key placed at the
    first level where its hash is alone; its slot is the number of set bits before it."""
    n, left, sizes, bits = len(key), np.arange(len(key)), [], []
    place = np.zeros(n, np.int64)
    base = 0
    for level in range(LEVELS):
        if not len(left):
            break
        m = -(-max(64, len(left) * 3 // 2) // 64) * 64
        at = (_level_hash(key[left], copy[left], level + 1) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        place[left[alone[at]]] = base + at[alone[at]]
        left, base = left[~alone[at]], base + m
        sizes.append(m)
        bits.append(alone)
    if len(left):
        raise ValueError("keys of a bucket are not distinct")
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    packed = np.packbits(flat, bitorder="little")
    words = packed.view("<u8") if len(packed) else np.zeros(0, "<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype("<u4") if len(words) else np.zeros(0, "<u4")
    slot = (np.cumsum(flat) - 1)[place] if n else place
    order = np.empty(n, np.int64)
    order[slot] = np.arange(n)
    fingerprint = _level_hash(key, copy, 0).astype("<u4")
    parts = [words, before, fingerprint[order], shard[order].astype("<u4"), offset[order].astype("<u8"), length[order].astype("<u8")]
    head = MAGIC + struct.pack("<QI", n, len(sizes)) + np.array(sizes, "<u8").tobytes()
    return head + b"".join(p.tobytes() for p in parts)


class MphReader:
    """Constant-time lookups in the bytes of one index file."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not an index file")
        self.n, levels = struct.unpack_from("<QI", raw, 8)
        at = 20

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.sizes = take("<u8", levels).astype(np.int64)
        n_words = int(self.sizes.sum()) // 64
        self.words, self.before = take("<u8", n_words), take("<u4", n_words)
        self.fingerprint, self.shard = take("<u4", self.n), take("<u4", self.n)
        self.offset, self.length = take("<u8", self.n), take("<u8", self.n)

    def slots(self, key: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that is not stored."""
        out, left, base = np.full(len(key), -1, np.int64), np.arange(len(key)), 0
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            bit = base + (_level_hash(key[left], copy[left], level + 1) % np.uint64(m)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            there = (word >> shift) & np.uint64(1) == 1
            below = word[there] & ((np.uint64(1) << shift[there]) - np.uint64(1))
            out[left[there]] = self.before[bit[there] >> 6] + np.bitwise_count(below)
            left, base = left[~there], base + int(m)
        found = out >= 0
        wrong = self.fingerprint[out[found]] != _level_hash(key[found], copy[found], 0).astype("<u4")
        out[np.flatnonzero(found)[wrong]] = -1
        return out


# -- writing ---------------------------------------------------------------------------


def write_corpus(
    docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20,
) -> str:
    """Encode every text, append ``end_id``, write payload and index; returns the folder.

    Documents are range-partitioned and sorted by doc_id.  Null text counts as
    empty (the end id alone).  Rows with a null doc_id come first, in the order
    of their texts' hashes; they have payload and an entry but no key.  Rows of
    one doc_id are consecutive copies (0, 1, ...), ordered by text hash.  Other
    columns are ignored; an empty table gives a folder without shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = path or shared_path(spark, "tokens")
    fs, local = _open(root)
    fs.create_dir(f"{local}/payload", recursive=True)
    fs.create_dir(f"{local}/index", recursive=True)

    def write(batches):
        encoder = PieceEncoder.at(tokenizer)
        end = np.array([end_id], encoder.id_type).tobytes()
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        out, offset, copy, last = None, 0, 0, None
        try:
            for batch in batches:
                texts, ids, lengths, copies = as_texts(batch.column(1)), batch.column(0).to_pylist(), [], []
                if texts and out is None:
                    out = _open(root)[0].open_output_stream(f"{local}/payload/{name}")
                for a, b in by_bytes([len(t) for t in texts], batch_bytes):
                    for raw in encoder.id_bytes(texts[a:b]):
                        out.write(raw)
                        out.write(end)
                        lengths.append(len(raw) // len(end) + 1)
                for k in ids:
                    copy = copy + 1 if k == last and k is not None else 0
                    last = k
                    copies.append(copy)
                n = np.array(lengths, np.int64)
                starts = offset + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else n
                offset += int(n.sum())
                yield pa.record_batch(
                    [batch.column(0), pa.array(copies, pa.int64()), pa.array([shard] * len(n), pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array([name] * len(n), pa.string())],
                    names=["doc_id", "copy", "shard", "offset", "length", "file"],
                )
        finally:
            if out is not None:
                out.close()

    stamp = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    spread = rows.repartitionByRange("doc_id", F.when(F.col("doc_id").isNull(), stamp))
    entries = spread.sortWithinPartitions("doc_id", stamp).mapInArrow(
        write, "doc_id long, copy long, shard long, offset long, length long, file string"
    )
    entries.write.parquet(f"{root}/entries")
    kept = spark.read.schema(entries.schema).parquet(f"{root}/entries")
    _write_index(kept, root, local)
    # As many rows as shards: their ids' running sum places every shard in the whole id stream.
    shards = kept.groupBy("shard", "file").agg(F.sum("length").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed.withColumn("id_width", F.lit(id_width(tokenizer))).write.parquet(f"{root}/shards")
    return root


def _write_index(entries: DataFrame, root: str, local: str) -> None:
    keyed = entries.where("doc_id is not null").select("doc_id", "copy", "shard", "offset", "length")
    n_buckets = max(1, -(-keyed.count() // KEYS_A_BUCKET))

    def build(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        col = lambda c: table[c].to_numpy()
        raw = build_mph(*(col(c) for c in ("doc_id", "copy", "shard", "offset", "length")))
        name = f"bucket-{bucket:06d}-{uuid.uuid4().hex}.mph"
        with _open(root)[0].open_output_stream(f"{local}/index/{name}") as out:
            out.write(raw)
        return pa.table({"bucket": [bucket], "file": [name]}, schema=pa.schema([("bucket", pa.int64()), ("file", pa.string())]))

    files = keyed.withColumn("bucket", _bucket(n_buckets)).groupBy("bucket").applyInArrow(build, "bucket long, file string")
    files.withColumn("n_buckets", F.lit(n_buckets)).write.parquet(f"{root}/index_files")


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("long")


# -- reading -----------------------------------------------------------------------------


def lookup(keys: DataFrame, root: str) -> DataFrame:
    """doc_id, copy, shard, offset, length of every key (doc_id, copy) that the index holds."""
    spark = keys.sparkSession
    local = _open(root)[1]
    files = spark.read.schema("bucket long, file string, n_buckets int").parquet(f"{root}/index_files")
    n_buckets = files.agg(F.max("n_buckets")).first()[0] or 1

    def find(batches):
        name, reader = None, None
        for batch in batches:
            table = batch.to_pydict()
            key, copy = np.array(table["doc_id"], np.int64), np.array(table["copy"], np.int64)
            of = np.array(table["file"], object)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if of[a] != name:
                    name = of[a]
                    with _open(root)[0].open_input_file(f"{local}/index/{name}") as f:
                        reader = MphReader(f.read())
                slot = reader.slots(key[a:b], copy[a:b])
                ok = slot >= 0
                s = slot[ok]
                yield pa.record_batch(
                    [pa.array(key[a:b][ok]), pa.array(copy[a:b][ok]), pa.array(reader.shard[s].astype(np.int64)),
                     pa.array(reader.offset[s].astype(np.int64)), pa.array(reader.length[s].astype(np.int64))],
                    names=["doc_id", "copy", "shard", "offset", "length"],
                )

    # all keys of a bucket in one task, so that each index file is read once
    routed = keys.select("doc_id", "copy").withColumn("bucket", _bucket(n_buckets)).join(files.drop("n_buckets"), "bucket")
    return routed.repartition("bucket").sortWithinPartitions("bucket").select("doc_id", "copy", "file").mapInArrow(
        find, "doc_id long, copy long, shard long, offset long, length long"
    )


def _shards(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("shard long, file string, n_ids long, start long, id_width int").parquet(f"{root}/shards")


def read_ids(places: DataFrame, root: str) -> DataFrame:
    """doc_id, copy, start, n_tokens and ids_crc32 (ids as little-endian 32-bit integers) of each
    place, read from the payload; ``start`` counts the ids of all documents before."""
    spark = places.sparkSession
    local = _open(root)[1]
    shards = _shards(spark, root)

    def read(batches):
        PieceEncoder.release()  # of a worker that has written before
        name, source = None, None
        for batch in batches:
            t = batch.to_pydict()
            crcs = []
            for file, offset, length, width in zip(t["file"], t["offset"], t["length"], t["id_width"]):
                kind = np.dtype(f"<u{width}")
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, _open(root)[0].open_input_file(f"{local}/payload/{file}")
                raw = source.read_at(length * kind.itemsize, offset * kind.itemsize)
                crcs.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([s + o for s, o in zip(t["start"], t["offset"])], pa.int64()),
                 batch.column(4), pa.array(crcs, pa.int64())],
                names=["doc_id", "copy", "start", "n_tokens", "ids_crc32"],
            )
        if source is not None:
            source.close()

    rows = places.select("doc_id", "copy", "shard", "offset", "length").join(shards.select("shard", "file", "start", "id_width"), "shard")
    rows = rows.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return rows.select("doc_id", "copy", "offset", "file", "length", "start", "id_width").mapInArrow(
        read, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long"
    )


def corpus_rows(docs: DataFrame, root: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``docs``, read back through the index
    (rows without an id, which have no key, through their entries)."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    copies = ids.groupBy("doc_id").agg(F.count("*").alias("n"))
    keys = copies.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    entries = spark.read.schema("doc_id long, copy long, shard long, offset long, length long, file string").parquet(f"{root}/entries")
    nameless = entries.where("doc_id is null").select("doc_id", "copy", "shard", "offset", "length")
    return read_ids(lookup(keys, root).unionByName(nameless), root).drop("copy")


def open_key(spark: SparkSession, root: str, doc_id: int, copy: int = 0) -> np.ndarray | None:
    """The ids of one document by keyed access, or None."""
    keys = spark.range(1).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(copy).cast("long").alias("copy"))
    hit = lookup(keys, root).first()
    if hit is None:
        return None
    shard = _shards(spark, root).where(F.col("shard") == hit["shard"]).first()
    kind = np.dtype(f"<u{shard['id_width']}")
    fs, local = _open(root)
    with fs.open_input_file(f"{local}/payload/{shard['file']}") as f:
        return np.frombuffer(f.read_at(hit["length"] * kind.itemsize, hit["offset"] * kind.itemsize), kind)
