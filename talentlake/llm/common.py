"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from talentlake.session import checkpoint_dir

# Rows of one Arrow batch: bounds a worker's memory at about this many whole texts.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch, since one row is a whole text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return pc.fill_null(column, b"").to_pylist()


def as_texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


class WordHash(dict):
    """Memo of 64-bit word hashes, emptied at a fixed size so that it stays bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


# Odd 64-bit multipliers of the window hash.
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche: a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes: a polynomial modulo 2^64 by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        m = int(_MULT[which])
        part = mix64(words ^ _MULT[which])
        out, done, width = None, 0, 1
        power = m  # m ** width
        rest = size
        while rest:
            if rest & 1:
                piece = part[done : done + n]
                out = piece.copy() if out is None else out * np.uint64(power & (2**64 - 1)) + piece
                done += width
            rest >>= 1
            if rest:
                part = part[: len(part) - width] * np.uint64(power & (2**64 - 1)) + part[width:]
                width *= 2
                power = power * power & (2**64 - 1)
        return mix64(out)
