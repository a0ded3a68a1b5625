"""Line de-duplication: range-partitioned line hashes, streamed first occurrences, keep bitmaps.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
SALTS = 32  # parts of one key, by document, so that no key is held by one task


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other characters unchanged."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    """The lines of a text, split at \\n; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_stamp(text: Column) -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Every line with a key of ``min_chars`` code points or more: 128-bit key hash, document, position."""
    text = F.col(text_col).cast("string")
    lines = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_stamp(text).alias("stamp"), F.posexplode(text_lines(text)).alias("pos", "line")
    )
    trimmed = lines.select("doc_id", "stamp", "pos", F.btrim("line", F.lit(SPACES)).alias("line"))
    key = ascii_lower(F.col("line"))
    return trimmed.where(F.length("line") >= min_chars).select(
        "doc_id", "stamp", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")
    )


def common_keys(occ: DataFrame, min_docs: int) -> DataFrame:
    """Keys in ``min_docs`` documents or more, with the document that keeps its lines.

    Hashes are range-partitioned with a salt of the document and sorted by
    (hash, salt, document descending, position); the window streams the first
    line of each document of a key.  The parts of a key are then added up.
    """
    salted = occ.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = salted.repartitionByRange("h1", "h2", "salt")
    w = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    first = (F.row_number().over(w) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(w))
    firsts = spread.withColumn("is_first", first).where("is_first")
    parts = firsts.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
    return (
        parts.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("keep").alias("keep_doc")).where(F.col("n_docs") >= min_docs)
    )


def keep_bitmaps(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents that lose lines: doc_id, stamp (of the text), dropped positions as runs.

    ``dropped_runs`` is the run-length compressed bitmap of a document: sorted
    (first, last) positions of dropped lines; all other lines are kept, and a
    document without a row keeps everything.  A key is the line stripped of
    ASCII white space, A-Z lower-cased; rows of one doc_id (null is an id of
    its own, smaller than any) are one document.  Null text is one empty line.
    """
    # Written once: the range partitioner's sample, the stream and the join read hashes, not texts;
    # and a written key table leaves a plain join, whose hot keys Spark can split.
    occ = written(occurrences(docs, min_chars, id_col, text_col), "line-hashes")
    common = written(common_keys(occ, min_docs), "line-keys")
    lost = (
        occ.join(common, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
        .groupBy("doc_id", "stamp")
        .agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    )
    begins = F.filter("lost", lambda x, i: (i == 0) | (F.get("lost", i - 1) != x - 1))
    ends = F.filter("lost", lambda x, i: (i == F.size("lost") - 1) | (F.get("lost", i + 1) != x + 1))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return lost.select("doc_id", "stamp", F.size("lost").alias("n_dropped"), runs.alias("dropped_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped and the kept text (kept lines joined by \\n)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("stamp", text_stamp(F.col("text")))
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("stamp").alias("_stamp"), "n_dropped", "dropped_runs")
    both = base.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("stamp") == F.col("_stamp")), "left")
    lost = F.flatten(F.transform("dropped_runs", lambda r: F.sequence(r["first"], r["last"])))
    lines = text_lines(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost), lambda i: F.get(lines, i))
    return both.select(
        "doc_id",
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
