"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  A row is known by its doc_id (null is
an id like others) and its text's stamp, so repeated and missing ids are
decided text by text.  ``run`` writes every stage's result
as Parquet in the shared folder and reads it back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm import op03_mixing, op06_token_files, op07_quality, op09_decontam, op10_near_dup
from talentlake.llm.common import documents, written
from talentlake.llm.op02_line_dedup import text_stamp

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def _stamped(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, text_stamp(F.col("text")).alias("stamp"))


def _marks(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("doc_id").alias("_id"), F.col("stamp").alias("_stamp"), *more)


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("stamp") == F.col("_stamp"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy, row by row."""
    rules = op07_quality.ledger(docs, carry=COLUMNS[1:])
    return rules.where(op07_quality.passes("v1")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows without an id are compared too and come after the others; of equal
    rows one stays; texts without words are in no group and all stay.
    """
    marks = _marks(written(op10_near_dup.row_marks(docs, size=5, percent=80).where("not kept or n_rows > 1"), "near-marks"), "kept")
    rows = _stamped(docs)
    alone = rows.join(marks, _same_row(), "left_anti").select(*COLUMNS)
    repeated = rows.join(marks.where("kept"), _same_row(), "left_semi").groupBy("doc_id", "stamp")
    one = repeated.agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return alone.unionByName(one.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without an id and each text of a repeated id on its own."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = op09_decontam.decontaminate(docs, benchmark, stamp=True).where("contaminated").select("doc_id", "stamp").distinct()
    return _stamped(docs).join(_marks(found), _same_row(), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows of one id (or none), source and size share one decision."""
    rows = docs.select(*COLUMNS)
    return op03_mixing.mixed_documents(rows, op03_mixing.mix(rows)).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards and their index; one row per document, read back from the files, with or without an id."""
    tokenizer = public_tokenizers.path(TOKENIZER)
    return op06_token_files.corpus_rows(docs, op06_token_files.write_corpus(docs, tokenizer, END_ID))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_files", token_files),
]

ORACLE_SQL = None  # tokenizer, entropy balancing and latent search are not SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
