"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm import op01_license, op02_line_dedup, op03_mixing, op04_token_counts, op05_secrets
from talentlake.llm import op06_token_files, op07_quality, op08_substring, op09_decontam, op10_near_dup
from talentlake.llm import op11_alignment, op12_hard_negatives, op13_fingerprints
from talentlake.llm.common import documents

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

END_ID = 2
SHINGLE_WORDS = 4


def register(name: str, oracle: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


@register("op1_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_license.license_scan(documents(spark, sf_dir))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register("op2_line_dedup", OP2_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kept = op02_line_dedup.apply_bitmaps(docs, op02_line_dedup.keep_bitmaps(docs, min_chars=40, min_docs=5))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register("op3_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op03_mixing.mix_rows(op03_mixing.mix(documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


@register("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@register("op5_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_secrets.scan_secrets(documents(spark, sf_dir))


@register("op6_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tokenizer = documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")
    root = op06_token_files.write_corpus(docs, tokenizer, END_ID)
    return op06_token_files.corpus_rows(docs, root)


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS t(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, unnest(range(0, 5)) AS t(o) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(list_max([strlen(x) for x in ws]), 0) AS longest_word
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), bits AS (
  SELECT *, n_words < 10 AS b0, 100 * n_repeat_words > 20 * n_words AS b1, 5 * n_symbols > n_words AS b2,
    2 * n_dup_lines > n_lines AS b3, n_words > 0 AND (2 * word_chars < 3 * n_words OR word_chars > 20 * n_words) AS b4,
    longest_word > 1000 AS b5
  FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed,
  NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5) AS kept,
  b0::INT + 2 * b1::INT + 4 * b2::INT + 8 * b3::INT + 16 * b4::INT + 32 * b5::INT AS fail_bits
FROM bits
"""


@register("op7_quality_rules", OP7_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op07_quality.ledger(documents(spark, sf_dir))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id", *measures, (~op07_quality.passes("base")).alias("base_failed"), op07_quality.passes("v1").alias("kept"), "fail_bits"
    )


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM w, unnest(range(1, len(ws) - 33)) AS t(i)
), common AS (
  SELECT g FROM win GROUP BY g HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM win JOIN common USING (g), unnest(range(0, 35)) AS t(o)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@register("op8_substring_dedup", OP8_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kept = op08_substring.cut_spans(docs, op08_substring.repeated_spans(docs, window=35))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register("op9_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_decontam.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g
  FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.r
), comp AS (
  SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""


@register("op10_near_duplicates", OP10_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_near_dup.near_duplicates(documents(spark, sf_dir), size=SHINGLE_WORDS, percent=80)


@register("op11_alignment")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = op11_alignment.align(documents(spark, sf_dir), *paths)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""


@register("op12_hard_negatives", OP12_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return op12_hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=5, low=80, high=100, label=label)


@register("op13_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op13_fingerprints.edited_likeness(documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


