"""Quality rules: one evaluation, a ledger of failure bits and measurements, versioned policies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import as_bytes, small_batches

SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

# Bit of each rule in ``fail_bits``.
RULES = {
    "few_words": 0,       # n_words < 10
    "repeat_words": 1,    # 100 * n_repeat_words > 20 * n_words
    "symbols": 2,         # 5 * n_symbols > n_words
    "dup_lines": 3,       # 2 * n_dup_lines > n_lines, lines with a word
    "word_length": 4,     # mean word length outside 1.5 .. 20 code points
    "longest_word": 5,    # a word of over 1000 bytes
}
BASE_BITS = 0b11

# A policy is a version and the mask of the rules that reject.
POLICIES = {"base": BASE_BITS, "v1": 0b111111, "v2_no_symbols": 0b111011}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words covered by a window of ``size`` words that is found twice or more in the text (exact)."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base = len(ids)
    if base == len(words):
        return 0
    key = seq[:n].copy()
    bound = base
    for k in range(1, size):
        if bound > (1 << 62) // base:  # renumber densely, so that the packed key stays exact
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bound = int(key.max()) + 1
        key = key * base + seq[k : n + k]
        bound *= base
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + size, np.int32)
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + size, -1)
    return int(np.count_nonzero(np.cumsum(twice)[: len(words)] > 0))


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # exactly the ASCII white space of SPACES
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    spaces = sum(text.count(bytes([c])) for c in SPACES)
    continued = 0
    if not text.isascii():
        raw = np.frombuffer(text, np.uint8)
        continued = int(np.count_nonzero((raw & 0xC0) == 0x80))
    return (
        len(words),
        len(text) - spaces - continued,
        sum(text.count(s.encode()) for s in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        max(map(len, words), default=0),
    )


def _rule(name: str) -> Column:
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < 10,
        "repeat_words": 100 * c("n_repeat_words") > 20 * n,
        "symbols": 5 * c("n_symbols") > n,
        "dup_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "word_length": (n > 0) & ((2 * c("word_chars") < 3 * n) | (c("word_chars") > 20 * n)),
        "longest_word": c("longest_word") > 1000,
    }[name]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The rule ledger: one row per input row with doc_id, every measurement and ``fail_bits``.

    Null text counts as empty (no words: fails ``few_words``), a null id stays
    null, repeated rows give repeated results, other columns are ignored
    (``carry`` names those passed through), an empty table gives an empty
    ledger.  One scan, no shuffle; each text is held alone.
    """
    small_batches(docs.sparkSession)
    passed = [docs.schema[c] for c in carry]

    def run(batches):
        for batch in batches:
            cols = list(zip(*(measure(t) for t in as_bytes(batch.column(1))))) or [()] * len(MEASURES)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols), *(batch.column(2 + i) for i in range(len(carry)))],
                names=["doc_id", *MEASURES, *carry],
            )

    schema = SCHEMA + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in passed)
    inputs = [F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c) for c in carry)]
    rows = docs.select(*inputs).mapInArrow(run, schema)
    bits = sum((F.when(_rule(name), F.lit(1 << bit)).otherwise(F.lit(0)) for name, bit in RULES.items()), F.lit(0))
    return rows.withColumn("fail_bits", bits)


def passes(policy: str = "v1") -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, fail only it (kept without it), and all rejected.

    Works on the counts of the distinct bit patterns (2^rules at most).
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(1 << b).alias("bit")) for k, b in RULES.items() if mask >> b & 1))
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum("n").alias("n_docs"),
    )
