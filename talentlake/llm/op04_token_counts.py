"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from talentlake.llm.common import as_texts, small_batches
from talentlake.llm.pieces import PieceEncoder, by_bytes

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 512, batch_bytes: int = 1 << 20,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a ``.json`` (tokenizers) or ``.model``
    (sentencepiece) file; special tokens are not added, special strings inside
    a text keep the library's default treatment.  Texts are cut at safe
    boundaries (``pieces``) and encoded in batches of about ``batch_bytes``.
    Null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result.  No shuffle.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        encoder = PieceEncoder.at(tokenizer)
        for batch in batches:
            text = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
            texts, lengths = as_texts(text), []
            for a, b in by_bytes(sizes, batch_bytes):
                lengths += encoder.lengths(texts[a:b])
            n = pa.array(lengths, pa.int64())
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), n, pc.greater(n, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(count, SCHEMA)
