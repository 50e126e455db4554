"""Token counts: batch encoding in Arrow functions that return lengths only.

Arrow batches are joined or cut to about ``batch_chars`` characters; texts are split at
safe boundaries (see ``pieces``), so a long text costs its distinct pieces and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import by_bytes, joined, table, texts_of
from tidemark.llm.pieces import encoder

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, batch_chars: int = 1 << 23) -> DataFrame:
    """UTF-8 bytes and tokens of every whole text, without added special tokens.

    ``tokenizer`` is the path of a byte-level BPE file. A null text counts as empty: 0 bytes,
    0 tokens. Rows are independent: repeated rows, null ids and extra columns change nothing,
    and an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        for batch in joined(batches, batch_chars // 2):
            ids, column = batch.column(0), batch.column(1)
            texts = texts_of(column)
            for begin, end in by_bytes(texts, batch_chars):
                n = pa.array(pieces.lengths(texts[begin:end]), pa.int64())
                size = pc.fill_null(pc.binary_length(column.slice(begin, end - begin)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), size, n, pc.greater(n, limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(count, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
