"""Token ids of a corpus, range coded in independent blocks.

File format: a folder of Parquet files with one row for each block: the payload of
``rangecoder`` and the directory of the documents, or parts of documents, that it holds.
``file_no`` and ``block_no`` order the blocks, and with them all ids. Spark commits the
files, so a lost executor leaves no half-written block, and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm import rangecoder
from tidemark.llm.common import by_bytes, joined, scratch, stored, table, texts_of
from tidemark.llm.pieces import encoder

BLOCK_SCHEMA = (
    "file_no int, block_no int, n_ids bigint, payload binary, doc_ids array<bigint>, "
    "offsets array<bigint>, sizes array<bigint>, totals array<bigint>"
)
PART_SCHEMA = (
    "file_no int, block_no int, in_block bigint, doc_id bigint, offset bigint, size bigint, total bigint, crc bigint"
)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 20,
    batch_chars: int = 1 << 23,
) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending doc_id order.

    Null ids come first, equal ids by a hash of their texts; repeated rows are written as often
    as they occur. A null text counts as empty and gives the end id alone. A block holds
    ``block_ids`` ids; longer documents go on in the next block. An empty table writes no block.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Blocks(TaskContext.get().partitionId(), block_ids)
        pieces = encoder(tokenizer)
        for batch in joined(batches, batch_chars // 2):
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for begin, end in by_bytes(texts, batch_chars):
                tokens, sizes = pieces.ids(texts[begin:end])
                # The end id goes behind each document.
                tokens = np.insert(tokens, np.cumsum(sizes), end_id)
                yield from writer.add(ids[begin:end], tokens, sizes + 1)
        yield from writer.close()

    (
        docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(encode, BLOCK_SCHEMA)
        .write.option("compression", "none").parquet(path)
    )


class _Blocks:
    """Cuts a stream of documents into blocks."""

    def __init__(self, file_no: int, block_ids: int):
        self.file_no, self.block_no, self.limit = file_no, 0, block_ids
        self._empty()

    def _empty(self) -> None:
        self.ids: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.used = 0

    def add(self, doc_ids: list, tokens: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0
        for doc_id, size in zip(doc_ids, sizes.tolist()):
            offset = 0
            while offset < size:
                take = min(size - offset, self.limit - self.used)
                self.rows.append((doc_id, offset, take, size))
                self.ids.append(tokens[at + offset:at + offset + take])
                self.used += take
                offset += take
                if self.used == self.limit:
                    yield from self.close()
            at += size

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.used:
            columns = list(zip(*self.rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.file_no], pa.int32()), pa.array([self.block_no], pa.int32()),
                 pa.array([self.used], pa.int64()), pa.array([rangecoder.encode(np.concatenate(self.ids))], pa.binary()),
                 *[pa.array([list(c)], pa.list_(pa.int64())) for c in columns]],
                ["file_no", "block_no", "n_ids", "payload", "doc_ids", "offsets", "sizes", "totals"])
            self.block_no += 1
            self._empty()


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Ids of every document part: file_no, block_no, in_block, doc_id, offset, total, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids in _decoded(batches):
            ends = np.concatenate([[0], np.cumsum(rows["sizes"])]).astype(np.int32)
            yield _parts(rows, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))), "ids")

    return blocks.mapInArrow(
        decode, PART_SCHEMA.replace("crc bigint", "ids array<int>"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            yield row, rangecoder.decode(row["payload"])


def _parts(row: dict, values: pa.Array, name: str) -> pa.RecordBatch:
    n = len(row["sizes"])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, row["file_no"], np.int32)), pa.array(np.full(n, row["block_no"], np.int32)),
         pa.array(np.cumsum(row["sizes"]) - row["sizes"], pa.int64()),
         *[pa.array(row[k], pa.int64()) for k in ("doc_ids", "offsets", "sizes", "totals")], values],
        ["file_no", "block_no", "in_block", "doc_id", "offset", "size", "total", name])


def token_digest(blocks: DataFrame) -> DataFrame:
    """One row for each document, from the decoded blocks: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _decoded(batches):
            raw, at, sums = memoryview(ids.astype("<u4").tobytes()), 0, []
            for size in row["sizes"]:
                sums.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
                at += size
            yield _parts(row, pa.array(sums, pa.int64()), "crc")

    # Block starts: sums over the files before, and over the blocks before in the file. One
    # row for each file, then for each block of one file, is all that a task holds.
    in_file = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n")).select(
        "file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    starts = blocks.select(
        "file_no", "block_no", F.coalesce(F.sum("n_ids").over(in_file), F.lit(0)).alias("block_start"),
    ).join(files, "file_no").selectExpr("file_no", "block_no", "file_start + block_start as base")
    # Stored, as it is read twice and decoding is the dear part.
    parts = stored(blocks.mapInArrow(digest, PART_SCHEMA), "parts").join(starts, ["file_no", "block_no"]).withColumn(
        "start", F.expr("base + in_block - offset"))
    whole = parts.filter("size = total").select("doc_id", "start", F.col("total").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # Parts of one document: as many as its ids fill blocks.
    split = parts.filter("size < total").groupBy("start", "doc_id", "total").agg(
        F.sort_array(F.collect_list(F.struct("offset", "size", "crc"))).alias("p")
    ).select("doc_id", "start", F.col("total").alias("n_tokens"),
             pandas_udf(_joined_crc, "bigint")(F.col("p.size"), F.col("p.crc")).alias("ids_crc32"))
    return whole.unionByName(split)


def _joined_crc(sizes: pd.Series, sums: pd.Series) -> pd.Series:
    """crc32 of ids whose consecutive parts have these numbers of ids and crc32 sums."""
    out = []
    for n, c in zip(sizes, sums):
        total = 0
        for size, crc in zip(n, c):
            total = crc_join(total, int(crc), 4 * int(size))
        out.append(total)
    return pd.Series(out, dtype="int64")


#: Fixed value: the polynomial of crc32, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the crc's, both with power 0 in bit 31."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


def crc_join(first: int, second: int, size: int) -> int:
    """crc32 of two byte strings in a row; ``size``: bytes of the second."""
    shift, power, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        n >>= 1
    return _times(first, shift) ^ second


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, table(spark, sf_dir, "documents"))


def written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the ids of all documents to the shared folder and report what the files hold."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(read_blocks(spark, path))
