"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


#: Rows of one Arrow batch: with long texts, Spark's default of 10,000 holds too much at once.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, and bound batches."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).parents[1]
        path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def unit(mark: Column) -> Column:
    """A hash of 64 bits as a number from 0 to 1."""
    return F.pmod(mark, F.lit(1 << 31)) / float(1 << 31)


def by_bytes(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` characters, or one longer text."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 2_000
) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, from batches sorted by these keys.

    Each table that comes out holds one or more complete groups, and few groups more than
    ``limit`` rows; only a group that crosses a batch is held back.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _last_group(batch, keys)
        if cut == 0 and held and not _same(held[-1], batch, keys):
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        if cut > 0 and rows + cut >= limit:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _key(batch: pa.RecordBatch, i: int, keys: list[str]) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in keys)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return _key(a, a.num_rows - 1, keys) == _key(b, 0, keys)


def _last_group(batch: pa.RecordBatch, keys: list[str]) -> int:
    """Row at which the last group of a sorted batch begins."""
    last, lo, hi = _key(batch, batch.num_rows - 1, keys), 0, batch.num_rows - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if _key(batch, mid, keys) == last:
            hi = mid
        else:
            lo = mid + 1
    return lo
