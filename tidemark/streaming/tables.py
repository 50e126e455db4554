"""Sources and sinks of the streaming twins.

Sinks are idempotent by batch id: a batch that runs again after a failure rewrites its own
folder, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import first_row
from tidemark.sources.partitions import table_exists


def read_files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Stream over a folder of parquet files; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def drain(
    stream: DataFrame, checkpoint: str, mode: str,
    sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None,
) -> None:
    """Process what is available now and stop; a later call continues from the checkpoint."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True)
    started = writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(path)
    started.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes each batch to its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Rows of the batch folders, of those before a batch if given, with ``batch_id``.

    Batches run one after the other, so all folders below a running batch are complete,
    and a repeated batch sees the same input again.
    """
    if before == 0:
        return None
    rows = spark.read.option("basePath", path).parquet(path)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def newest_per_key(
    rows: DataFrame, keys: Sequence[str], version: str | None = None
) -> DataFrame:
    """Current value per key over batch folders (merge on read).

    Without ``version`` the newest batch wins; with it the highest version, and at equal
    versions the earlier batch, as a merge that only accepts newer versions would keep.
    """
    order = [F.col("batch_id").desc()] if version is None else [
        F.col(version).desc_nulls_last(), F.col("batch_id").asc()]
    return first_row(rows, keys, order).drop("batch_id")


class KeyedTable:
    """Current rows per key under a folder, kept up to date batch by batch.

    Rows lie in ``buckets`` by a hash of the key. A batch reads and writes only the buckets its keys
    fall into, and of these only the newest version: every version of a bucket is a whole one, the merge of
    the version before with the batch. A version becomes readable by its entry in the manifest of the batch,
    which is written last; a batch that runs again finds the state before it and writes the same rows. Versions
    that no manifest within ``keep`` batches names are removed, so the folder holds a few copies of the table.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 256, keep: int = 3):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path, list(keys), buckets, keep

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> batch that wrote its newest version, among batches below ``before``."""
        if not table_exists(self.spark, f"{self.path}/manifest"):
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest")
        if before is not None:
            rows = rows.filter(F.col("batch_id") < before)
        # At most one row a bucket and batch; old manifests are folded into the newest.
        return {r["bucket"]: r["batch_id"] for r in rows.groupBy("bucket").agg(F.max("batch_id").alias("batch_id")).collect()}

    def read(self, versions: dict[int, int] | None = None) -> DataFrame | None:
        """Rows of the newest versions; only their folders are listed and read."""
        versions = self.versions() if versions is None else versions
        if not versions:
            return None
        folders = [f"{self.path}/rows/batch_id={b}/bucket={k}" for k, b in sorted(versions.items())]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*folders).drop("batch_id", "bucket")

    def merge(self, batch: DataFrame, batch_id: int, pick: Callable[[DataFrame], DataFrame]) -> None:
        """Merge a batch; ``pick`` leaves one row of each key among old and new ones."""
        if batch.isEmpty():
            return
        bucketed = batch.withColumn("bucket", self.bucket())
        touched = [r[0] for r in bucketed.select("bucket").distinct().collect()]
        known = self.versions(before=batch_id)
        old = self.read({k: known[k] for k in touched if k in known})
        rows = batch if old is None else old.select(*batch.columns).unionByName(batch)
        merged = pick(rows).withColumn("bucket", self.bucket())
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch_id={batch_id}")
        entries = self.spark.createDataFrame([(k,) for k in touched], "bucket int").coalesce(1)
        entries.write.mode("overwrite").parquet(f"{self.path}/manifest/batch_id={batch_id}")
        self._clean(batch_id)

    def _clean(self, batch_id: int) -> None:
        """Remove bucket versions older than the one current ``keep`` batches ago."""
        settled = self.versions(before=batch_id - self.keep + 1)
        if not settled:
            return
        rows = self.spark.read.parquet(f"{self.path}/manifest")
        old = [(r["batch_id"], r["bucket"]) for r in rows.filter(F.col("batch_id") <= batch_id - self.keep).collect() if settled[r["bucket"]] > r["batch_id"]]
        for batch, bucket in old:
            remove(self.spark, f"{self.path}/rows/batch_id={batch}/bucket={bucket}")
        if len(old) >= self.buckets:
            # Fold what is settled into one manifest per writing batch.
            by_batch: dict[int, list[int]] = {}
            for bucket, batch in settled.items():
                by_batch.setdefault(batch, []).append(bucket)
            done = {r["batch_id"] for r in rows.filter(F.col("batch_id") <= batch_id - self.keep).select("batch_id").distinct().collect()}
            for batch in done - by_batch.keys():
                remove(self.spark, f"{self.path}/manifest/batch_id={batch}")


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
