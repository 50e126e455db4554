"""Reading, checking and writing daily partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidemark import schemas
from tidemark.operators.monitoring import union_all


class SchemaMismatch(ValueError):
    """A batch does not fit its target."""


def read_ndjson(spark: SparkSession, root: str, schema: T.StructType, mode: str = "PERMISSIVE") -> DataFrame:
    """Newline-delimited JSON partitions; ``dt`` comes from the path."""
    return spark.read.schema(schema).option("mode", mode).option("basePath", root).json(f"{root}/dt=*")


def conform(df: DataFrame, target: T.StructType, dt: Column | None = None) -> DataFrame:
    """Fit a batch to the target: unknown columns fail, missing ones become null."""
    unknown = sorted(set(df.columns) - set(target.fieldNames()))
    if unknown:
        raise SchemaMismatch(f"unknown columns: {', '.join(unknown)}")
    columns = []
    for f in target.fields:
        if f.name == "dt" and dt is not None:
            columns.append(dt.cast("date").alias("dt"))
        elif f.name in df.columns:
            if df.schema[f.name].dataType != f.dataType:
                raise SchemaMismatch(f"{f.name}: {df.schema[f.name].dataType} is not {f.dataType}")
            columns.append(F.col(f.name))
        else:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def parse_strict(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parse JSON text to the schema; the first bad value fails the job."""
    return df.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def parse_lenient(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parse JSON text; bad rows keep their text in ``_corrupt_record``."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return df.select(F.from_json(column, wide, options).alias("r")).select("r.*")


def partition_mismatch(df: DataFrame) -> DataFrame:
    """Rows whose partition is not their ingestion day."""
    return df.filter(~F.col("dt").eqNullSafe(F.to_date("ingested_at")))


def latest_partition(df: DataFrame) -> DataFrame:
    """Rows of the newest partition; the bound is read first so the scan is pruned."""
    newest = df.agg(F.max("dt").alias("dt")).first()["dt"]
    return df.filter(F.col("dt") == F.lit(newest).cast("date"))


def incremental_partitions(
    available: DataFrame, watermark: DataFrame, lookback_days: int = 0,
    start: date | None = None, end: date | None = None,
) -> DataFrame:
    """Partitions to load: an explicit range, a lookback window, or those after the watermark.

    ``available`` has dt; ``watermark`` is one row (watermark), null when nothing is loaded.
    """
    days = available.select("dt").distinct()
    if start is not None or end is not None:
        low = F.lit(start).cast("date") if start else F.lit("0001-01-01").cast("date")
        high = F.lit(end).cast("date") if end else F.lit("9999-12-31").cast("date")
        return days.filter(F.col("dt").between(low, high))
    mark = F.col("watermark")
    joined = days.join(F.broadcast(watermark), F.lit(True))
    if lookback_days:
        newest = F.broadcast(days.agg(F.max("dt").alias("newest")))
        keep = mark.isNull() | (
            F.col("dt") >= F.date_sub(F.greatest(mark, F.col("newest")), lookback_days))
        return joined.join(newest, F.lit(True)).filter(keep).select("dt")
    return joined.filter(mark.isNull() | (F.col("dt") > mark)).select("dt")


def load_reconciliation(source: DataFrame, loaded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row and null counts per partition, source against loaded."""
    def shape(df: DataFrame, side: str) -> DataFrame:
        row = df.groupBy("dt").agg(F.count(F.lit(1)).alias("rows"),
                                   *[F.count_if(F.col(c).isNull()).alias(f"null.{c}") for c in columns])
        names = ["rows", *[f"null.{c}" for c in columns]]
        return row.unpivot(["dt"], [f"`{n}`" for n in names], "measure", side)

    return shape(source, "source").join(shape(loaded, "loaded"), ["dt", "measure"], "full").select(
        "dt", "measure", "source", "loaded",
        F.col("source").eqNullSafe(F.col("loaded")).alias("matches"))


def table_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows held more often by one copy, with the surplus; duplicates count.

    One grouped sum over both tables, combined map-side.
    """
    columns = left.columns
    signed = left.select(*columns, F.lit(1).alias("__s")).unionByName(
        right.select(*columns, F.lit(-1).alias("__s")))
    return signed.groupBy(*columns).agg(F.sum("__s").alias("surplus")).filter(
        F.col("surplus") != 0
    ).withColumn("side", F.when(F.col("surplus") > 0, "left").otherwise("right"))


def fidelity_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose whole rows differ between two copies: row_id, copies only one side holds, and the columns in which they differ.

    Whole rows are compared as a multiset. A column counts as changed when the least or the greatest value
    of the rows only one side holds differs, which is exact for one row against another; where one side
    has none, nothing is compared.
    """
    columns = [c for c in left.columns if c != key]
    surplus = F.col("surplus")
    sides = {"left": surplus > 0, "right": surplus < 0}
    ends = {f"__{end}{i}_{side}": f(F.when(where, F.col(c)))
            for i, c in enumerate(columns) for side, where in sides.items() for end, f in (("min", F.min), ("max", F.max))}
    per_key = table_diff(left, right).groupBy(key).agg(
        F.coalesce(F.sum(F.when(surplus > 0, surplus)), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(surplus < 0, -surplus)), F.lit(0)).alias("only_right"),
        *[v.alias(n) for n, v in ends.items()])
    both = (F.col("only_left") > 0) & (F.col("only_right") > 0)
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"__min{i}_left").eqNullSafe(F.col(f"__min{i}_right")) | ~F.col(f"__max{i}_left").eqNullSafe(F.col(f"__max{i}_right")), F.lit(c))
        for i, c in enumerate(columns)]))
    return per_key.select(
        F.col(key).cast("string").alias("row_id"), "only_left", "only_right",
        F.when(both, F.array_join(changed, ",")).otherwise("").alias("changed_columns"))


def canonical(df: DataFrame, column: str) -> Column:
    """A value as text that any engine writes alike: times as microseconds, floats with six places."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("decimal(38,6)")
    return F.coalesce(c.cast("string"), F.lit("~"))


def row_text(df: DataFrame) -> Column:
    """The row as one text; nulls are marked."""
    return F.concat_ws("|", *[canonical(df, c) for c in df.columns])


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free content digest: row count and sum of row hashes."""
    word = F.conv(F.substring(F.md5(row_text(df)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(word).cast("string").alias("digest"))


def digest_tree(tables: Mapping[str, DataFrame], partition: str = "dt") -> DataFrame:
    """Rows and order-free content digest of each partition, each table and all tables together.

    A digest is the sum of row hashes, so those of partitions add up to that of their table, and two
    trees that differ show where. All columns count; tables without the partition column have one leaf.
    """
    leaves = []
    for name, df in tables.items():
        word = F.conv(F.substring(F.md5(row_text(df)), 1, 15), 16, 10).cast("decimal(38,0)")
        part = F.col(partition).cast("string") if partition in df.columns else F.lit("all")
        leaves.append(df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(word).alias("digest"))
                      .select(F.lit(name).alias("table_name"), F.coalesce("part", F.lit("none")).alias("part"), "rows", "digest"))
    return union_all(leaves).rollup("table_name", "part").agg(
        F.grouping_id().alias("level"), F.sum("rows").alias("rows"), F.sum("digest").cast("string").alias("digest")
    ).select("level", F.coalesce("table_name", F.lit("*")).alias("table_name"), F.coalesce("part", F.lit("*")).alias("part"), "rows", "digest")


def file_accounting(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and bytes of every file read, by table, from the metadata columns of the scan."""
    return union_all([
        df.select("_metadata.file_name", "_metadata.file_size").groupBy("file_name").agg(
            F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes"))
        .select(F.lit(name).alias("table_name"), "file_name", "rows", "bytes")
        for name, df in tables.items()])


def file_reconciliation(source: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files whose rows differ between two accounts, or that only one has (table_name, file_name, rows)."""
    key = ["table_name", "file_name"]
    return source.select(*key, F.col("rows").alias("source_rows")).join(
        loaded.select(*key, F.col("rows").alias("loaded_rows")), key, "full"
    ).filter(~F.col("source_rows").eqNullSafe(F.col("loaded_rows")))


def id_collisions(batch: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """New ids that already exist."""
    return batch.select(key).distinct().join(history.select(key), key, "left_semi")


def representative_mismatches(
    sample: DataFrame, loaded: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Sampled source rows whose loaded copy is missing or differs in any column."""
    mine = sample.select(key, F.struct(*columns).alias("__want"))
    other = loaded.select(key, F.struct(*columns).alias("__have"))
    return mine.join(other, key, "left").groupBy(key).agg(
        F.bool_or(F.col("__want").eqNullSafe(F.col("__have"))).alias("ok")
    ).filter(~F.col("ok")).select(key)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def append_partitions(df: DataFrame, path: str) -> None:
    """Idempotent daily load: exactly the partitions in ``df`` are replaced.

    A retry of the same day rewrites the same partition, so it changes nothing.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def append_entities(batches: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Load entities in declared order, empty ones skipped; returns rows per entity."""
    loaded = {}
    for entity in schemas.ENTITY_ID:
        batch = batches.get(entity)
        if batch is None or batch.isEmpty():
            continue
        target = schemas.entity_schema(entity)
        loaded[entity] = observed_append(conform(batch, target), f"{root}/{entity}")
    return loaded


def observed_append(df: DataFrame, path: str) -> int:
    """Load partitions and return their rows, counted while they were written and read again after.

    The batch is evaluated once: its count and days come with the write itself.
    """
    written = Observation()
    days = F.collect_set("dt")
    append_partitions(df.observe(written, F.count(F.lit(1)).alias("rows"), days.alias("days")), path)
    counted = written.get
    found = df.sparkSession.read.parquet(path).filter(F.col("dt").isin(list(counted["days"]))).count()
    if found != counted["rows"]:
        raise SchemaMismatch(f"{path}: {counted['rows']} rows written, {found} read")
    return found


def drop_partitions(spark: SparkSession, path: str, column: str, days: Sequence[date | None]) -> None:
    """Remove partitions whose rows have all gone; plain files have no statement for it."""
    for day in days:
        value = "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def verified_count(batch: DataFrame, path: str) -> int:
    """Rows of the batch's partitions, checked to be equal before and after the write."""
    spark = batch.sparkSession
    sides = union_all([
        batch.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("batch")),
        spark.read.parquet(path).join(F.broadcast(batch.select("dt").distinct()), "dt", "left_semi")
        .groupBy("dt").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("table")),
    ]).groupBy("dt").agg(
        F.sum(F.when(F.col("side") == "batch", F.col("n"))).alias("b"),
        F.sum(F.when(F.col("side") == "table", F.col("n"))).alias("t"))
    bad = sides.filter(~F.col("b").eqNullSafe(F.col("t"))).limit(1).collect()
    if bad:
        raise SchemaMismatch(f"partition {bad[0]['dt']}: batch {bad[0]['b']}, table {bad[0]['t']}")
    return sides.agg(F.sum("t").alias("t")).first()["t"]


def create_once(df: DataFrame, path: str) -> int:
    """Create a table, refuse to overwrite one, and check the written row count."""
    df.write.mode("errorifexists").partitionBy("dt").parquet(path)
    return verified_count(df, path)


def full_refresh(df: DataFrame, path: str) -> None:
    """Replace a whole table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dt").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a report table as JSON or CSV files."""
    writer = df.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)
