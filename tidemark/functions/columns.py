"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surrogate_key(*parts: Column | str) -> Column:
    """md5 over the parts joined with ``|``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    if len(cols) == 1:
        return F.md5(cols[0].cast("string"))
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, null when the denominator is null or zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps after truncating both to the second."""
    return F.unix_timestamp(F.date_trunc("second", end)) - F.unix_timestamp(
        F.date_trunc("second", start)
    )


def date_key(day: Column) -> Column:
    """Integer yyyymmdd."""
    return F.date_format(day, "yyyyMMdd").cast("int")


def in_order(start: Column, end: Column) -> Column:
    """end >= start, null when the end is missing."""
    return F.when(end.isNull(), F.lit(None).cast("boolean")).otherwise(end >= start)


def differs(left: Column, right: Column) -> Column:
    """Null-safe inequality."""
    return ~left.eqNullSafe(right)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key.

    The ``row_number = 1`` filter lets Spark limit each key to one row per map
    task before the shuffle, so a key with many copies never lands whole in one task.
    """
    ranked = df.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def spread(df: DataFrame, at_most: int = 32) -> DataFrame:
    """Use the available cores on an input of only a few file splits.

    Large inputs have more splits than cores and pass through without a shuffle.
    """
    wanted = min(at_most, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Bits and bits a row of the bitmaps that thin out rows before a join.
BITS, ROW_BITS = 2**26, 32_768


def _with_mark(df: DataFrame, value: Column, hashes: DataFrame) -> DataFrame:
    """Add ``__marked``: whether the hash ``value`` may be among ``hashes`` (one column)."""
    def parts(h: Column) -> tuple[Column, Column]:
        bit = F.pmod(h, F.lit(BITS))
        return F.floor(bit / ROW_BITS).cast("int"), (bit % ROW_BITS).cast("int")

    bucket, place = parts(F.col(hashes.columns[0]))
    bits = hashes.select(bucket.alias("__bucket"), place.alias("__place")).groupBy("__bucket").agg(
        F.bitmap_construct_agg(F.col("__place").cast("bigint")).alias("__bits"))
    bucket, place = parts(value)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, place % 8).bitwiseAND(1) == 1
    return df.withColumn("__bucket", bucket).join(F.broadcast(bits), "__bucket", "left").select(
        *df.columns, F.coalesce(is_set, F.lit(False)).alias("__marked"))


def may_be_in(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose ``column`` may be among ``ids``: all that are, and few others.

    The ids' hashes set bits in a bitmap of at most 8 MB, which is broadcast, so a small part of a
    large table is found without a shuffle; a join on the ids themselves makes it exact.
    """
    marked = _with_mark(df, F.xxhash64(column), ids.select(F.xxhash64(column).alias("__hash")))
    return marked.filter("__marked").drop("__marked")


def _repeated_hashes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.xxhash64(key).alias("__hash")).agg(F.count(F.lit(1)).alias("__n")).filter(
        F.col("__n") > 1).select("__hash")


def repeated_and_single(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may repeat, all that do and few others, and the rest, none of which is shuffled.
    ``df`` is read several times, so it should be a scan."""
    marked = _with_mark(df, F.xxhash64(key), _repeated_hashes(df, key))
    return marked.filter("__marked").drop("__marked"), marked.filter(~F.col("__marked")).drop("__marked")


def repeated_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key may repeat: all that do, and few others."""
    return _with_mark(df, F.xxhash64(key), _repeated_hashes(df, key)).filter("__marked").drop("__marked")


def first_of_repeated(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """As ``first_row``, for keys that seldom repeat: only rows whose key may repeat are shuffled.

    Hashes of the keys are counted, those seen more than once go into a bitmap. A row that is not in
    it has a key of its own and stays where it is. ``df`` is read several times, so it should be a scan.
    """
    marked = _with_mark(df, F.xxhash64(key), _repeated_hashes(df, key))
    several = first_row(marked.filter("__marked"), [key], order)
    return marked.filter(~F.col("__marked")).unionByName(several).drop("__marked")
