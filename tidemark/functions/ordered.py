"""Running values per key that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts the whole key in one task. Here keys with
more than ``hot_rows`` rows are cut into segments of about equal shares of their rows, by
quantiles of the first order column; each segment is scanned by its own task and receives a
carry, the combined value of the segments before it. There is one plan for inputs of every
size: without hot keys the parts that serve them are empty, and adaptive execution drops them.
A key also counts as hot only if it has more than one in ``MOST_HOT`` of all rows, so there
are at most that many hot keys, which is the bound for broadcasting them and their quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 5_000_000
MOST_HOT = 20_000
#: Segments of a hot key.
SEGMENTS = 200
_SEG = "__segment"


@dataclass(frozen=True)
class Running:
    """One running output: ``kind`` is sum, last, last_before, lag or lead of ``value``."""

    name: str
    kind: str
    value: Column


def running_sum(name: str, value: Column) -> Running:
    return Running(name, "sum", value)


def running_last(name: str, value: Column) -> Running:
    """Last non-null value up to and including the current row."""
    return Running(name, "last", value)


def running_last_before(name: str, value: Column) -> Running:
    """Last non-null value strictly before the current row."""
    return Running(name, "last_before", value)


def lagged(name: str, value: Column) -> Running:
    """Value on the previous row, null on the first one."""
    return Running(name, "lag", value)


def leading(name: str, value: Column) -> Running:
    """Value on the following row, null on the last one."""
    return Running(name, "lead", value)


def position(name: str = "position") -> Running:
    """One-based row number."""
    return Running(name, "sum", F.lit(1).cast("bigint"))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows; counts are combined map-side."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    return (
        counts.filter(F.col("__n") > hot_rows)
        .crossJoin(F.broadcast(total))
        .filter(F.col("__n") > F.col("__all") / MOST_HOT)
        .drop("__n", "__all")
    )


def _number(df: DataFrame, c: Column) -> Column:
    """A column as a double that never decreases along its ascending order."""
    kind = df.select(c).schema[0].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise ValueError(f"segment_of is needed to cut keys ordered by {kind.simpleString()}")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Sequence[Running],
    hot_rows: int = HOT_ROWS,
    segment_of: Column | None = None,
) -> DataFrame:
    """Add running outputs per key in ascending ``order``, nulls first.

    The order must be total within a key. Null keys form a key of their own. Segments follow
    the first order column, a number, date or time, or ``segment_of``, any numeric expression
    that never decreases along the order; rows that are equal or null there stay together.
    """
    values = {o.name: f"__in_{o.name}" for o in outputs}
    along = _number(df, F.col(order[0]) if segment_of is None else segment_of)
    # Plain equality on non-null text keys keeps one hash partitioning for the hot-key
    # lookup, the window and the carry join.
    texts = [f"__key{i}" for i, _ in enumerate(keys)]
    keyed = df.withColumns({
        **{values[o.name]: _shape(o) for o in outputs}, "__along": along,
        **{t: F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for t, k in zip(texts, keys)},
    })
    shares = F.array(*[F.lit(i / SEGMENTS) for i in range(1, SEGMENTS)])
    hot = (
        keyed.select(*texts, "__along")
        .join(F.broadcast(hot_keys(keyed, texts, hot_rows)), on=texts)
        .groupBy(*texts)
        .agg(F.percentile_approx("__along", shares, F.lit(2_000)).alias("__bounds"))
        .withColumn("__bounds", F.coalesce("__bounds", F.array().cast("array<double>")))
    )
    before_it = F.size(F.filter("__bounds", lambda b: b < F.col("__along")))
    keyed = keyed.join(F.broadcast(hot), on=texts, how="left").withColumn(
        _SEG, F.when(F.col("__bounds").isNotNull(), F.when(F.col("__along").isNull(), 0).otherwise(before_it)))

    within = Window.partitionBy(*texts, _SEG).orderBy(*[F.col(c).asc() for c in order])
    across = Window.partitionBy(*texts).orderBy(_SEG)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    rank = F.struct(*[F.col(c) for c in order])

    local, summary, carry = {}, [], {}
    for o in outputs:
        v, whole = F.col(values[o.name]), f"__sum_{o.name}"
        local[o.name] = _local(o, v, within)
        if o.kind == "sum":
            summary.append(F.sum(v).alias(whole))
            carry[o.name] = F.sum(whole).over(before)
        elif o.kind in ("last", "last_before"):
            summary.append(F.max_by(v, F.when(v.isNotNull(), rank)).alias(whole))
            carry[o.name] = F.last(whole, ignorenulls=True).over(before)
        elif o.kind == "lag":
            summary.append(F.max_by(v, rank).alias(whole))
            carry[o.name] = F.last(whole).over(before)
        else:
            summary.append(F.min_by(v, rank).alias(whole))
            carry[o.name] = F.first(whole).over(after)

    scanned = keyed.withColumns({f"__loc_{n}": c for n, c in local.items()})
    carried = (
        keyed.filter(F.col(_SEG).isNotNull())
        .groupBy(*texts, _SEG)
        .agg(*summary)
        .select(*texts, _SEG, *[c.alias(f"__car_{n}") for n, c in carry.items()])
    )
    joined = scanned.join(carried, on=[*texts, _SEG], how="left")
    result = {o.name: _combine(o) for o in outputs}
    return joined.withColumns(result).select(
        *[c for c in df.columns if c not in result], *result
    )


def _shape(o: Running) -> Column:
    if o.kind == "sum":
        return F.coalesce(o.value, F.lit(0))
    if o.kind in ("lag", "lead"):
        return F.struct(o.value.alias("v"))
    if o.kind in ("last", "last_before"):
        return o.value
    raise ValueError(f"unknown running kind {o.kind}")


def _local(o: Running, value: Column, window: WindowSpec) -> Column:
    """Value inside one window partition."""
    if o.kind == "lag":
        return F.lag(value).over(window)
    if o.kind == "lead":
        return F.lead(value).over(window)
    last = -1 if o.kind == "last_before" else Window.currentRow
    frame = window.rowsBetween(Window.unboundedPreceding, last)
    return F.sum(value).over(frame) if o.kind == "sum" else F.last(value, ignorenulls=True).over(frame)


def _combine(o: Running) -> Column:
    here, carried = F.col(f"__loc_{o.name}"), F.col(f"__car_{o.name}")
    if o.kind == "sum":
        return here + F.coalesce(carried, F.lit(0))
    if o.kind in ("last", "last_before"):
        return F.coalesce(here, carried)
    return F.coalesce(here, carried).getField("v")
