"""Registration of queries: a Spark function, the result fields and the SQL oracle.

A field is ``name`` or ``name:kind``. Kinds fix the result type in both engines:
``i`` bigint, ``f`` double rounded to six places, ``m`` money as double, ``b`` boolean,
``t`` date or timestamp as text; without a kind the field is text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.oracle import oracle
from tidemark.plans.lake import Lake
from tidemark.session import configure


@dataclass(frozen=True)
class Query:
    build: Callable[[Lake], DataFrame]
    fields: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.project(self.build(lake_for(spark, sf_dir)))

    def project(self, df: DataFrame) -> DataFrame:
        return df.select(*[_spark_field(n, k) for n, k in self.fields])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        fields = ", ".join(_sql_field(n, k) for n, k in self.fields)
        return oracle(f"select {fields} from ({self.sql.strip()}) result")


CATALOG: dict[str, Query] = {}


def query(key: str, fields: str, build: Callable[[Lake], DataFrame], sql: str | None = None) -> None:
    if key in CATALOG:
        raise ValueError(f"query {key} registered twice")
    parsed = tuple(tuple((f + ":s").split(":")[:2]) for f in fields.split())
    CATALOG[key] = Query(build, parsed, sql)


_LAKES: dict[tuple[str, str], Lake] = {}


def lake_for(spark: SparkSession, sf_dir: str) -> Lake:
    """One Lake per application and directory, so stored tables are built once."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _LAKES:
        _LAKES[key] = Lake(configure(spark), str(sf_dir))
    return _LAKES[key]


def _spark_field(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "f":
        return F.round(c.cast("double"), 6).alias(name)
    if kind == "m":
        return F.round(c.cast("double"), 2).alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    return c.cast("string").alias(name)


def _sql_field(name: str, kind: str) -> str:
    if kind == "i":
        return f"cast({name} as bigint) as {name}"
    if kind == "f":
        return f"round(cast({name} as double), 6) as {name}"
    if kind == "m":
        return f"round(cast({name} as double), 2) as {name}"
    if kind == "b":
        return f"cast({name} as boolean) as {name}"
    return f"cast({name} as varchar) as {name}"
