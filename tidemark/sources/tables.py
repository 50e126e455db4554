"""Declared schemas of the given parquet tables and their reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The files hold zone-less timestamps; they are read as UTC instants.
TABLE_DDL = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double,"
    " props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one given table with its declared schema (no inference job)."""
    return spark.read.schema(TABLE_DDL[name]).parquet(f"{sf_dir}/{name}.parquet")
