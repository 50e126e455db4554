"""Point-in-time join against brute force, overlaps and boundaries included."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.facts import disjoint, pit_join

V = "user_id string, user_key string, effective_start_at timestamp, effective_end_at timestamp"


def brute(facts, versions):
    joined = facts.alias("f").join(
        versions.alias("v"),
        (F.col("f.user_id") == F.col("v.user_id")) & (F.col("f.at") >= F.col("effective_start_at"))
        & (F.col("effective_end_at").isNull() | (F.col("f.at") < F.col("effective_end_at"))), "left")
    counts = joined.groupBy("id").agg(F.count("user_key").alias("n"))
    return joined.join(counts, "id").select("id", "user_key", "n")


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_against_brute_force(spark, hot_rows):
    facts = spark.range(400).select(
        F.concat(F.lit("f"), "id").alias("id"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("u"), F.col("id") % 5)).alias("user_id"),
        F.when(F.col("id") % 13 != 0, F.timestamp_seconds(1704067200 + F.pmod(F.hash("id"), F.lit(500_000)))).alias("at"))
    versions = spark.range(60).select(
        F.concat(F.lit("u"), F.col("id") % 5).alias("user_id"), F.concat(F.lit("v"), "id").alias("user_key"),
        F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 5) * 40_000).alias("effective_start_at"),
        # u0 open and overlapping, u1 gaps, u2 empty and inverted ones, u3 and u4 exact chains
        F.when(F.col("id") % 5 == 0, F.when(F.col("id") % 2 == 0, F.timestamp_seconds(1704067200 + F.col("id") * 9_000)))
        .when(F.col("id") % 5 == 1, F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 5) * 40_000 + 15_000))
        .when(F.col("id") % 5 == 2, F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 5) * 40_000 - (F.col("id") % 4 - 1) * 20_000))
        .otherwise(F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 5 + 1) * 40_000))
        .alias("effective_end_at"))
    got = pit_join(facts, versions, "user_id", "at", "id", hot_rows=hot_rows).select(
        "id", "user_key", F.col("user_key_match_count").alias("n"))
    assert rows(got) == rows(brute(facts, versions))
    assert not disjoint(versions, "user_id", hot_rows=hot_rows)


def test_boundary_belongs_to_later_version(make):
    versions = make([("u", "a", "2024-01-01 00:00:00", "2024-01-02 00:00:00"),
                     ("u", "b", "2024-01-02 00:00:00", None)], V)
    facts = make([("1", "u", "2024-01-02 00:00:00"), ("2", "u", "2024-01-01 23:59:59"),
                  ("3", "u", "2023-12-31 00:00:00"), ("4", "x", "2024-01-05 00:00:00")],
                 "id string, user_id string, at timestamp")
    assert disjoint(versions, "user_id")
    got = pit_join(facts, versions, "user_id", "at", "id", disjoint_versions=True)
    assert rows(got, "id", "user_key", "user_key_match_count") == [
        ("1", "b", 1), ("2", "a", 1), ("3", None, 0), ("4", None, 0)]
