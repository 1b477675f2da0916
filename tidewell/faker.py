"""Made-up topics for trials: user events, profiles and transactions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.types import to_avro
from tidewell.sources.registry import Registry

START = "2024-01-01 00:00:00"


def generated(spark: SparkSession, rows: int, users: int = 50, seed: int = 42) -> dict[str, DataFrame]:
    """Bounded topics: the same seed gives the same rows, however many partitions there are."""
    user = F.concat(F.lit("u"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(users)) + 1).cast("string"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col("id"))
    base = spark.range(rows)
    return {
        "user_events": base.select(user.alias("user_id"), F.lit("login").alias("event_type"), at.alias("event_time")),
        "user_profiles": spark.range(users).select(F.concat(F.lit("u"), (F.col("id") + 1).cast("string")).alias("user_id"), F.lit("premium").alias("plan")),
        "transactions": base.select(user.alias("user_id"), (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(10_000)) / 100).alias("amount"), at.alias("event_time")),
    }


def streaming(spark: SparkSession, rows_per_second: int = 1, users: int = 50) -> DataFrame:
    """An unbounded user_events topic."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.concat(F.lit("u"), (F.pmod("value", F.lit(users)) + 1).cast("string")).alias("user_id"), F.lit("login").alias("event_type"), F.col("timestamp").alias("event_time"))


def register(registry: Registry, topics: dict[str, DataFrame]) -> dict[str, int]:
    """Register the topics' schemas; one that is there already is kept."""
    return {n: registry.create_if_absent(f"{n}-value", json.dumps(to_avro(df.schema))) for n, df in topics.items()}
