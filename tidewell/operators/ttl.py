"""Lifetimes of keyed rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _updated(df: DataFrame, key: str, time_col: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(time_col).alias("last_seen"))


def expired(df: DataFrame, key: str, time_col: str, now: datetime, ttl: timedelta) -> DataFrame:
    """Keys last seen ttl or longer before now, oldest first: a key of exactly that age has expired."""
    return _updated(df, key, time_col).where(F.col("last_seen") <= F.lit(now - ttl).cast(df.schema[time_col].dataType)).orderBy("last_seen", key)


def alive(df: DataFrame, key: str, time_col: str, now: datetime, ttl: timedelta) -> DataFrame:
    """Keys whose age at now is less than ttl."""
    return _updated(df, key, time_col).where(F.col("last_seen") > F.lit(now - ttl).cast(df.schema[time_col].dataType))


def removed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows without those of the given keys."""
    return df.join(keys.select(key), key, "left_anti")
