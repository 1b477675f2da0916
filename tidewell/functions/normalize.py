"""Value coercions as column expressions; a null stays null unless defaults are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_int(c: Column) -> Column:
    """Numbers and numeric text, cut to a whole number; other text is 0."""
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint")))


def as_float(c: Column) -> Column:
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("double"), F.lit(0.0)))


def as_bool(c: Column) -> Column:
    return c.cast("string").isin("true", "1")


def as_string(c: Column) -> Column:
    return c.cast("string")


def as_date(c: Column) -> Column:
    """Days since the epoch, or ISO text."""
    return F.coalesce(F.date_from_unix_date(c.try_cast("int")), c.cast("string").try_cast("date"))


def as_timestamp(c: Column, kind: str = "long") -> Column:
    """int: seconds; long, double and numeric text: microseconds; other text: ISO 8601."""
    if kind == "int":
        return F.timestamp_seconds(c)
    if kind in ("long", "bigint", "double"):
        return F.timestamp_micros(c.cast("bigint"))
    return F.coalesce(F.timestamp_micros(c.try_cast("bigint")), c.try_cast("timestamp"))


def as_time(c: Column) -> Column:
    """Microseconds of the day; values of under a day in milliseconds are milliseconds."""
    return F.when((c > 0) & (c < 86_400_000), c * 1000).otherwise(c).cast("bigint")


def as_uuid(c: Column, binary: bool = False) -> Column:
    text = F.lower(F.hex(c)) if binary else F.lower(c)
    return F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5") if binary else text


def as_duration(c: Column) -> Column:
    """Twelve bytes, three little-endian numbers (months, days, milliseconds), as an ISO 8601 period."""

    def number(at: int) -> Column:
        h = F.hex(c)
        swapped = F.concat(*(F.substring(h, at * 8 + 1 + 2 * k, 2) for k in (3, 2, 1, 0)))
        return F.conv(swapped, 16, 10)

    seconds = F.floor(number(2).cast("bigint") / 1000).cast("string")
    return F.when(F.length(c) == 12, F.concat(F.lit("P"), number(0), F.lit("M"), number(1), F.lit("DT"), seconds, F.lit("S")))


def as_decimal(c: Column, precision: int = 38, scale: int = 0) -> Column:
    """Exact, with its sign."""
    return c.try_cast(T.DecimalType(precision, scale))


def as_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def as_bytes(c: Column) -> Column:
    return c.cast("binary")


DEFAULTS = {"string": "''", "int": "0", "bigint": "0L", "double": "0.0D", "float": "cast(0 as float)", "boolean": "false"}


def with_defaults(df: DataFrame) -> DataFrame:
    """Nulls of plain columns as their types' defaults."""
    return df.select(*(F.coalesce(F.col(f"`{n}`"), F.expr(DEFAULTS[t])).alias(n) if t in DEFAULTS else F.col(f"`{n}`") for n, t in df.dtypes))
