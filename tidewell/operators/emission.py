"""Emission: which result rows leave a pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.plans.spec import Emission, SpecError


def complete(columns: list[str]) -> Column:
    """True where every named column holds a value."""
    return reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in columns), F.lit(True))


def check_required(columns: list[str], emission: Emission) -> None:
    if missing := [c for c in emission.require if c not in columns]:
        raise SpecError(f"emission.require names {', '.join(missing)}, which the query doesn't return")


def emitted(df: DataFrame, emission: Emission) -> DataFrame:
    """smart: rows whose required output columns are all there; immediate: every row."""
    check_required(df.columns, emission)
    return df.where(complete(list(emission.require))) if emission.type == "smart" and emission.require else df
