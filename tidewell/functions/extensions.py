"""Functions that a deployment adds to its pipelines' SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession


def register_functions(spark: SparkSession, functions: Mapping[str, Any]) -> None:
    """Make functions callable by name in queries: SQL text `(x INT) RETURNS INT RETURN x + 1`, or a (Pandas) UDF.

    A SQL function is part of the plan and costs no Python; a UDF runs in Arrow batches if it is a Pandas UDF.
    """
    for name, body in functions.items():
        if isinstance(body, str):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
        elif isinstance(body, Callable):
            spark.udf.register(name, body)
        else:
            raise TypeError(f"{name} is neither SQL text nor a function")
