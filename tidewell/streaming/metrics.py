"""Progress of running queries."""

from __future__ import annotations

import json
from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Rows and batches of each query, and whether it runs; add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.queries: dict[str, dict[str, Any]] = defaultdict(lambda: {"batches": 0, "input_rows": 0, "batch_ms": 0, "running": True, "error": None})

    def onQueryStarted(self, event: Any) -> None:
        self.queries[str(event.runId)]["name"] = event.name

    def onQueryProgress(self, event: Any) -> None:
        q, p = self.queries[str(event.progress.runId)], event.progress
        q["batches"] += 1
        q["input_rows"] += p.numInputRows
        q["batch_ms"] += p.batchDuration
        q["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        q = self.queries[str(event.runId)]
        q["running"], q["error"] = False, event.exception

    def health(self) -> bool:
        return all(q["error"] is None for q in self.queries.values())

    def to_json(self) -> str:
        return json.dumps(self.queries, default=str)


def observed(df: DataFrame, name: str) -> DataFrame:
    """df with a count of its rows in the progress of its query."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
