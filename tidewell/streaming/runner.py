"""Pipelines as streaming queries."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.batch import run_sql
from tidewell.operators.emission import check_required, emitted
from tidewell.plans.planner import Planner
from tidewell.plans.spec import AppConfig, Pipeline, SpecError
from tidewell.sources.codec import conformed
from tidewell.sources.registry import Registry
from tidewell.sources.sinks import IdempotentSink
from tidewell.sources.topics import Topics, latest_versions
from tidewell.streaming.metrics import Metrics


def stream_result(spark: SparkSession, p: Pipeline, topics: Topics, streaming: set[str] | None = None, output_mode: str = "append") -> DataFrame:
    """A pipeline's result as a stream.

    Event topics are streams with a watermark of their own, their lifetime late; joins of two of them are bounded by
    their lifetimes. Dimensions are read as tables, anew for each micro-batch, and never expire; a small
    one is broadcast where Spark's size estimate allows it. streaming names the topics to stream, unless given all events and,
    where emission is smart, the dimensions that the pipeline streams: an event then waits its lifetime for the
    dimension's row, and leaves when its required columns are there.
    """
    planner = Planner(spark)
    plan = planner.plan(planner.any_to_contains(p.query))
    events = {t for t in plan.tables if p.ttl(t) is not None}
    late = set(p.state.streamed) if p.emission.type == "smart" else set()
    streaming = events | late & set(plan.tables) if streaming is None else streaming
    if not streaming & set(plan.tables):
        raise SpecError("no topic of the query is a stream")
    if plan.aggregates and output_mode == "append" and "window(" not in p.query.lower():
        raise SpecError("an aggregate without a window can't be appended; use output mode update or complete")

    def read(topic: str) -> DataFrame:
        if topic not in streaming:
            df = topics.read(topic)
            return latest_versions(df, list(p.latest[topic]), p.time_of(topic)) if topic in p.latest else df
        df, at = topics.read_stream(topic), p.time_of(topic)
        if at not in df.columns:
            return df
        ttl = p.ttl(topic) or p.state.default_ttl
        return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{ttl.total_seconds():.3f} seconds" if ttl else "0 seconds")

    sql = planner.bounded(p.query, p.ttl, p.time_of, frozenset(t for t in streaming if p.ttl(t) is None))
    out = run_sql(spark, sql, read)
    check_required(out.columns, p.emission)
    return conformed(emitted(out, p.emission), p.output.schema, p.output.defaults)


def dedup_stream(df: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """A stream without rows whose keys came before within delay of event time."""
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def start(
    df: DataFrame, p: Pipeline, path: str, checkpoint: str, registry: Registry | None = None, interval: str | None = "10 seconds", output_mode: str = "append", brokers: tuple[str, ...] = ()
) -> StreamingQuery:
    """Start the query: micro-batches go to path, progress to checkpoint; interval None takes what there is and ends."""
    writer = df.writeStream.queryName(f"{p.name}-{uuid.uuid4().hex[:6]}").outputMode(output_mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.foreachBatch(IdempotentSink(p.output, path, registry, brokers, df.sparkSession)).start()


def run_available(df: DataFrame, p: Pipeline, path: str, checkpoint: str, registry: Registry | None = None, output_mode: str = "append") -> None:
    """Process all that the topics hold, and end."""
    start(df, p, path, checkpoint, registry, None, output_mode).awaitTermination()


def run_all(spark: SparkSession, pipelines: list[Pipeline], topics: Topics, base: str, registry: Registry | None = None, config: AppConfig | None = None, metrics: Metrics | None = None) -> list[StreamingQuery]:
    """Start every pipeline, each with its own output and checkpoint under base.

    Of config the brokers take messages, and emit_every is the time between micro-batches; a topic's rate is bounded by its
    own options (maxOffsetsPerTrigger, maxFilesPerTrigger), which bound a batch's rows. metrics gets each query's progress.
    """
    config = config or AppConfig()
    if metrics is not None:
        spark.streams.addListener(metrics)
    every = f"{config.emit_every.total_seconds():.3f} seconds"
    return [start(stream_result(spark, p, topics), p, f"{base}/{p.output.topic}", f"{base}/_checkpoints/{Path(p.name).name}", registry, every, brokers=config.brokers) for p in pipelines]


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0, side: str | None = None) -> DataFrame:
    """The keys and values that a query's stateful operator holds, from its checkpoint; of a join those of side left or right."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    return (reader.option("joinSide", side) if side else reader).load(checkpoint)
