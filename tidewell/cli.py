"""python -m tidewell.cli: run the pipelines of a folder over a folder of Parquet topics."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from tidewell.operators.batch import run_batch
from tidewell.plans.planner import Planner
from tidewell.plans.spec import AppConfig, load_config, load_pipelines
from tidewell.sources.registry import Registry
from tidewell.sources.sinks import write_batch
from tidewell.sources.topics import Topics
from tidewell.streaming.metrics import Metrics
from tidewell.streaming.runner import run_all


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--pipelines", default="pipelines")
    a.add_argument("--config")
    a.add_argument("--topics", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--registry")
    a.add_argument("--mode", choices=("batch", "stream"), default="batch")
    o = a.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    config = load_config(o.config) if o.config else AppConfig()
    spark = SparkSession.builder.config(map=config.spark_conf()).getOrCreate()
    pipelines = load_pipelines(o.pipelines, Planner(spark).plan)
    folder = o.registry or (config.registry if config.registry and "://" not in config.registry else None)
    topics, registry = Topics.of_folder(spark, o.topics), Registry(folder) if folder else None
    topics.registry, topics.brokers = registry, config.brokers
    if config.use_avro:  # messages are Avro wherever a pipeline says JSON
        pipelines = [replace(p, output=replace(p.output, format="avro")) if p.output.format == "json" else p for p in pipelines]
    if o.mode == "batch":
        for p in pipelines:
            write_batch(run_batch(spark, p, topics), p.output, f"{o.out}/{p.output.topic}", registry, "overwrite")
    else:
        metrics = Metrics()
        if run_all(spark, pipelines, topics, o.out, registry, config, metrics):
            try:
                spark.streams.awaitAnyTermination()
            finally:
                logging.getLogger(__name__).info("queries: %s", metrics.to_json())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
