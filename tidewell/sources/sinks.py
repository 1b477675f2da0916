"""Where results go: keyed JSON or Avro messages, Parquet tables, memory tables, kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.types import to_avro
from tidewell.plans.planner import view_name
from tidewell.plans.spec import Output
from tidewell.sources.codec import avro_values, json_value, key_value
from tidewell.sources.registry import Registry


def messages(df: DataFrame, output: Output, registry: Registry | None = None) -> DataFrame:
    """(key, value) messages of a result in the output's format."""
    if output.format == "avro":
        if registry is None:
            raise ValueError("avro output needs a registry")
        import json

        schema = json.dumps(to_avro(df.schema))
        number = registry.create_if_absent(f"{output.topic}-value", schema)
        return avro_values(df, registry.by_id(number), number, output.key)
    return df.select(key_value(df, output.key).alias("key"), json_value(df).cast("binary").alias("value"))


def write_batch(df: DataFrame, output: Output, path: str, registry: Registry | None = None, mode: str = "append") -> None:
    """A bounded result as a table (parquet), as messages under path, or as a view (memory)."""
    if output.format == "memory":
        memory_table(df, output.topic)
        return
    (df if output.format == "parquet" else messages(df, output, registry)).write.mode(mode).parquet(path)


class IdempotentSink:
    """foreachBatch writer: each micro-batch replaces its own folder, so a batch that runs again leaves one copy.

    A memory output is a table of the session instead, and with brokers messages go to the output's Kafka topic, at
    least once, keyed, so that a consumer can tell copies.
    """

    def __init__(self, output: Output, path: str, registry: Registry | None = None, brokers: tuple[str, ...] = (), spark: SparkSession | None = None):
        self.output, self.path, self.registry, self.brokers, self.spark = output, path, registry, brokers, spark
        self.done: set[int] = set()

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        if self.output.format == "memory":
            if batch_id not in self.done:
                memory_table(df, self.output.topic, self.spark)
            self.done.add(batch_id)
        elif self.brokers and self.output.format in ("json", "avro"):
            kafka_writer(df, self.output, ",".join(self.brokers), self.registry).save()
        else:
            write_batch(df, self.output, f"{self.path}/batch={batch_id}", self.registry, "overwrite")


def memory_table(df: DataFrame, name: str, spark: SparkSession | None = None) -> None:
    """Append df to the session's view of that name, its rows held by the driver: for trials with small results.

    A micro-batch has a session of its own, so the one that started the query is named.
    """
    spark, view = spark or df.sparkSession, view_name(name)
    rows = spark.createDataFrame(df.collect(), df.schema)
    (spark.table(view).unionByName(rows) if spark.catalog.tableExists(view) else rows).createOrReplaceTempView(view)


def read_table(spark, path: str) -> DataFrame:
    """What an IdempotentSink wrote."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def kafka_writer(df: DataFrame, output: Output, brokers: str, registry: Registry | None = None):
    return messages(df, output, registry).withColumn("topic", F.lit(output.topic)).write.format("kafka").option("kafka.bootstrap.servers", brokers)
