"""Topics: tables of messages, bounded or streaming."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.codec import from_avro_value, from_json_value
from tidewell.sources.registry import Registry

MESSAGE = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"


@dataclass
class Topic:
    """Where a topic's rows are: parquet, json or csv files of rows, messages (files of MESSAGE rows), a kafka topic, or a DataFrame.

    values tells whether messages hold JSON, or Avro framed by ids of the topics' registry.
    """

    format: str
    path: str = ""
    schema: T.StructType | None = None
    options: dict[str, str] = field(default_factory=dict)
    frame: DataFrame | None = None
    values: str = "json"


class Topics:
    """Topics by name, read as DataFrames."""

    def __init__(self, spark: SparkSession, known: dict[str, Topic] | None = None, registry: Registry | None = None, brokers: tuple[str, ...] = ()):
        self.spark, self.known, self.registry, self.brokers = spark, dict(known or {}), registry, brokers

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: list[str] | None = None) -> Topics:
        """Parquet tables folder/name.parquet; those that are asked for later need not be named."""
        topics = cls(spark, {n: Topic("parquet", f"{folder}/{n}.parquet") for n in names or ()})
        topics.folder = folder
        return topics

    folder: str | None = None

    def add(self, name: str, topic: Topic | DataFrame) -> None:
        self.known[name] = Topic("frame", frame=topic) if isinstance(topic, DataFrame) else topic

    def _of(self, name: str) -> Topic:
        if name not in self.known and self.folder:
            self.known[name] = Topic("parquet", f"{self.folder}/{name}.parquet")
        return self.known[name]

    def kafka_options(self, name: str, t: Topic) -> dict[str, str]:
        """Options of Spark's Kafka source for a topic."""
        return ({"kafka.bootstrap.servers": ",".join(self.brokers)} if self.brokers else {}) | {"subscribe": t.path or name, "startingOffsets": "earliest"} | t.options

    def _rows(self, name: str, t: Topic, raw: DataFrame) -> DataFrame:
        """Rows of a topic's messages."""
        if t.values == "avro":
            if self.registry is None:
                raise ValueError(f"the Avro topic {name} needs a registry")
            return from_avro_value(raw, self.registry.schemas(), t.schema)
        return from_json_value(raw, t.schema, f"topic-{name}" if raw.isStreaming else None)

    def read(self, name: str) -> DataFrame:
        t = self._of(name)
        if t.frame is not None:
            return t.frame
        if t.format in ("messages", "kafka"):
            raw = self.spark.read.format("kafka").options(**self.kafka_options(name, t)).load() if t.format == "kafka" else self.spark.read.schema(MESSAGE).parquet(t.path)
            return self._rows(name, t, raw)
        reader = self.spark.read.options(**t.options)
        return (reader.schema(t.schema) if t.schema else reader).format(t.format).load(t.path)

    def read_stream(self, name: str) -> DataFrame:
        """The topic as a stream; a file topic's schema is that of its files unless it is given."""
        t = self._of(name)
        if t.frame is not None:
            return t.frame
        if t.format == "kafka":
            return self._rows(name, t, self.spark.readStream.format("kafka").options(**self.kafka_options(name, t)).load())
        if t.format == "messages":
            return self._rows(name, t, self.spark.readStream.schema(MESSAGE).options(**t.options).parquet(t.path))
        schema = t.schema or self.spark.read.options(**t.options).format(t.format).load(t.path).schema
        return self.spark.readStream.schema(schema).options(**t.options).format(t.format).load(t.path)


def dedup_offsets(messages: DataFrame) -> DataFrame:
    """Messages without replays: one for each topic, partition and offset."""
    return messages.dropDuplicates(["topic", "partition", "offset"])


def latest_versions(df: DataFrame, keys: list[str], time_col: str) -> DataFrame:
    """The newest row of each key; of rows of one time the greatest by the other columns."""
    order = [F.col(time_col).desc_nulls_last(), *(F.col(f"`{c}`").desc_nulls_last() for c, t in df.dtypes if c != time_col and not t.startswith("map"))]
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def topic_counts(topics: dict[str, DataFrame]) -> DataFrame:
    """(topic, row_count) of each."""
    frames = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("topic"), "row_count") for n, df in sorted(topics.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
