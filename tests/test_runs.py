"""Pipelines end to end: folders of definitions, messages, settings, streams that wait, expire and resume."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import cli
from tidewell.functions.extensions import register_functions
from tidewell.operators.batch import run_batch, run_sql
from tidewell.plans.spec import AppConfig, Emission, Output, Pipeline, State, load_pipelines, parse_pipeline
from tidewell.sources.registry import Registry
from tidewell.sources.sinks import IdempotentSink, messages, read_table
from tidewell.sources.topics import MESSAGE, Topic, Topics
from tidewell.streaming.metrics import Metrics
from tidewell.streaming.runner import dedup_stream, run_all, run_available, state_rows, stream_result

HOUR = timedelta(hours=1)


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_folder_of_pipelines(spark, tmp_path):
    defs, topics, out = tmp_path / "defs", tmp_path / "topics", tmp_path / "out"
    defs.mkdir()
    (defs / "one.yaml").write_text("{name: one, query: 'SELECT user_id, kind FROM visits', output: {topic: all, format: parquet}}")
    (defs / "two.yaml").write_text("{name: two, query: 'SELECT v.user_id, p.plan FROM visits v LEFT JOIN plans p ON v.user_id = p.user_id', output: {topic: joined, format: json, key: user_id}, emission: {type: smart, require: [plan]}, state: {dimensions: [plans]}}")
    (defs / "three.yaml").write_text("{name: three, query: \"SELECT user_id FROM visits WHERE kind = 'buy'\", output: {topic: bought, format: parquet, schema: [{name: user_id, type: string}, {name: origin, type: string, default: web}]}}")
    (defs / "bad.yaml").write_text("{name: bad, query: 'SELECT FROM', output: {topic: x, format: json}}")
    spark.createDataFrame([("u1", "buy"), ("u2", "look")], "user_id string, kind string").write.parquet(f"{topics}/visits.parquet")
    spark.createDataFrame([("u1", "gold")], "user_id string, plan string").write.parquet(f"{topics}/plans.parquet")
    assert cli.main(["--pipelines", str(defs), "--topics", str(topics), "--out", str(out)]) == 0
    assert spark.read.parquet(f"{out}/all").count() == 2
    assert [(bytes(r.key), json.loads(bytes(r.value))) for r in spark.read.parquet(f"{out}/joined").collect()] == [(b"u1", {"user_id": "u1", "plan": "gold"})]
    assert [tuple(r) for r in spark.read.parquet(f"{out}/bought").collect()] == [("u1", "web")]
    assert len(load_pipelines(defs)) == 4 and not (out / "x").exists()


def test_avro_topics(spark, tmp_path):
    registry, rows = Registry(tmp_path / "r"), spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    sent = messages(rows, Output("in", "avro", key="k"), registry)
    full = sent.selectExpr("key", "value", "'in' as topic", "0 as partition", "0L as offset", "timestamp'2024-01-01' as timestamp")
    bad = spark.createDataFrame([(None, bytearray(b"x"), "in", 0, 1, at(0))], MESSAGE)
    full.unionByName(bad).write.parquet(f"{tmp_path}/in")
    topics = Topics(spark, {"in": Topic("messages", f"{tmp_path}/in", rows.schema, values="avro")}, registry, ("h1:9092", "h2:9092"))
    assert sorted(map(tuple, topics.read("in").collect()), key=str) == [(1, "a"), (2, None)]
    p = Pipeline("p", "SELECT k FROM `in`", Output("o", "parquet"), event_time={"in": "none"})
    run_available(stream_result(spark, p, topics), p, f"{tmp_path}/o", f"{tmp_path}/c")
    assert sorted(r.k for r in read_table(spark, f"{tmp_path}/o").collect()) == [1, 2]
    kafka = topics.kafka_options("in", Topic("kafka", options={"maxOffsetsPerTrigger": "10000"}))
    assert kafka == {"kafka.bootstrap.servers": "h1:9092,h2:9092", "subscribe": "in", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "10000"}
    with pytest.raises(ValueError):
        Topics(spark, {"in": Topic("messages", f"{tmp_path}/in", rows.schema, values="avro")}).read("in")


def test_unreadable_messages_are_counted_and_metrics_kept(spark, tmp_path):
    good = [(None, b'{"k": 1}', "t", 0, i, at(i)) for i in range(3)]
    spark.createDataFrame([*good, (None, b"nonsense", "t", 0, 9, at(9))], MESSAGE).write.parquet(f"{tmp_path}/t")
    topics = Topics(spark, {"t": Topic("messages", f"{tmp_path}/t", T.StructType([T.StructField("k", T.LongType())]))})
    p, metrics = Pipeline("counted", "SELECT k FROM t", Output("o", "memory")), Metrics()
    queries = run_all(spark, [p], topics, f"{tmp_path}/out", config=AppConfig(emit_every=timedelta(milliseconds=50)), metrics=metrics)
    try:
        queries[0].processAllAvailable()
        seen = [q.observedMetrics for q in queries[0].recentProgress if q.observedMetrics]
        assert sum(m["topic-t"]["messages"] for m in seen) == 4 and sum(m["topic-t"]["unreadable"] for m in seen) == 1
        assert spark.table("o").count() == 3
    finally:
        queries[0].stop()
        for _ in range(100):
            if not any(q["running"] for q in metrics.queries.values()):
                break
            import time

            time.sleep(0.1)
        spark.streams.removeListener(metrics)
        spark.catalog.dropTempView("o")
    (own,) = metrics.queries.values()
    assert own["input_rows"] == 4 and metrics.health() and json.loads(metrics.to_json())


def test_a_batch_that_runs_again_leaves_one_copy(spark, tmp_path):
    sink, df = IdempotentSink(Output("o", "parquet"), f"{tmp_path}/o"), spark.range(5)
    for batch in (0, 1, 1, 0):
        sink(df, batch)
    assert read_table(spark, f"{tmp_path}/o").count() == 10


def test_rows_out_of_order_and_too_late(spark, tmp_path):
    """Rows that come late but within the lifetime join; those the watermark has passed don't."""
    schema = "k long, ts timestamp, n long"
    topics = Topics(spark, {n: Topic("parquet", f"{tmp_path}/{n}", spark.createDataFrame([], schema).schema) for n in ("l", "r")})
    p = Pipeline("p", "SELECT l.n AS a, r.n AS b FROM l JOIN r ON l.k = r.k", Output("o", "parquet"), state=State(HOUR), event_time={"l": "ts", "r": "ts"})
    steps = [([(1, at(100), 1)], [(1, at(90), 10)]), ([(1, at(300), 2)], [(1, at(300), 11)]), ([(1, at(70), 3), (1, at(290), 4)], [])]
    for left, right in steps:
        for name, rows in (("l", left), ("r", right)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        run_available(stream_result(spark, p, topics), p, f"{tmp_path}/o", f"{tmp_path}/c")
    # 3 is over an hour behind what came before it; 4 is ten minutes behind
    assert sorted(map(tuple, read_table(spark, f"{tmp_path}/o").collect())) == [(1, 10), (2, 11), (4, 11)]
    assert state_rows(spark, f"{tmp_path}/c", side="left").columns[:2] == ["key", "value"]


def test_smart_emission_waits_for_a_late_dimension_row(spark, tmp_path):
    schemas = {"e": "k long, ts timestamp, n long", "d": "k long, ts timestamp, name string"}
    topics = Topics(spark, {n: Topic("parquet", f"{tmp_path}/{n}", spark.createDataFrame([], s).schema) for n, s in schemas.items()})
    text = "{name: p, query: 'SELECT e.n, d.name FROM e LEFT JOIN d ON e.k = d.k', output: {topic: o, format: parquet}, emission: {type: smart, require: [name]}, state: {events: {default_ttl: 1h}, dimensions: [{topic: d, stream: true}]}, event_time: {e: ts, d: ts}}"
    p = parse_pipeline(text)

    def step(e, d):
        for name, rows in (("e", e), ("d", d)):
            spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        run_available(stream_result(spark, p, topics), p, f"{tmp_path}/o", f"{tmp_path}/c")
        found = sorted(map(tuple, read_table(spark, f"{tmp_path}/o").collect()))
        return found, state_rows(spark, f"{tmp_path}/c", side="left").count()

    assert step([(1, at(0), 10), (2, at(0), 20)], [(9, at(0), "z")]) == ([], 2)  # both wait
    assert step([(1, at(30), 11)], [(1, at(60), "a")])[0] == [(10, "a"), (11, "a")]  # an hour after the first
    got, waiting = step([(9, at(400), 90)], [(2, at(400), "b")])
    assert got == [(10, "a"), (11, "a"), (90, "z")]  # event 20 had expired when its row came, dimension rows never do
    assert step([(1, at(401), 12)], [(8, at(401), "y")]) == ([(10, "a"), (11, "a"), (12, "a"), (90, "z")], 2)  # those before are gone


def test_dedup_state_expires(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, ts timestamp").schema
    p = Pipeline("p", "SELECT 1 FROM x", Output("o", "parquet"))
    for rows in ([(1, at(0)), (1, at(5))], [(2, at(200))], [(1, at(201)), (2, at(199))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/x")
        run_available(dedup_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/x"), ["k"], "ts", "1 hour"), p, f"{tmp_path}/o", f"{tmp_path}/c")
    # key 1 came again after its hour; key 2 within it
    got = sorted((r.k, r.ts.replace(tzinfo=None)) for r in read_table(spark, f"{tmp_path}/o").collect())
    assert got == [(1, at(0)), (1, at(201)), (2, at(200))]


def test_functions_of_a_deployment(spark):
    register_functions(spark, {"tw_double": "(x INT) RETURNS INT RETURN x * 2", "tw_shout": F.pandas_udf(lambda s: s.str.upper(), "string")})
    assert [tuple(r) for r in run_sql(spark, "SELECT tw_double(k) AS k, tw_shout(s) AS s FROM t", lambda t: spark.createDataFrame([(2, "a")], "k int, s string")).collect()] == [(4, "A")]
    with pytest.raises(TypeError):
        register_functions(spark, {"x": 1})


def test_batch_and_defaults(spark):
    p = parse_pipeline("{name: a, query: SELECT k FROM t, output: {topic: o, format: parquet, schema: {fields: [{name: k, type: int}, {name: c, type: string, default: x}]}}}")
    topics = Topics(spark)
    topics.add("t", spark.range(1).selectExpr("id as k"))
    assert [tuple(r) for r in run_batch(spark, p, topics).collect()] == [(0, "x")] and p.emission == Emission()
    with pytest.raises(ValueError):
        Registry("s3a://bucket/x")
