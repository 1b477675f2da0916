import io
import json
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.faker import generated, register
from tidewell.functions import normalize as N
from tidewell.functions.types import Catalog, canonical, differs, from_avro, infer, table_schema, to_avro
from tidewell.plans.spec import Output
from tidewell.sources.codec import conformed, decode, encode, framed, from_avro_value, from_json_value, json_value, unframed
from tidewell.sources.registry import Registry
from tidewell.sources.sinks import messages
from tidewell.sources.topics import dedup_offsets


def test_avro_types():
    d = {"type": "bytes", "logicalType": "decimal", "precision": 10, "scale": 2}
    assert from_avro(d) == T.DecimalType(10, 2) and from_avro(["null", "long"]) == T.LongType()
    assert from_avro({"type": "long", "logicalType": "timestamp-millis"}) == T.TimestampType()
    assert from_avro({"type": "string", "logicalType": "uuid"}) == T.StringType() and from_avro(["null"]) == T.StringType()
    assert from_avro({"type": "array", "items": "int"}) == T.ArrayType(T.IntegerType())
    assert from_avro({"type": "bytes", "connect.name": "x.Decimal", "connect.parameters": {"scale": "3", "connect.decimal.precision": "8"}}) == T.DecimalType(8, 3)
    with pytest.raises(ValueError):
        table_schema('"string"')
    s = T.StructType([T.StructField("t", T.TimestampType()), T.StructField("a", T.ArrayType(T.LongType()))])
    assert [f["type"][1] for f in to_avro(s)["fields"]] == [{"type": "long", "logicalType": "timestamp-micros"}, "string"]
    assert to_avro(s, compat=True)["fields"][0]["type"][1]["logicalType"] == "time-micros"


def test_canonical_and_inference():
    a = '{"type":"record","name":"R","fields":[{"name":"b","type":["null","int"]},{"name":"a","type":"int"}]}'
    b = '{"name":"R","type":"record","fields":[{"type":"int","name":"a"},{"type":["int","null"],"name":"b"}]}'
    assert canonical(a) == canonical(b) and canonical(canonical(a)) == canonical(a)
    with pytest.raises(ValueError):
        canonical('{"a":1,}')
    got = infer({"id": 1, "x": 25.0, "y": -0.75, "t": "2024-01-01T00:00:00Z", "s": "a", "n": None, "l": [1], "m": {}, "b": b"", "f": True})
    assert got == {"b": "bytes", "f": "bool", "id": "int", "l": "array", "m": "map", "n": "null", "s": "string", "t": "timestamp", "x": "int", "y": "float"} and list(got) == sorted(got)
    assert not differs({"a": "int", "b": "int"}, {"b": "int", "a": "int"}) and differs({"a": "int"}, {"a": "long"})
    c = Catalog()
    assert c.schema("t") == {} and c.update("t", {"a": "int"}) and not c.update("t", {"a": "int"})


@given(st.integers(-(1 << 63), (1 << 63) - 1), st.text(), st.binary(), st.none() | st.booleans(), st.decimals(allow_nan=False, allow_infinity=False, places=2, min_value=-10**9, max_value=10**9))
def test_avro_round_trip(n, s, b, o, d):
    schema = {"type": "record", "name": "R", "fields": [{"name": "n", "type": "long"}, {"name": "s", "type": "string"}, {"name": "b", "type": "bytes"}, {"name": "o", "type": ["null", "boolean"]}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 12, "scale": 2}}, {"name": "l", "type": {"type": "array", "items": "string"}}, {"name": "m", "type": {"type": "map", "values": "long"}}]}
    row = {"n": n, "s": s, "b": b, "o": o, "d": d, "l": [s], "m": {s: n}}
    assert decode(schema, io.BytesIO(encode(schema, row))) == row


def test_frames_and_times():
    assert unframed(framed(258, b"x")) == (258, b"x")
    for bad in (b"", b"\0\0", b"\1\0\0\0\1x"):
        with pytest.raises(ValueError):
            unframed(bad)
    t = {"type": "long", "logicalType": "timestamp-micros"}
    at = datetime(2024, 2, 29, 1, 2, 3, 4, tzinfo=timezone.utc)
    assert decode(t, encode(t, at)) == at and decode({"type": "int", "logicalType": "date"}, encode({"type": "int", "logicalType": "date"}, date(1969, 1, 1))) == date(1969, 1, 1)


def test_registry(tmp_path):
    r = Registry(tmp_path)
    a, b = '{"type":"record","name":"V","fields":[{"name":"a","type":"int"}]}', '{"type":"record","name":"V","fields":[{"name":"b","type":"int"}]}'
    assert r.create_if_absent("t-value", a) == 1 and r.create_if_absent("t-value", a) == 1
    assert r.create_if_absent("t-value", b) == 1 and r.create_if_absent("u-value", b) == 2 and r.by_id(2) == b and r.latest("none") is None


def test_messages_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", Decimal("-1.50"), [1, 2]), (2, None, None, None)], "k long, s string, d decimal(10,2), l array<int>")
    r = Registry(tmp_path)
    sent = messages(df, Output("o", "avro", key="k"), r)
    assert sorted(bytes(x.key) for x in sent.collect()) == [b"1", b"2"]
    schema = T.StructType([*df.schema.fields[:3], T.StructField("l", T.StringType())])
    back = from_avro_value(sent.union(spark.createDataFrame([(None, bytearray(b"\1bad"))], "key binary, value binary")), {1: r.by_id(1)}, schema)
    assert sorted(map(tuple, back.collect())) == [(1, "a", Decimal("-1.50"), "[1,2]"), (2, None, None, None)]
    js = df.select(json_value(df).alias("value")).union(spark.createDataFrame([("nonsense",)], "value string"))
    assert sorted(from_json_value(js, df.schema).collect()) == sorted(df.collect())
    assert [tuple(x) for x in conformed(df, {"z": "int", "k": "string"}).collect()] == [(None, "1"), (None, "2")]
    assert [tuple(x) for x in conformed(df, {"z": "int", "s": "string"}, {"z": 7, "s": "none"}).collect()] == [(7, "a"), (7, "none")]


def test_coercions(spark):
    def one(c):
        return spark.range(1).select(c.alias("c")).first().c

    assert [one(N.as_int(F.lit(v))) for v in ("7", "3.9", "x")] == [7, 3, 0] and one(N.as_int(F.lit(None).cast("string"))) is None
    assert one(N.as_float(F.lit("x"))) == 0.0 and one(N.as_bool(F.lit("1"))) and not one(N.as_bool(F.lit("yes")))
    assert one(N.as_time(F.lit(1000))) == 1_000_000 and one(N.as_time(F.lit(86_400_000))) == 86_400_000
    assert one(N.as_uuid(F.unhex(F.lit("00112233445566778899AABBCCDDEEFF")), True)) == "00112233-4455-6677-8899-aabbccddeeff"
    assert one(N.as_duration(F.unhex(F.lit("0100000002000000DC050000")))) == "P1M2DT1S"
    assert one(N.as_decimal(F.lit("-12.345"), 10, 2)) == Decimal("-12.35") and one(N.as_date(F.lit("1"))) == date(1970, 1, 2)


def test_dedup_and_faker(spark, tmp_path):
    m = spark.createDataFrame([("t", 0, 1), ("t", 0, 1), ("t", 0, 2)], "topic string, partition int, offset long")
    assert dedup_offsets(m).count() == 2
    topics = generated(spark, 100)
    assert topics["user_events"].count() == 100 and topics["user_profiles"].count() == 50
    assert register(Registry(tmp_path), topics) == register(Registry(tmp_path), topics)
    assert json.loads(Registry(tmp_path).by_id(1))["name"] == "Value"
