"""JSON and Avro payloads of keyed messages."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC, HEAD = 0, 5


def _write_long(out: io.BytesIO, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n & ~0x7F:
        out.write(bytes([n & 0x7F | 0x80]))
        n >>= 7
    out.write(bytes([n]))


def _read_long(src: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = src.read(1)[0]
        n |= (b & 0x7F) << shift
        if not b & 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _logical(s: Any) -> str | None:
    return s.get("logicalType") if isinstance(s, dict) else None


def _kind(s: Any) -> Any:
    return s["type"] if isinstance(s, dict) else s


def encode(schema: Any, v: Any, out: io.BytesIO | None = None) -> bytes:
    """The Avro body of a value; dates, times and decimals by their logical types."""
    top, out = out is None, out or io.BytesIO()
    if isinstance(schema, list):
        branch = next(i for i, s in enumerate(schema) if (_kind(s) == "null") == (v is None))
        _write_long(out, branch)
        encode(schema[branch], v, out)
        return out.getvalue() if top else b""
    kind, logical = _kind(schema), _logical(schema)
    if isinstance(kind, (dict, list)):
        encode(kind, v, out)
    elif kind == "record":
        for f in schema["fields"]:
            encode(f["type"], v.get(f["name"], f.get("default")), out)
    elif kind == "array":
        if v:
            _write_long(out, len(v))
            for x in v:
                encode(schema["items"], x, out)
        _write_long(out, 0)
    elif kind == "map":
        if v:
            _write_long(out, len(v))
            for k, x in v.items():
                encode("string", k, out)
                encode(schema["values"], x, out)
        _write_long(out, 0)
    elif kind == "enum":
        _write_long(out, schema["symbols"].index(v))
    elif kind == "boolean":
        out.write(b"\1" if v else b"\0")
    elif kind in ("int", "long"):
        if isinstance(v, datetime):
            at = v if v.tzinfo else v.replace(tzinfo=timezone.utc)
            micros = round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)
            v = micros // 1000 if logical and logical.endswith("millis") else micros
        elif isinstance(v, date):
            v = (v - date(1970, 1, 1)).days
        _write_long(out, int(v))
    elif kind in ("float", "double"):
        out.write(struct.pack("<f" if kind == "float" else "<d", v))
    elif kind in ("bytes", "string", "fixed"):
        if logical == "decimal":
            n = int(Decimal(v).scaleb(schema.get("scale", 0)).to_integral_value())
            v = n.to_bytes(schema.get("size") or (n + (n < 0)).bit_length() // 8 + 1, "big", signed=True)
        data = v.encode() if isinstance(v, str) else bytes(v)
        if kind != "fixed":
            _write_long(out, len(data))
        out.write(data)
    elif kind != "null":
        raise ValueError(f"unknown Avro type {kind!r}")
    return out.getvalue() if top else b""


def decode(schema: Any, src: io.BytesIO | bytes) -> Any:
    src = io.BytesIO(src) if isinstance(src, bytes) else src
    if isinstance(schema, list):
        return decode(schema[_read_long(src)], src)
    kind, logical = _kind(schema), _logical(schema)
    if isinstance(kind, (dict, list)):
        return decode(kind, src)
    if kind == "record":
        return {f["name"]: decode(f["type"], src) for f in schema["fields"]}
    if kind in ("array", "map"):
        items: list[Any] = []
        while n := _read_long(src):
            if n < 0:
                n = -n
                _read_long(src)
            for _ in range(n):
                items.append((decode("string", src), decode(schema["values"], src)) if kind == "map" else decode(schema["items"], src))
        return dict(items) if kind == "map" else items
    if kind == "enum":
        return schema["symbols"][_read_long(src)]
    if kind == "boolean":
        return src.read(1) == b"\1"
    if kind in ("int", "long"):
        n = _read_long(src)
        if logical == "date":
            return date.fromordinal(date(1970, 1, 1).toordinal() + n)
        if logical and "timestamp" in logical:
            return pd.Timestamp(n, unit="ms" if logical.endswith("millis") else "us", tz="UTC").to_pydatetime()
        return n
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", src.read(4 if kind == "float" else 8))[0]
    if kind in ("bytes", "string", "fixed"):
        data = src.read(schema["size"] if kind == "fixed" else _read_long(src))
        if logical == "decimal":
            return Decimal(int.from_bytes(data, "big", signed=True)).scaleb(-schema.get("scale", 0))
        return data.decode() if kind == "string" else data
    if kind == "null":
        return None
    raise ValueError(f"unknown Avro type {kind!r}")


def framed(schema_id: int, body: bytes) -> bytes:
    return bytes([MAGIC]) + schema_id.to_bytes(4, "big") + body


def unframed(message: bytes) -> tuple[int, bytes]:
    if len(message) < HEAD:
        raise ValueError("a message of under five bytes has no schema id")
    if message[0] != MAGIC:
        raise ValueError(f"the first byte is {message[0]}, not {MAGIC}")
    return int.from_bytes(message[1:HEAD], "big"), message[HEAD:]


def json_value(df: DataFrame) -> Column:
    """A row as JSON text, nulls included."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})


def key_value(df: DataFrame, key: str | None) -> Column:
    """A message key: text of the key column; none without one."""
    return F.col(f"`{key}`").cast("string").cast("binary") if key and key in df.columns else F.lit(None).cast("binary")


def from_json_value(df: DataFrame, schema: T.StructType, name: str | None = None) -> DataFrame:
    """Rows of the JSON in column value; a message that is no such object is left out, and counted under name in the query's progress."""
    corrupt = "__corrupt"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = df.withColumn("__row", F.from_json(F.col("value").cast("string"), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    readable = F.col("__row").isNotNull() & F.col(f"__row.{corrupt}").isNull()
    good = (counted_bad(parsed, readable, name) if name else parsed).where(readable)
    return good.select(*(F.col(f"__row.`{f.name}`").alias(f.name) for f in schema.fields), *(c for c in df.columns if c not in ("key", "value") and c not in schema.fieldNames()))


def avro_values(df: DataFrame, schema: str, schema_id: int, key: str | None) -> DataFrame:
    """(key, value) messages of framed Avro, in Arrow batches."""
    parsed = json.loads(schema)
    names = [f["name"] for f in parsed["fields"]]
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    ready = df.select(key_value(df, key).alias("__key"), *(F.to_json(f"`{n}`", {"ignoreNullFields": "false"}).alias(n) if n in nested else F.col(f"`{n}`") for n in names))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            values = [framed(schema_id, encode(parsed, r)) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], names=["key", "value"])

    return ready.mapInArrow(run, "key binary, value binary")


def from_avro_value(df: DataFrame, schemas: dict[int, str], schema: T.StructType) -> DataFrame:
    """Rows of the framed Avro in column value, by the schema that each names; one that can't be read is left out."""
    parsed = {k: json.loads(v) for k, v in schemas.items()}

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for b in batches:
            rows = []
            for v in b.column(0).to_pylist():
                try:
                    number, body = unframed(v or b"")
                    row = decode(parsed[number], body)
                except (ValueError, KeyError, IndexError, StopIteration, struct.error):
                    continue
                rows.append({f: row.get(f) for f in schema.fieldNames()})
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return df.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, schema)


def conformed(df: DataFrame, schema: dict[str, str], defaults: dict[str, Any] | None = None) -> DataFrame:
    """The schema's columns alone, in its order and types; where df has no value the column's default stands, or null."""
    if not schema:
        return df

    def column(name: str, kind: str) -> Column:
        own = F.col(f"`{name}`").try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return F.coalesce(own, F.lit(defaults[name]).cast(kind)) if defaults and name in defaults else own

    return df.select(*(column(n, t).alias(n) for n, t in schema.items()))


def counted_bad(read: DataFrame, good: Column, name: str) -> DataFrame:
    """read, with the numbers of its messages and of those that can't be read in the progress of its query."""
    return read.observe(name, F.count(F.lit(1)).alias("messages"), F.count(F.when(~good, 1)).alias("unreadable"))
