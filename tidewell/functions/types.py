"""Avro schemas and Spark types, inference and comparison of schemas."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import types as T

PLAIN = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "null": T.StringType(), "enum": T.StringType(), "fixed": T.BinaryType()}
LOGICAL = {"uuid": T.StringType(), "date": T.DateType()} | dict.fromkeys(("time-millis", "time-micros"), T.LongType()) | dict.fromkeys(("timestamp-millis", "timestamp-micros", "local-timestamp-millis", "local-timestamp-micros"), T.TimestampType())
#: Names that change-data connectors give to plain types.
CONNECT = {"Date": T.DateType(), "Time": T.LongType(), "MicroTime": T.LongType(), "Timestamp": T.TimestampType(), "MicroTimestamp": T.TimestampType(), "ZonedTimestamp": T.TimestampType()}


def from_avro(schema: Any) -> T.DataType:
    """The Spark type of an Avro schema; a union is its first branch that isn't null."""
    if isinstance(schema, list):
        return from_avro(next((s for s in schema if s not in ("null", {"type": "null"})), "string"))
    if isinstance(schema, str):
        return PLAIN.get(schema, T.StringType())
    kind, logical = schema.get("type"), schema.get("logicalType")
    if logical == "decimal" or str(schema.get("connect.name", "")).endswith(".Decimal"):
        p = schema.get("connect.parameters") or {}
        return T.DecimalType(int(schema.get("precision", p.get("connect.decimal.precision", 38))), int(schema.get("scale", p.get("scale", 0))))
    if logical == "duration":
        return T.StringType()
    if logical in LOGICAL:
        return LOGICAL[logical]
    if (name := str(schema.get("connect.name", "")).rpartition(".")[2]) in CONNECT:
        return CONNECT[name]
    if kind == "array":
        return T.ArrayType(from_avro(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), from_avro(schema["values"]))
    if kind == "record":
        return T.StructType([T.StructField(f["name"], from_avro(f["type"]), True) for f in schema["fields"]])
    return from_avro(kind) if isinstance(kind, (dict, list)) else PLAIN.get(kind, T.StringType())


def table_schema(schema: str | Mapping[str, Any]) -> T.StructType:
    found = from_avro(json.loads(schema) if isinstance(schema, str) else schema)
    if not isinstance(found, T.StructType):
        raise ValueError("only a record is a table")
    return found


def _avro_type(t: T.DataType, compat: bool) -> Any:
    if isinstance(t, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": t.precision, "scale": t.scale}
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "long", "logicalType": "time-micros" if compat else "timestamp-micros"}
    if isinstance(t, T.DateType):
        return {"type": "int", "logicalType": "date"}
    for kinds, name in (((T.BooleanType,), "boolean"), ((T.ByteType, T.ShortType, T.IntegerType), "int"), ((T.LongType,), "long"), ((T.FloatType,), "float"), ((T.DoubleType,), "double"), ((T.BinaryType,), "bytes")):
        if isinstance(t, kinds):
            return name
    if t.typeName().startswith("time("):
        return {"type": "long", "logicalType": "time-micros"}
    return "string"  # nested values travel as JSON text


def to_avro(schema: T.StructType, name: str = "Value", compat: bool = False) -> dict[str, Any]:
    """A record of nullable fields; compat declares timestamps as times of day."""
    return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", _avro_type(f.dataType, compat)], "default": None} for f in schema.fields]}


def canonical(schema: str | Any) -> str:
    """One text for schemas that differ in the order of keys, of record fields or of union members only."""

    def order(x: Any) -> Any:
        if isinstance(x, Mapping):
            x = {k: order(v) for k, v in x.items()}
            if isinstance(x.get("fields"), list):
                x["fields"] = sorted(x["fields"], key=lambda f: str(f.get("name")))
            return x
        return sorted((order(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True)) if isinstance(x, list) else x

    return json.dumps(order(json.loads(schema) if isinstance(schema, str) else schema), sort_keys=True, separators=(",", ":"))


RFC3339 = re.compile(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")


def infer(record: Mapping[str, Any]) -> dict[str, str]:
    """Names, in order of the alphabet, and kinds of a record's values."""

    def kind(v: Any) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "bool"
        if isinstance(v, int):
            return "int"
        if isinstance(v, float):
            return "int" if v.is_integer() else "float"
        if isinstance(v, str):
            return "timestamp" if RFC3339.match(v) else "string"
        if isinstance(v, (bytes, bytearray)):
            return "bytes"
        if isinstance(v, datetime):
            return "timestamp"
        if isinstance(v, (list, tuple)):
            return "array"
        return "map" if isinstance(v, Mapping) else "struct"

    return {k: kind(record[k]) for k in sorted(record)}


def differs(a: Mapping[str, str], b: Mapping[str, str]) -> bool:
    """Whether two schemas have other names or types; order doesn't matter."""
    return dict(a) != dict(b)


class Catalog:
    """Schemas of tables by name; an unknown table has none."""

    def __init__(self) -> None:
        self.known: dict[str, dict[str, str]] = {}

    def update(self, table: str, schema: Mapping[str, str]) -> bool:
        changed = differs(self.known.get(table, {}), schema)
        self.known[table] = dict(schema)
        return changed

    def schema(self, table: str) -> dict[str, str]:
        return self.known.get(table, {})
