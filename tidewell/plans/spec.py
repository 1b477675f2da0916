"""Pipeline definitions: one YAML file each, and application settings."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from pathlib import Path
from typing import Any

import yaml

log = logging.getLogger(__name__)

UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
FORMATS = ("json", "avro", "parquet", "memory")
DEFAULT_TTL = timedelta(hours=1)


class SpecError(ValueError):
    """A definition that can't be run."""


def duration(text: str | int | float | timedelta) -> timedelta:
    """Lengths such as 90s, 1h30m or 7d; a bare 0 is allowed, another bare number is not."""
    if isinstance(text, timedelta):
        return text
    s = str(text).strip()
    if s in ("0", "+0", "-0"):
        return timedelta(0)
    sign = -1 if s.startswith("-") else 1
    body = s.lstrip("+-")
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h|d)", body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise SpecError(f"not a duration: {text!r}")
    return timedelta(seconds=sign * sum(float(a) * UNITS[b] for a, b in parts))


def expanded(text: str, env: Mapping[str, str] | None = None) -> str:
    """text with ${NAME} and ${NAME:-default} replaced from the environment."""
    known = os.environ if env is None else env

    def value(m: re.Match) -> str:
        if m[1] in known:
            return known[m[1]]
        return m[2] if m[2] is not None else ""

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", value, text)


@dataclass(frozen=True)
class Output:
    topic: str
    format: str
    schema: dict[str, str] = field(default_factory=dict)
    key: str | None = None
    #: What a column that the result lacks, or holds no value in, gets.
    defaults: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Emission:
    type: str = "immediate"
    require: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    default_ttl: timedelta = DEFAULT_TTL
    overrides: dict[str, timedelta] = field(default_factory=dict)
    dimensions: tuple[str, ...] = ()
    #: Dimensions whose rows may come after the events that need them.
    streamed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pipeline:
    name: str
    query: str
    output: Output
    emission: Emission = Emission()
    state: State = State()
    window: timedelta | None = None
    #: Event-time column of each topic, timestamp where it names none; dimensions of which only the latest version counts.
    event_time: dict[str, str] = field(default_factory=dict)
    latest: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def ttl(self, topic: str) -> timedelta | None:
        """How long a topic's rows live; None for a dimension, whose rows always do."""
        if topic in self.state.dimensions:
            return None
        return self.state.overrides.get(topic, self.state.default_ttl)

    def time_of(self, topic: str) -> str:
        return self.event_time.get(topic, "timestamp")


def _need(d: Mapping[str, Any], key: str, where: str) -> Any:
    value = d.get(key)
    if value is None or isinstance(value, str) and not value.strip():
        raise SpecError(f"{where}{key} is missing")
    return value


def _schema(raw: Any) -> dict[str, str]:
    """A mapping of names to types, a list of such fields, or a record with fields."""
    if not raw:
        return {}
    fields = raw.get("fields", raw) if isinstance(raw, Mapping) else raw
    if isinstance(fields, Mapping):
        return {str(k): str(v) for k, v in fields.items()}
    return {str(f["name"]): str(f["type"]) for f in fields}


def _defaults(raw: Any) -> dict[str, Any]:
    """Defaults of a schema's fields, where it is a list of fields or a record."""
    fields = raw.get("fields", ()) if isinstance(raw, Mapping) else raw or ()
    return {str(f["name"]): f["default"] for f in fields if isinstance(f, Mapping) and f.get("default") is not None}


def parse_pipeline(text: str, check_query: Callable[[str], Any] | None = None) -> Pipeline:
    """A pipeline from YAML; check_query is called with the query and raises if it can't be planned."""
    raw = yaml.safe_load(expanded(text))
    if not isinstance(raw, Mapping):
        raise SpecError("the file is blank or no mapping")
    name, query, out = _need(raw, "name", ""), _need(raw, "query", ""), raw.get("output") or {}
    output = Output(_need(out, "topic", "output."), str(_need(out, "format", "output.")).lower(), _schema(out.get("schema")), out.get("key"), _defaults(out.get("schema")))
    if output.format not in FORMATS:
        raise SpecError(f"output.format is {output.format!r}, not one of {', '.join(FORMATS)}")
    emission = raw.get("emission") or {}
    kind, require = str(emission.get("type", "immediate")).lower(), tuple(emission.get("require") or ())
    if kind not in ("smart", "immediate"):
        raise SpecError(f"emission.type is {kind!r}")
    state, window = raw.get("state") or {}, raw.get("window")
    events = state.get("events") or {}
    span = duration(window) if window else None
    ttl = duration(events["default_ttl"]) if events.get("default_ttl") else span or DEFAULT_TTL
    dims = state.get("dimensions") or ()
    names = tuple(d["topic"] if isinstance(d, Mapping) else d for d in dims)
    streamed = tuple(d["topic"] for d in dims if isinstance(d, Mapping) and d.get("stream"))
    latest = {d["topic"]: tuple(d["latest"]) for d in dims if isinstance(d, Mapping) and d.get("latest")}
    if check_query:
        check_query(query)
    overrides = {k: duration(v) for k, v in (events.get("overrides") or {}).items()}
    return Pipeline(str(name), query, output, Emission(kind, require), State(ttl, overrides, names, streamed), span, dict(raw.get("event_time") or {}), latest)


def load_pipeline(path: str | Path, check_query: Callable[[str], Any] | None = None) -> Pipeline:
    return parse_pipeline(Path(path).read_text(), check_query)


def load_pipelines(folder: str | Path, check_query: Callable[[str], Any] | None = None) -> list[Pipeline]:
    """All .yaml files under folder; one that can't be loaded is logged and left out."""
    found = []
    for path in sorted(Path(folder).rglob("*.yaml")):
        try:
            found.append(load_pipeline(path, check_query))
        except (SpecError, yaml.YAMLError, OSError, KeyError, TypeError) as e:
            log.warning("%s is left out: %s", path, e)
    return found


@dataclass(frozen=True)
class AppConfig:
    """Settings of a deployment; unknown keys are reported and kept in extra."""

    brokers: tuple[str, ...] = ()
    use_avro: bool = False
    registry: str = ""
    emit_every: timedelta = timedelta(seconds=1)
    state_ttl: timedelta = timedelta(hours=1)
    checkpoint: str = ""
    extra: dict[str, Any] = field(default_factory=dict)

    def spark_conf(self) -> dict[str, str]:
        return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.session.timeZone": "UTC"} | ({"spark.sql.streaming.checkpointLocation": self.checkpoint} if self.checkpoint else {})


def load_config(path: str | Path, env: Mapping[str, str] | None = None) -> AppConfig:
    """Settings from YAML with environment placeholders; a missing file is an error."""
    raw = yaml.safe_load(expanded(Path(path).read_text(), env)) or {}
    kafka, state, emitter = raw.get("kafka") or {}, raw.get("state") or {}, raw.get("emitter") or {}
    brokers = kafka.get("brokers") or ()
    known = {"kafka", "state", "emitter"}
    for key in raw.keys() - known:
        log.warning("setting %s is not used", key)
    return AppConfig(
        tuple(brokers.split(",") if isinstance(brokers, str) else brokers),
        bool(kafka.get("useAvro", False)),
        str(kafka.get("schemaRegistry", "")),
        duration(emitter.get("interval", "1s")),
        duration(state.get("ttl", "1h")),
        str((state.get("checkpoint") or {}).get("path", "")),
        {k: v for k, v in raw.items() if k not in known},
    )
