from datetime import timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewell.plans.spec import SpecError, duration, expanded, load_config, load_pipelines, parse_pipeline

FULL = """
name: enrich
window: 1h
query: SELECT u.user_id FROM users u LEFT JOIN events e ON u.user_id = e.user_id
output: {topic: out, format: json, key: user_id, schema: [{name: user_id, type: string}]}
emission: {type: smart, require: [user_id]}
state:
  events: {default_ttl: 30m, overrides: {events: 2h}}
  dimensions: [users]
"""


def test_full_pipeline():
    p = parse_pipeline(FULL)
    assert p.ttl("users") is None and p.ttl("events") == timedelta(hours=2) and p.ttl("x") == timedelta(minutes=30)
    assert p.output.schema == {"user_id": "string"} and p.emission.require == ("user_id",)


def test_defaults_and_window():
    p = parse_pipeline("{name: a, query: SELECT 1 FROM t, output: {topic: o, format: json}}")
    assert p.emission.type == "immediate" and p.ttl("t") == timedelta(hours=1)
    assert parse_pipeline("{name: a, window: 2h, query: SELECT 1 FROM t, output: {topic: o, format: json}}").ttl("t") == timedelta(hours=2)


@pytest.mark.parametrize("text", ["", "{query: q, output: {topic: o, format: json}}", "{name: a, output: {topic: o, format: json}}", "{name: a, query: q, output: {format: json}}", "{name: a, query: q, output: {topic: o}}", "{name: a, query: q, output: {topic: o, format: xml}}", "{name: a, query: q, output: {topic: o, format: json}, emission: {type: later}}"])
def test_rejected(text):
    with pytest.raises(SpecError):
        parse_pipeline(text)


@given(st.integers(0, 400), st.integers(0, 23), st.integers(0, 59), st.integers(0, 59))
def test_durations_add_up(d, h, m, s):
    assert duration(f"{d}d{h}h{m}m{s}s") == timedelta(days=d, hours=h, minutes=m, seconds=s)


def test_durations():
    assert duration("7d") == timedelta(days=7) and duration("1.5h") == timedelta(minutes=90) and duration("0") == timedelta(0) and duration("-5m") == timedelta(minutes=-5)
    for bad in ("", "5", "1w", "h", "1h x"):
        with pytest.raises(SpecError):
            duration(bad)


def test_environment_and_config(tmp_path):
    assert expanded("${A}-${B:-b}-${C}", {"A": "1"}) == "1-b-"
    (tmp_path / "c.yaml").write_text("kafka: {brokers: '${HOSTS:-a,b}', useAvro: true}\nlogging: {level: x}\n")
    c = load_config(tmp_path / "c.yaml", {})
    assert c.brokers == ("a", "b") and c.use_avro and c.emit_every == timedelta(seconds=1) and "logging" in c.extra
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")


def test_folder_leaves_out_bad_files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.yaml").write_text(FULL)
    (tmp_path / "b.yaml").write_text("name: only")
    (tmp_path / "c.txt").write_text(FULL)
    assert [p.name for p in load_pipelines(tmp_path)] == ["enrich"]
