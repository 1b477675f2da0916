import math
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell import catalogue
from tidewell.operators import ttl

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_check(spark, duck, name):
    got = catalogue.QUERIES[name](spark, D)
    columns = sorted(got.columns)
    rel = duck.execute(catalogue.ORACLE[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_lifetimes(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [("a", now - timedelta(hours=2)), ("b", now - timedelta(hours=1)), ("c", now - timedelta(minutes=30)), ("d", now - timedelta(minutes=90)), ("a", now - timedelta(hours=3))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    gone = ttl.expired(df, "k", "ts", now, timedelta(minutes=90))
    # the oldest first; a row of exactly the lifetime's age has expired
    assert [r.k for r in gone.collect()] == ["a", "d"] and {r.k for r in ttl.alive(df, "k", "ts", now, timedelta(minutes=90)).collect()} == {"b", "c"}
    assert ttl.removed(df, "k", gone).count() == 2
