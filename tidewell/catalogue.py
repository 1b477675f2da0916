"""Registered queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import normalize as N
from tidewell.operators import ttl as lifetimes
from tidewell.operators.batch import run_batch, run_sql
from tidewell.plans.spec import Emission, Output, Pipeline, State
from tidewell.sources.codec import avro_values, from_avro_value, json_value, key_value
from tidewell.sources.topics import Topics, dedup_offsets, latest_versions, topic_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FLAGSHIP = """
SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id, o.o_totalprice AS amount,
       c.c_mktsegment AS user_segment, n.n_name AS user_country,
       CASE WHEN c.c_acctbal IS NULL OR c.c_acctbal <= 0 THEN 'no cover'
            WHEN o.o_totalprice <= c.c_acctbal * 25 THEN 'covered'
            ELSE 'beyond cover' END AS cover
FROM orders o
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_totalprice > 100000"""

#: Queries whose text is the same for both engines.
SAME = {
    "project_star": "SELECT * FROM events",
    "project_alias": "SELECT e.event_id AS id, e.user_id AS who, e.event_type AS what FROM events e",
    "project_table_star": "SELECT n.* FROM nation n",
    "filter_amount": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'",
    "filter_in": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')",
    "filter_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_tax >= 0.04",
    "filter_and_or": "SELECT event_id FROM events WHERE (event_type = 'click' OR value > 90) AND user_id != 7",
    "sql_comments": "SELECT event_id -- the id\nFROM events /* all */ WHERE event_type = 'error'",
    "literals": "SELECT event_id, true AS flag, 'x' AS word, CAST(1.5 AS DOUBLE) AS num FROM events",
    "left_join_enrich": "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey",
    "inner_join_enrich": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0",
    "right_join": "SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o RIGHT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o.o_custkey = c.c_custkey",
    "full_join": "SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o.o_custkey = c.c_custkey",
    "star_join_two_dims": "SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey",
    "star_join_same_left_key": "SELECT o.o_orderkey AS order_id, c.c_name AS c_name, x.event_id AS event_id FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN events x ON o.o_custkey = x.user_id AND x.event_type = 'signup' WHERE o.o_totalprice > 140000",
    "star_join_three": "SELECT l.l_orderkey, l.l_linenumber, p.p_brand, s.s_name, o.o_orderstatus FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 40",
    "composite_key_join": "SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_orderkey, l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey",
    "self_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "using_join": "SELECT l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey)",
    "natural_join": "SELECT l_orderkey, a.n1, b.n2 FROM (SELECT l_orderkey, l_quantity AS n1 FROM lineitem WHERE l_linenumber = 1) a NATURAL JOIN (SELECT l_orderkey, l_quantity AS n2 FROM lineitem WHERE l_linenumber = 2) b",
    "comma_join": "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000",
    "residual_join": "SELECT o.o_orderkey, c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20",
    "or_join": "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey OR s.s_suppkey = n.n_nationkey",
    "null_key_join": "SELECT a.event_id, b.n_name FROM (SELECT event_id, NULLIF(user_id % 25, 0) AS k FROM events WHERE event_type = 'click') a LEFT JOIN (SELECT n_name, NULLIF(n_nationkey, 0) AS k FROM nation) b ON a.k = b.k",
    "semi_join": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "anti_join": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "case_risk_flags": FLAGSHIP,
    "cross_border_flag": "SELECT o.o_orderkey, CASE WHEN c.c_nationkey != s.n_nationkey THEN 'cross_border' ELSE 'domestic' END AS geo FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o.o_custkey = c.c_custkey LEFT JOIN nation s ON o.o_orderkey % 25 = s.n_nationkey",
    "mask_pii": "SELECT c_custkey, SUBSTR(c_name, 1, 4) || '****' AS masked FROM customer",
    "score_weighted": "SELECT c_custkey, ROUND(c_acctbal * CAST(0.4 AS DOUBLE) + c_nationkey * CAST(0.6 AS DOUBLE), 6) AS score FROM customer",
    "ab_bucket": "SELECT c_custkey, CASE WHEN MOD(ABS(c_custkey), 100) < 50 THEN 'control' ELSE 'test' END AS variant FROM customer",
    "agg_tier_summary": "SELECT c_mktsegment, COUNT(*) AS n, ROUND(AVG(c_acctbal), 6) AS avg_balance, COUNT(DISTINCT c_nationkey) AS nations FROM customer GROUP BY c_mktsegment",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total, MIN(o_orderkey) AS first_order, MAX(o_orderkey) AS last_order FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_filter_scalar": "SELECT COUNT(*) AS n FROM events WHERE event_type = 'purchase' AND value > 50",
    "agg_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "agg_stddev": "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag",
    "cube_agg": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup_agg": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))",
    "customer_summary_dim": "SELECT o_custkey AS user_id, COUNT(*) AS order_count, ROUND(SUM(o_totalprice), 2) AS total_spent, MAX(o_orderdate) AS last_order FROM orders GROUP BY o_custkey",
    "rank_topk": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    "running_total": "SELECT event_id, SUM(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT CAST(event_id AS DOUBLE) AS event_id, user_id, ts FROM events) t",
    "lag_gap": "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events",
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "distinct_users": "SELECT DISTINCT user_id FROM events",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect_keys": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 3",
    "except_keys": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 3",
    "cte_query": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_custkey, b.n FROM customer c JOIN big b ON c.c_custkey = b.o_custkey WHERE b.n > 10",
    "from_subquery": "SELECT t.user_id, t.n FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) t WHERE t.n > 60",
    "string_funcs": "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, TRIM(c_name) AS t, REPLACE(c_name, 'Customer', 'C') AS r, LPAD(c_mktsegment, 12, '*') AS p, CONCAT_WS('-', c_name, c_mktsegment) AS w, REGEXP_REPLACE(c_name, '[0-9]+', 'x') AS rr FROM customer",
    "math_funcs": "SELECT l_orderkey, l_linenumber, ABS(l_quantity - 25) AS a, FLOOR(l_extendedprice) AS f, CEIL(l_extendedprice) AS c, ROUND(SQRT(l_quantity), 8) AS s, ROUND(LN(l_extendedprice), 8) AS ln, GREATEST(l_quantity, 10.0) AS g, LEAST(l_quantity, 10.0) AS le FROM lineitem",
    "null_funcs": "SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'none') AS t, CAST(value AS INTEGER) IS NULL AS missing FROM events",
    "interval_join_inner": "SELECT c.event_id AS click_id, b.event_id AS buy_id FROM events c JOIN events b ON c.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts BETWEEN c.ts - INTERVAL 24 HOUR AND c.ts + INTERVAL 24 HOUR WHERE c.event_type = 'click'",
}

#: Queries whose text differs: first Spark's, then the check's.
DIFFER = {
    "array_any_affinity": ("SELECT e.event_id, 'click' = ANY(t.types) AS affine FROM events e JOIN (SELECT user_id, COLLECT_SET(event_type) AS types FROM events WHERE value > 50 GROUP BY user_id) t ON e.user_id = t.user_id", "SELECT e.event_id, list_contains(t.types, 'click') AS affine FROM events e JOIN (SELECT user_id, list(DISTINCT event_type) AS types FROM events WHERE value > 50 GROUP BY user_id) t ON e.user_id = t.user_id"),
    "date_funcs": ("SELECT o_orderkey, DATE_TRUNC('MONTH', o_orderdate) AS m, YEAR(o_orderdate) AS y, DATEDIFF(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS d, DATE_ADD(CAST(o_orderdate AS DATE), 3) AS p FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, year(o_orderdate) AS y, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS d, CAST(o_orderdate AS DATE) + 3 AS p FROM orders"),
    "json_props": ("SELECT event_id, GET_JSON_OBJECT(props, '$.page') AS page, props IS NOT NULL AS has FROM events", "SELECT event_id, json_extract_string(props, '$.page') AS page, props IS NOT NULL AS has FROM events"),
    "array_funcs": ("SELECT vec_id, SIZE(embedding) AS n, ROUND(CAST(ARRAY_MAX(embedding) AS DOUBLE), 5) AS hi, ROUND(CAST(ELEMENT_AT(embedding, 1) AS DOUBLE), 5) AS first FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(CAST(list_max(embedding) AS DOUBLE), 5) AS hi, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings"),
    "map_funcs": ("SELECT n_nationkey, MAP('k', n_regionkey)['k'] AS v, SIZE(MAP_KEYS(MAP('k', 1, 'l', 2))) AS n FROM nation", "SELECT n_nationkey, n_regionkey AS v, 2 AS n FROM nation"),
    "explode_array": ("SELECT user_id, t FROM (SELECT user_id, EXPLODE(SORT_ARRAY(COLLECT_SET(event_type))) AS t FROM events GROUP BY user_id) x", "SELECT DISTINCT user_id, event_type AS t FROM events"),
    "hash_bucket": ("SELECT c_custkey, CRC32(CAST(c_name AS BINARY)) >= 0 AS ok, SUBSTR(MD5(c_name), 1, 8) AS h FROM customer", "SELECT c_custkey, true AS ok, substr(md5(c_name), 1, 8) AS h FROM customer"),
    "tumbling_count": ("SELECT window.start AS w, event_type, COUNT(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT date_trunc('hour', ts) AS w, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2"),
    "sliding_count": ("SELECT window.start AS w, COUNT(*) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')", "SELECT w, COUNT(*) AS n FROM (SELECT date_trunc('hour', ts) - INTERVAL (i) HOUR AS w FROM events, (VALUES (0), (1)) v(i)) GROUP BY w"),
    "session_count": ("SELECT user_id, session_window.start AS s, COUNT(*) AS n FROM events GROUP BY user_id, session_window(ts, '6 hours')", "SELECT user_id, MIN(ts) AS s, COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g"),
}


def _register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


def _sql(sql: str) -> Query:
    return lambda spark, d: run_sql(spark, sql, Topics.of_folder(spark, d).read)


for _name, _text in SAME.items():
    _register(_name, _sql(_text), _text)
for _name, (_text, _other) in DIFFER.items():
    _register(_name, _sql(_text), _other)


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _register(f.__name__, f, oracle)
        return f

    return add


#: Tables whose rows never expire.
DIMENSIONS = ("customer", "nation", "region", "supplier", "part")


def _pipeline(sql: str, require: tuple[str, ...] = (), smart: bool = True, state: State = State(dimensions=DIMENSIONS), **more) -> Pipeline:
    return Pipeline("query", sql, Output("result", "parquet"), Emission("smart" if smart else "immediate", require), state, **more)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return run_batch(spark, _pipeline(FLAGSHIP, ("user_segment",)), Topics.of_folder(spark, d))


_register("emission_smart_alias", flagship, f"SELECT * FROM ({FLAGSHIP}) t WHERE user_segment IS NOT NULL")
_register("emission_smart_multi", lambda s, d: run_batch(s, _pipeline(FLAGSHIP, ("user_segment", "user_country", "order_id")), Topics.of_folder(s, d)), f"SELECT * FROM ({FLAGSHIP}) t WHERE user_segment IS NOT NULL AND user_country IS NOT NULL")
_register("emission_immediate", lambda s, d: run_batch(s, _pipeline(FLAGSHIP, ("user_segment",), smart=False), Topics.of_folder(s, d)), FLAGSHIP)


def _events(spark: SparkSession, d: str) -> Topics:
    """Clicks, purchases, signups and errors as topics of their own."""
    topics = Topics.of_folder(spark, d)
    events = topics.read("events")
    for kind in ("click", "purchase", "signup", "error"):
        topics.add(f"{kind}s", events.where(F.col("event_type") == kind))
    return topics


CLICK_BUY = "SELECT c.event_id AS click_id, c.user_id AS user_id, b.event_id AS buy_id FROM clicks c {} JOIN purchases b ON c.user_id = b.user_id"


def _click_buy_check(join: str, back: int, on: int) -> str:
    return f"""SELECT c.event_id AS click_id, c.user_id AS user_id, b.event_id AS buy_id FROM (SELECT * FROM events WHERE event_type = 'click') c
{join} JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON c.user_id = b.user_id AND b.ts >= c.ts - INTERVAL {back} HOUR AND b.ts <= c.ts + INTERVAL {on} HOUR"""


def _interval(join: str, click_ttl: int, buy_ttl: int) -> Query:
    state = State(timedelta(hours=click_ttl), {"purchases": timedelta(hours=buy_ttl)})
    p = _pipeline(CLICK_BUY.format(join), state=state, event_time={"clicks": "ts", "purchases": "ts"})
    return lambda spark, d: run_batch(spark, p, _events(spark, d), bounded=True)


_register("interval_join_ttl", _interval("INNER", 24, 24), _click_buy_check("INNER", 24, 24))
_register("interval_join_left", _interval("LEFT", 24, 24), _click_buy_check("LEFT", 24, 24))
_register("interval_join_asymmetric_ttl", _interval("LEFT", 12, 48), _click_buy_check("LEFT", 48, 12))


@_query("SELECT e.event_id, s.first_name FROM (SELECT * FROM events WHERE event_type = 'click') e JOIN (SELECT c_custkey, c_name AS first_name FROM customer) s ON e.user_id = s.c_custkey")
def dimension_broadcast_join(spark: SparkSession, d: str) -> DataFrame:
    p = _pipeline("SELECT e.event_id, s.c_name AS first_name FROM clicks e JOIN customer s ON e.user_id = s.c_custkey", state=State(dimensions=("customer",)), event_time={"clicks": "ts"})
    return run_batch(spark, p, _events(spark, d), bounded=True)


@_query("SELECT c.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'signup') WHERE r = 1) s ON c.user_id = s.user_id")
def dimension_latest(spark: SparkSession, d: str) -> DataFrame:
    p = _pipeline("SELECT c.event_id, s.event_id AS signup_id FROM clicks c LEFT JOIN signups s ON c.user_id = s.user_id", state=State(dimensions=("signups",)), event_time={"clicks": "ts", "signups": "ts"}, latest={"signups": ("user_id",)})
    return run_batch(spark, p, _events(spark, d), bounded=True)


@_query("SELECT c.event_id AS click_id, max(b.event_id) AS buy_id FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON c.user_id = b.user_id AND b.ts <= c.ts GROUP BY c.event_id")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the last purchase before it: one sort of both by user and time, and no range join."""
    events = Topics.of_folder(spark, d).read("events").where("event_type in ('click', 'purchase')")
    last = "last_value(case when event_type = 'purchase' then event_id end, true) over (partition by user_id order by ts, case when event_type = 'purchase' then 0 else 1 end, event_id rows between unbounded preceding and current row)"
    return events.select("event_id", "event_type", F.expr(last).alias("buy_id")).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "buy_id")


@_query("SELECT event_id, user_id FROM events")
def dedup_offset(spark: SparkSession, d: str) -> DataFrame:
    events = Topics.of_folder(spark, d).read("events").select("event_id", "user_id", F.lit("events").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"))
    return dedup_offsets(events.unionByName(events)).select("event_id", "user_id")


@_query("SELECT user_id, COUNT(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def dedup_key(spark: SparkSession, d: str) -> DataFrame:
    events = Topics.of_folder(spark, d).read("events").select("user_id", "event_type")
    return events.unionByName(events).dropDuplicates(["user_id", "event_type"]).groupBy("user_id").agg(F.count("*").alias("n"))


TTL = timedelta(days=1)


def _cutoff(spark: SparkSession, d: str) -> tuple[DataFrame, datetime]:
    """Signups, and the moment at which the first user's last one is exactly a lifetime old."""
    signups = Topics.of_folder(spark, d).read("events").where("event_type = 'signup'")
    return signups, signups.groupBy("user_id").agg(F.max("ts").alias("at")).agg(F.min_by("at", "user_id")).first()[0] + TTL


#: The same moment, less the lifetime.
CUTOFF = "(SELECT MAX(ts) FROM events WHERE event_type = 'signup' AND user_id = (SELECT MIN(user_id) FROM events WHERE event_type = 'signup'))"


@_query(f"SELECT user_id, MAX(ts) AS last_seen FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING MAX(ts) <= {CUTOFF}")
def ttl_expired(spark: SparkSession, d: str) -> DataFrame:
    signups, now = _cutoff(spark, d)
    return lifetimes.expired(signups, "user_id", "ts", now, TTL)


@_query(f"SELECT user_id, MAX(ts) AS last_seen FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING MAX(ts) > {CUTOFF}")
def ttl_alive(spark: SparkSession, d: str) -> DataFrame:
    signups, now = _cutoff(spark, d)
    return lifetimes.alive(signups, "user_id", "ts", now, TTL)


@_query("SELECT event_type, COUNT(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of users, and whether the approximate ones (2% standard error) are within four errors of them."""
    events = Topics.of_folder(spark, d).read("events").groupBy("event_type")
    counts = events.agg(F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return counts.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), 0.08 * F.col("users"))).alias("near"))


@_query("SELECT 'customer' AS topic, COUNT(*) AS row_count FROM customer UNION ALL SELECT 'events', COUNT(*) FROM events UNION ALL SELECT 'orders', COUNT(*) FROM orders")
def topic_stats(spark: SparkSession, d: str) -> DataFrame:
    topics = Topics.of_folder(spark, d)
    return topic_counts({n: topics.read(n) for n in ("events", "orders", "customer")})


def _coerced(table: str, key: str, columns: Callable[[], dict[str, Column]]) -> Query:
    return lambda spark, d: Topics.of_folder(spark, d).read(table).select(key, *(c.alias(n) for n, c in columns().items()))


_register("coerce_int", _coerced("orders", "o_orderkey", lambda: dict(a=N.as_int(F.col("o_totalprice")), b=N.as_int(F.lit("x7")), c=N.as_int(F.lit("42")))), "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(42 AS BIGINT) AS c FROM orders")
_register("coerce_float", _coerced("orders", "o_orderkey", lambda: dict(a=N.as_float(F.col("o_orderstatus")), b=N.as_float(F.lit("2.5")))), "SELECT o_orderkey, CAST(0 AS DOUBLE) AS a, CAST(2.5 AS DOUBLE) AS b FROM orders")
_register("coerce_bool", _coerced("events", "event_id", lambda: dict(a=N.as_bool(F.col("event_id") % 2), b=N.as_bool(F.lit("TRUE")))), "SELECT event_id, event_id % 2 = 1 AS a, false AS b FROM events")
_register("coerce_timestamp", _coerced("events", "event_id", lambda: dict(a=F.unix_micros(N.as_timestamp(F.col("event_id").cast("int"), "int")), b=F.unix_micros(N.as_timestamp(F.col("event_id"), "long")))), "SELECT event_id, event_id * 1000000 AS a, event_id AS b FROM events")
_register("coerce_time", _coerced("events", "event_id", lambda: dict(a=N.as_time(F.col("event_id") * 100_000))), "SELECT event_id, CASE WHEN event_id * 100000 > 0 AND event_id * 100000 < 86400000 THEN event_id * 100000000 ELSE event_id * 100000 END AS a FROM events")
_register("coerce_date", _coerced("events", "event_id", lambda: dict(a=N.as_date(F.col("event_id")), b=N.as_date(F.lit("2024-02-29")))), "SELECT event_id, DATE '1970-01-01' + CAST(event_id AS INTEGER) AS a, DATE '2024-02-29' AS b FROM events")
_register("coerce_decimal", _coerced("lineitem", "l_orderkey", lambda: dict(n=F.col("l_linenumber"), a=N.as_decimal(F.col("l_extendedprice"), 18, 2).cast("double"), b=N.as_decimal(F.lit("-12.34"), 10, 2).cast("double"))), "SELECT l_orderkey, l_linenumber AS n, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS a, CAST(-12.34 AS DOUBLE) AS b FROM lineitem")
_register("coerce_uuid", _coerced("nation", "n_nationkey", lambda: dict(a=N.as_uuid(F.unhex(F.md5("n_name")), binary=True))), "SELECT n_nationkey, regexp_replace(md5(n_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS a FROM nation")
_register("coerce_duration", _coerced("nation", "n_nationkey", lambda: dict(a=N.as_duration(F.unhex(F.lit("0100000002000000E8030000"))))), "SELECT n_nationkey, 'P1M2DT1S' AS a FROM nation")
_register("key_extraction", lambda s, d: (lambda df: df.select("c_custkey", key_value(df, "c_custkey").cast("string").alias("k"), key_value(df, "missing").isNull().alias("none")))(Topics.of_folder(s, d).read("customer")), "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, true AS none FROM customer")


@_query("SELECT o.o_orderkey, COALESCE(c.c_name, '') AS c_name, COALESCE(c.c_acctbal, 0) AS c_acctbal FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def missing_defaults(spark: SparkSession, d: str) -> DataFrame:
    return N.with_defaults(run_sql(spark, "SELECT o.o_orderkey, c.c_name, c.c_acctbal FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey", Topics.of_folder(spark, d).read))


@_query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}' AS payload FROM nation")
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    df = Topics.of_folder(spark, d).read("nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none"))
    return df.select("n_nationkey", json_value(df).alias("payload"))


@_query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def avro_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows that went through framed Avro messages."""
    import json

    from tidewell.functions.types import to_avro

    df = Topics.of_folder(spark, d).read("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    schema = json.dumps(to_avro(df.schema))
    return from_avro_value(avro_values(df, schema, 7, "c_custkey"), {7: schema}, df.schema)


# streams: each runs over all that its topics hold and returns what was written


def _ran(spark: SparkSession, d: str, p: Pipeline, kinds: tuple[str, ...], tables: tuple[str, ...] = (), batches: int = 4) -> DataFrame:
    from tidewell.sources.sinks import read_table
    from tidewell.streaming.runner import run_available, stream_result

    base = _scratch(spark)
    events, topics = Topics.of_folder(spark, d).read("events"), Topics.of_folder(spark, d, list(tables))
    for kind in kinds:
        own = events.where(F.col("event_type") == kind)
        # a row long after all others lets the watermark pass them, so that unmatched rows leave
        late = own.limit(1).select(*(F.lit(-1).cast("long").alias(c) if c in ("event_id", "user_id") else F.lit(datetime(2100, 1, 1)).cast(own.schema[c].dataType).alias(c) if c == "ts" else F.col(c) for c in own.columns))
        own.repartitionByRange(batches, "ts").write.parquet(f"{base}/{kind}s")
        late.write.mode("append").parquet(f"{base}/{kind}s")
        topics.known.update(Topics(spark, {f"{kind}s": _topic(f"{base}/{kind}s", own.schema)}).known)
    run_available(stream_result(spark, p, topics), p, f"{base}/out", f"{base}/checkpoint")
    return read_table(spark, f"{base}/out")


def _topic(path: str, schema: T.StructType):
    from tidewell.sources.topics import Topic

    return Topic("parquet", path, schema, {"maxFilesPerTrigger": "2"})


def _scratch(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="stream-")


@_query(_click_buy_check("LEFT", 24, 24))
def stream_left_interval(spark: SparkSession, d: str) -> DataFrame:
    p = _pipeline(CLICK_BUY.format("LEFT"), state=State(timedelta(hours=24)), event_time={"clicks": "ts", "purchases": "ts"})
    return _ran(spark, d, p, ("click", "purchase")).where("click_id >= 0")


@_query("SELECT e.event_id, c.c_name FROM (SELECT * FROM events WHERE event_type = 'click') e JOIN customer c ON e.user_id = c.c_custkey")
def stream_dim_enrich(spark: SparkSession, d: str) -> DataFrame:
    p = _pipeline("SELECT e.event_id, c.c_name FROM clicks e LEFT JOIN customer c ON e.user_id = c.c_custkey", ("c_name",), state=State(dimensions=("customer",)), event_time={"clicks": "ts"})
    return _ran(spark, d, p, ("click",), ("customer",))


@_query("SELECT c.event_id AS click_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'click') c JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON c.user_id = s.user_id AND s.ts <= c.ts + INTERVAL 48 HOUR")
def stream_late_dim(spark: SparkSession, d: str) -> DataFrame:
    """Clicks that wait two days for the signups of their user, in a pipeline with smart emission."""
    sql = "SELECT c.event_id AS click_id, s.event_id AS signup_id FROM clicks c LEFT JOIN signups s ON c.user_id = s.user_id"
    state = State(timedelta(hours=48), dimensions=("signups",), streamed=("signups",))
    p = _pipeline(sql, ("signup_id",), state=state, event_time={"clicks": "ts", "signups": "ts"})
    return _ran(spark, d, p, ("click", "signup")).where("click_id >= 0 and signup_id >= 0")


@_query("SELECT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events that were sent twice."""
    from tidewell.sources.sinks import read_table
    from tidewell.streaming.runner import dedup_stream, run_available

    base = _scratch(spark)
    events = Topics.of_folder(spark, d).read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        events.repartition(2).write.mode("append").parquet(f"{base}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/events")
    run_available(dedup_stream(stream, ["event_id"], "ts", "90 days").select("event_id", "user_id"), _pipeline("SELECT 1 FROM events"), f"{base}/out", f"{base}/checkpoint")
    return read_table(spark, f"{base}/out")


@_query("SELECT event_id, user_id, event_type FROM events WHERE value > 10")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """A run that stops and is started again when more has come: every row once."""
    from tidewell.sources.sinks import read_table
    from tidewell.streaming.runner import run_available, stream_result

    base = _scratch(spark)
    events = Topics.of_folder(spark, d).read("events")
    p = _pipeline("SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE e.value > 10", event_time={"events": "ts"})
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/events")
        topics = Topics(spark, {"events": _topic(f"{base}/events", events.schema)})
        run_available(stream_result(spark, p, topics), p, f"{base}/out", f"{base}/checkpoint")
    return read_table(spark, f"{base}/out")


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder)
