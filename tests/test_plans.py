from datetime import timedelta

import pytest

from tidewell.operators.batch import result_schema, run_batch, run_sql
from tidewell.plans.planner import Planner, edge_name, join_key, quoted, view_name
from tidewell.plans.spec import Emission, Output, Pipeline, SpecError, State
from tidewell.sources.topics import Topics


@pytest.fixture(scope="module")
def planner(spark):
    return Planner(spark)


def edges(plan):
    return [(e.left, e.right, e.keys) for e in plan.edges]


def test_tables_and_keys(planner):
    p = planner.plan("SELECT * FROM users u LEFT JOIN events e ON u.id = e.id AND e.s = u.s AND e.v > 1 JOIN t ON (e.a = t.a OR e.b = t.b)")
    assert p.tables == ["events", "t", "users"]
    assert edges(p) == [("u", "e", (("id", "id"), ("s", "s"))), ("e", "t", ())]
    assert p.graph() == {"events": ["t", "users"], "t": ["events"], "users": ["events"]} and p.connected()


def test_two_joins_on_one_key_stay_apart(planner):
    p = planner.plan("SELECT * FROM a JOIN b ON a.k = b.k JOIN c ON a.k = c.k")
    assert edges(p) == [("a", "b", (("k", "k"),)), ("a", "c", (("k", "k"),))]
    assert p.shared_keys() == {("a", ("k",)): ["b", "c"]}


def test_using_self_join_cte_subquery(planner):
    assert edges(planner.plan("SELECT * FROM a JOIN b USING (x, y)")) == [("a", "b", (("x", "x"), ("y", "y")))]
    assert planner.plan("SELECT * FROM a x JOIN a y ON x.k = y.k").tables == ["a"]
    assert planner.plan("WITH w AS (SELECT * FROM a) SELECT * FROM w WHERE EXISTS (SELECT 1 FROM b WHERE b.k = w.k)").tables == ["a", "b"]
    assert planner.plan("SELECT * FROM (SELECT * FROM a) t UNION SELECT * FROM b").tables == ["a", "b"]


@pytest.mark.parametrize("sql", ["", "  ", "SELECT 1", "SELEC x FROM t", "SELECT * FROM"])
def test_rejected(planner, sql):
    with pytest.raises(SpecError):
        planner.plan(sql)


def test_unqualified_columns_make_no_key(planner):
    assert edges(planner.plan("SELECT * FROM a JOIN b ON k = j")) == [("a", "b", ())]


def test_rewrites(planner):
    assert planner.any_to_contains("SELECT 1 FROM t WHERE t.x = ANY(t.l) AND 2 = 2") == "SELECT 1 FROM t WHERE array_contains(t.l, t.x) AND 2 = 2"
    sql = planner.bounded("SELECT * FROM a JOIN b ON a.k = b.k JOIN d ON a.k = d.k", lambda t: None if t == "d" else timedelta(minutes=5), lambda t: "ts")
    assert sql.count("interval") == 2 and sql.endswith("ON a.k = d.k")
    with pytest.raises(SpecError):
        planner.bounded("SELECT * FROM a JOIN b USING (k)", lambda t: timedelta(1), lambda t: "ts")


HOUR = timedelta(hours=1)


@pytest.mark.parametrize(
    "sql, bounds",
    [
        ("SELECT * FROM a JOIN b ON a.k = b.k", 1),
        ("SELECT * FROM (SELECT * FROM a WHERE x > 1) a JOIN b ON a.k = b.k", 1),
        ("SELECT * FROM (SELECT k, ts AS seen FROM a) c JOIN b ON c.k = b.k", 1),
        ("WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN b ON c.k = b.k", 1),
        ("WITH c AS (SELECT * FROM a), e AS (SELECT * FROM c) SELECT * FROM e x LEFT JOIN b ON x.k = b.k", 1),
        ("SELECT * FROM a JOIN d ON a.k = d.k JOIN b ON d.k = b.k", 1),
        ("SELECT * FROM a JOIN b ON a.k = b.k JOIN v ON a.j = v.j", 3),
        ("SELECT * FROM a LEFT JOIN b ON a.k = b.k LEFT JOIN v ON a.j = v.j", 3),
        ("SELECT * FROM a, b WHERE a.k = b.k", 1),
        ("SELECT * FROM a WHERE EXISTS (SELECT 1 FROM v JOIN b ON v.k = b.k WHERE v.k = a.k)", 1),
        ("SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM v) u JOIN d ON u.k = d.k", 0),
    ],
)
def test_events_are_bound_in_time_wherever_they_come_from(planner, sql, bounds):
    got = planner.bounded(sql, lambda t: None if t == "d" else HOUR, lambda t: "ts")
    assert got.count("interval") == 2 * bounds and got.count("IS NULL") == (1 if "LEFT JOIN v" in sql else 0)
    planner.parse(got)
    assert "c.`seen`" in got or "`c`.`seen`" in got if "seen" in sql else True


@pytest.mark.parametrize("sql", ["SELECT * FROM a, b", "SELECT * FROM a LEFT JOIN b USING (k)", "SELECT * FROM (SELECT k FROM a) c JOIN b ON c.k = b.k", "SELECT * FROM (SELECT k, count(*) n FROM a GROUP BY k) c JOIN b ON c.k = b.k"])
def test_what_can_not_be_bound_is_rejected(planner, sql):
    with pytest.raises(SpecError):
        planner.bounded(sql, lambda t: HOUR, lambda t: "ts")


def test_bounds_hold_through_a_subquery_a_dimension_and_an_outer_join(spark):
    topics = Topics(spark)
    at = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m)"
    topics.add("a", spark.sql(f"SELECT 1 AS k, {at} AS ts, m FROM VALUES (0) t(m)"))
    topics.add("b", spark.sql(f"SELECT 1 AS k, {at} AS ts, m FROM VALUES (30), (60), (61) t(m)"))
    topics.add("v", spark.sql(f"SELECT 1 AS k, {at} AS ts, m FROM VALUES (-60), (-61), (100) t(m)"))
    topics.add("d", spark.sql("SELECT 1 AS k"))

    def rows(sql):
        p = Pipeline("p", sql, Output("o", "json"), state=State(HOUR, dimensions=("d",)), event_time=dict.fromkeys("abv", "ts"))
        return sorted(tuple(r) for r in run_batch(spark, p, topics).collect())

    assert rows("SELECT c.m, b.m FROM (SELECT * FROM a) c JOIN d ON c.k = d.k JOIN b ON d.k = b.k") == [(0, 30), (0, 60)]
    assert rows("WITH c AS (SELECT k, ts AS seen FROM a) SELECT b.m FROM c JOIN b ON c.k = b.k") == [(30,), (60,)]
    # v is bound to a and to b: 100 is too late for a, -60 too early for b at 30 and 60
    assert rows("SELECT b.m, v.m FROM a JOIN b ON a.k = b.k JOIN v ON a.k = v.k") == []
    assert rows("SELECT b.m, v.m FROM a LEFT JOIN b ON a.k = b.k AND b.m > 99 JOIN v ON a.k = v.k") == [(None, -60)]
    assert rows("SELECT a.m, v.m FROM a, v WHERE a.k = v.k") == [(0, -60)]


def test_names():
    assert view_name("a.b-c") == "a_b_c" and quoted("a`b") == "`a``b`" and edge_name("x", "a") == edge_name("a", "x")
    assert join_key({"a": 1, "b": None}, ["a", "b", "c"]) == "1||"


def test_dotted_topics_and_emission(spark):
    topics = Topics(spark)
    topics.add("shop.orders", spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string"))
    topics.add("dim-a", spark.createDataFrame([(1, None), (2, "n")], "k int, name string"))
    sql = "SELECT o.v, d.name AS who FROM shop.orders o LEFT JOIN `dim-a` d ON o.k = d.k"
    smart = Pipeline("p", sql, Output("o", "json"), Emission("smart", ("who",)), State(dimensions=("dim-a",)))
    assert [tuple(r) for r in run_batch(spark, smart, topics).collect()] == [("y", "n")]
    now = Pipeline("p", sql, Output("o", "json"), Emission("immediate", ("who",)))
    assert run_batch(spark, now, topics).count() == 3
    with pytest.raises(SpecError):
        run_batch(spark, Pipeline("p", sql, Output("o", "json"), Emission("smart", ("nope",))), topics)
    assert run_sql(spark, "SELECT orders.v FROM shop.orders", topics.read).count() == 3
    schema = result_schema(spark, now, {t: topics.read(t).schema for t in ("shop.orders", "dim-a")})
    assert [f["name"] for f in schema["fields"]] == ["v", "who"]


def test_boundary_is_inclusive(spark):
    topics = Topics(spark)
    topics.add("l", spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' AS ts"))
    topics.add("r", spark.sql("SELECT 1 AS k, explode(array(timestamp'2024-01-01 01:00:00', timestamp'2024-01-01 01:00:01', timestamp'2023-12-31 23:00:00', timestamp'2023-12-31 22:59:59')) AS ts"))
    p = Pipeline("p", "SELECT r.ts AS ts FROM l JOIN r ON l.k = r.k", Output("o", "json"), state=State(timedelta(hours=1)), event_time={"l": "ts", "r": "ts"})
    assert run_batch(spark, p, topics, bounded=True).count() == 2
