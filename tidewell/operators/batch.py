"""Bounded runs of pipelines."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewell.functions.types import to_avro
from tidewell.operators.emission import emitted
from tidewell.plans.planner import Planner, QueryPlan, quoted, spliced, view_name
from tidewell.plans.spec import Pipeline
from tidewell.sources.codec import conformed
from tidewell.sources.topics import Topics, latest_versions


def bound_sql(planner: Planner, plan: QueryPlan, views: dict[str, str]) -> str:
    """The query with each topic's name replaced by its view's, at the places where the parser saw it."""
    spans: dict[int, tuple[int, int, str]] = {}

    def visit(node: Any, ctes: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                visit(relations.apply(i)._2(), ctes)
                ctes = ctes | {relations.apply(i)._1()}
            visit(node.child(), ctes)
            return
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            name = ".".join(parts.apply(i) for i in range(parts.size()))
            if name not in ctes and name in views:
                o = node.origin()
                a, z = o.startIndex().get(), o.stopIndex().get() + 1
                # the relation's text may take in its alias; a name without one keeps its own as alias
                text = plan.sql[a:z]
                written = name if text.startswith(name) else ".".join(quoted(p) for p in name.split("."))
                alias = "" if text[len(written) :].strip() or aliased.get(a) else f" AS {quoted(name.split('.')[-1])}"
                spans[a] = (a, a + len(written), f"{quoted(views[name])}{alias}")
        if kind == "SubqueryAlias" and node.child().getClass().getSimpleName() == "UnresolvedRelation":
            aliased[node.child().origin().startIndex().get()] = True
        e = node.expressions()
        for i in range(e.size()):
            for sub in planner._subqueries(e.apply(i)):
                visit(sub, ctes)
        c = node.children()
        for i in range(c.size()):
            visit(c.apply(i), ctes)

    aliased: dict[int, bool] = {}
    visit(planner.parse(plan.sql), frozenset())
    return spliced(plan.sql, list(spans.values()))


def run_sql(spark: SparkSession, sql: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """A query over topics. Views have names of their own and go once the query is analysed."""
    planner = Planner(spark)
    sql = planner.any_to_contains(sql)
    plan = planner.plan(sql)
    mark = uuid.uuid4().hex[:12]
    views = {t: f"{view_name(t)}_{mark}" for t in plan.tables}
    try:
        for topic, view in views.items():
            read(topic).createOrReplaceTempView(view)
        return spark.sql(bound_sql(planner, plan, views))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def run_batch(spark: SparkSession, p: Pipeline, topics: Topics, bounded: bool = True) -> DataFrame:
    """A pipeline's result over all rows of its topics; bounded holds joins of events to their lifetimes, as a stream does.

    A topic whose rows have no event time has no lifetime in a batch.
    """

    def read(topic: str) -> DataFrame:
        df = topics.read(topic)
        return latest_versions(df, list(p.latest[topic]), p.time_of(topic)) if topic in p.latest else df

    def ttl(topic: str) -> timedelta | None:
        return p.ttl(topic) if p.ttl(topic) is not None and p.time_of(topic) in topics.read(topic).columns else None

    sql = Planner(spark).bounded(p.query, ttl, p.time_of) if bounded else p.query
    return conformed(emitted(run_sql(spark, sql, read), p.emission), p.output.schema, p.output.defaults)


def result_schema(spark: SparkSession, p: Pipeline, schemas: dict[str, T.StructType]) -> dict[str, Any]:
    """The Avro schema of a pipeline's result, from analysis alone."""
    return to_avro(run_sql(spark, p.query, lambda t: spark.createDataFrame([], schemas[t])).schema)
