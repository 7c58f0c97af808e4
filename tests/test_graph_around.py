"""The neighbours of one node: the same as in the whole graph, and no more calls are resolved than name it."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans import catalogue


@pytest.mark.parametrize("key", ["struct:n0.rs:0:", "fn:", "trait:", "none"])
def test_around_equals_neighbours_of_the_whole_graph(spark, sf, monkeypatch, key):
    entities, calls = catalogue.entities(spark, sf), catalogue.calls(spark, sf)
    calls = calls.unionByName(spark.createDataFrame([(None, "part:1", None, "1"), ("x", None, "y", None)], calls.schema))
    key = graph.nodes(entities).where(F.startswith("key", F.lit(key))).agg(F.min("key")).first()[0] or key
    every = sorted(r.key for r in graph.neighbours(graph.graph(entities, calls)[1], key).collect())
    seen, plain = [], graph.resolved_calls
    monkeypatch.setattr(graph, "resolved_calls", lambda c, ids: seen.append(c.count()) or plain(c, ids))
    assert sorted(r.key for r in graph.around(entities, calls, key).collect()) == every
    assert seen[0] < calls.count() / 2


@pytest.mark.parametrize("name, of", [("graph_edge_dedup", graph.simple_edges), ("graph_degree", graph.degrees)])
def test_edges_are_not_made_distinct_by_relation_before_pairs(spark, sf, name, of):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    twice = of(graph.graph(catalogue.entities(spark, sf), catalogue.calls(spark, sf))[1])
    assert plan(catalogue.QUERIES[name](spark, sf)) < plan(twice)
