"""Extraction: tables whose estimates are too small are not broadcast."""

from tessera.operators import blocks
from tessera.plans import extraction


def test_texts_are_not_broadcast(spark, sf):
    plan = extraction.QUERIES["name_helpers"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_bodies_are_not_broadcast(spark, sf):
    named, calls = blocks.located(extraction.sources(spark, sf, ".kt"))
    plan = blocks.calls_of_bodies(named, calls)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
