"""Task records, plans, the command line's pieces and the API."""

import json

import pytest

from tessera import __main__ as cli
from tessera.engine import Engine
from tessera.operators import tasks
from tessera.plans.extraction import fixtures
from tessera.sources import completion, records

PLAN = {"task_name": "n", "approach": "a", "complexity": "low", "files_to_create": [{"path": "x.rs", "description": "new"}], "files_to_modify": [{"path": "y.rs", "description": "old"}], "dependencies_to_add": []}


def test_lifecycle(spark, tmp_path):
    store = records.Records(str(tmp_path))
    assert store.current() is None and store.table(spark).count() == 0
    first, second = store.create("Make it fast"), store.create("Then make it small please")
    assert store.current() == second["id"] and store.load(first["id"])["name"] == "make-it-fast"
    with pytest.raises(records.NotReady):
        store.advance(first["id"])
    with pytest.raises(records.NotReady):
        store.set_plan(first["id"], PLAN)
    store.set_research(first["id"], {"task_name": "n", "summary": "s", "suggested_approach": "a"})
    assert store.advance(first["id"])["phase"] == "planning"
    store.set_plan(first["id"], PLAN)
    assert [store.advance(first["id"])["phase"] for _ in range(2)] == ["agent", "complete"]
    with pytest.raises(records.NotReady):
        store.advance(first["id"])
    (tmp_path / "tasks/broken").mkdir()
    (tmp_path / "tasks/broken/task.json").write_text("{not json")
    assert {r.id for r in store.table(spark).collect()} == {first["id"], second["id"]}
    assert store.by_prefix(first["id"][:20]) == first["id"]
    store.delete(second["id"])
    assert store.current() is None and store.table(spark).count() == 1


def test_plans(spark):
    assert records.from_yaml(records.to_yaml(PLAN)) == PLAN
    items = tasks.plan_items(records.plans(spark, [records.to_yaml(PLAN)])).orderBy("ordinal").collect()
    assert [(r.action, r.path) for r in items] == [("create", "x.rs"), ("modify", "y.rs")]
    done = spark.createDataFrame([("n", "passed"), ("n", None), ("m", "passed")], "task_name string, conformance string")
    assert sorted(tuple(r) for r in tasks.progress(done).collect()) == [("m", 1, 1, True), ("n", 2, 1, False)]


def test_completion_settings():
    known = {"one": ("m", "http://x")}
    assert completion.endpoint("one", known, {"ONE_API_KEY": "k"}).api_key == "k"
    assert completion.endpoint("one", known, {"ONE_MODEL": "e"}, model="given").model == "given"
    with pytest.raises(ValueError):
        completion.endpoint("two", known, {})
    assert completion.checked(200, "ok") == "ok"
    with pytest.raises(completion.RateLimited):
        completion.checked(429, "")
    with pytest.raises(completion.ApiError):
        completion.checked(500, "x")


def test_api(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.initialize()
    engine.index(fixtures(spark))
    status, body = cli.answer(engine, "/api/graph")
    assert status == 200 and len(json.loads(body)["nodes"]) > 15
    status, body = cli.answer(engine, "/api/node/fn:src%2Fqueue.ts:21:flush")
    assert status == 200 and json.loads(body)["dependencies"] == "emit, next"
    assert cli.answer(engine, "/api/node/fn:none")[0] == 404 and cli.answer(engine, "/api/search") == (200, "[]")
    assert len(json.loads(cli.answer(engine, "/api/search?q=load+rows&limit=3")[1])) == 3
    assert cli.parser().parse_args(["search", "a", "b", "-l", "3"]).limit == 3
