"""The partitioned store: what changes is rewritten, what does not stays; crashes; and small operators."""

import os

import numpy as np
import pytest

from plain import block_end
from tessera.engine import Engine
from tessera.functions import vectors as V
from tessera.operators import chunking, context, graph, tasks
from tessera.schemas import struct
from tessera.sources.store import Store, Table


def named(spark, **files):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in files.items()], "path string, content string")


def data_files(root):
    return {os.path.join(at, x): os.stat(os.path.join(at, x)).st_ino for at, _, names in os.walk(root) for x in names if x.endswith(".parquet")}


def test_a_crash_is_mended_by_the_next_run(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "store"), parts=4)
    engine.index(named(spark, a_py="def a():\n    b()\n"))
    written = Store._written
    with monkeypatch.context() as broken:  # the other tables are written, that of files is not

        def fails(self, rows, name, mode):
            if name == "file":
                raise OSError("lost")
            written(self, rows, name, mode)

        broken.setattr(Store, "_written", fails)
        with pytest.raises(OSError, match="lost"):
            engine.index(named(spark, b_py="def b():\n    pass\n"))
    assert [r.path for r in engine.files().collect()] == ["a.py"]
    engine.index(named(spark, b_py="def b():\n    pass\n"))
    assert sorted(r.path for r in engine.files().collect()) == ["a.py", "b.py"]
    assert engine.entities("function").count() == 2
    assert engine.get_file("b.py").count() == 1 and engine.get_file("c.py").count() == 0
    assert {(r.src, r.dst) for r in engine.known_calls().collect()} == {("function:a.py:a", "function:b.py:b")}
    assert engine.contained().count() == 2


def test_one_changed_file_of_many_rewrites_one_partition_a_table(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), parts=16)
    files = [(f"d/f{k}.py", f"def f{k}():\n    g{k}()\n") for k in range(300)]
    engine.index(spark.createDataFrame(files, "path string, content string"))
    assert engine.run == {"files": 300, "bytes": sum(len(c) for _, c in files), "changed": 300, "chunks": 300, "entities": 300, "edges": 600}
    before = data_files(tmp_path / "store")
    stats = engine.stats().first()
    files[7] = ("d/f7.py", "def other():\n    h()\n")
    engine.index(spark.createDataFrame(files, "path string, content string"))
    assert engine.run["files"] == 300 and engine.run["changed"] == 1 and engine.run["chunks"] == 1
    after = data_files(tmp_path / "store")
    folders = {os.path.relpath(os.path.dirname(f), tmp_path / "store") for f in set(before) ^ set(after)}
    part = {f.split("/")[1] for f in folders}
    assert len(part) == 1 and folders == {f"{t}/{next(iter(part))}{k}" for t, k in (("chunk", ""), ("file", ""), ("entity", "/kind=function"), ("edge", "/edge_type=calls"), ("edge", "/edge_type=contains"))}
    assert engine.stats().first() == stats and engine.impact("g7").count() == 0 and [r.name for r in engine.impact("h").collect()] == ["other"]
    engine.index(spark.createDataFrame(files, "path string, content string"))  # nothing to do
    assert data_files(tmp_path / "store") == after and engine.run == {"files": 300, "bytes": sum(len(c) for _, c in files), "changed": 0}


def test_a_partition_that_becomes_empty_is_empty(spark, tmp_path):
    tables = {"file": Table(struct("path string;hash string"), "path"), "edge": Table(struct("file_path string;edge_type string;dst string"), kind="edge_type")}
    store = Store(spark, str(tmp_path / "s"), tables, parts=4)
    assert not store.exists()
    store.create(note="x")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3")], "path string, hash string")
    edges = spark.createDataFrame([("a", "calls", "x"), ("a", "extends", "y"), ("b", "calls", "z"), ("c", "calls", "not among the files")], "file_path string, edge_type string, dst string")
    store.replace(files, {"file": files, "edge": edges})
    assert sorted(tuple(r) for r in store.table("edge").collect()) == [("a", "calls", "x"), ("a", "extends", "y"), ("b", "calls", "z")]
    assert store.of_files("edge", ["b"]).count() == 1
    for _ in range(2):
        store.replace(files.where("path = 'a'"), {})
    assert [tuple(r) for r in store.table("edge").collect()] == [("b", "calls", "z")] and store.table("file").count() == 1
    store.replace(files.where("path = 'a'"), {"edge": edges})
    assert store.table("edge").where("edge_type = 'extends'").count() == 1
    store.replace(files.limit(0), {"file": files})
    assert store.table("file").count() == 1
    assert {r.key: r.value for r in Store(spark, str(tmp_path / "s"), tables, parts=99).metadata().collect()} == {"version": "2", "parts": "4", "note": "x"}
    assert Store(spark, str(tmp_path / "s"), tables, parts=99).parts == 4
    plan = store.table("edge").where("edge_type = 'calls'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(edge_type" in plan
    store.create()
    assert store.table("edge").count() == 0 == store.table("file").count() and "note" not in store._known()


def test_columns_that_older_files_lack_have_defaults(spark, tmp_path):
    old = {"file": Table(struct("path string"), "path")}
    Store(spark, str(tmp_path / "s"), old).create()
    files = spark.createDataFrame([("a",)], "path string")
    Store(spark, str(tmp_path / "s"), old).replace(files, {"file": files})
    new = {"file": Table(struct("path string;visibility string;note string?"), "path", defaults={"visibility": "private"})}
    assert [tuple(r) for r in Store(spark, str(tmp_path / "s"), new).table("file").collect()] == [("a", "private", None)]


@pytest.mark.parametrize("blocks", [(2, 3), (1, 100), (1024, 16384)])
def test_blocks_of_queries_meet_blocks_of_chunks(spark, monkeypatch, blocks):
    monkeypatch.setattr(V, "QUERIES", blocks[0])
    monkeypatch.setattr(V, "CHUNKS", blocks[1])
    schema = "id long, embedding array<double>"
    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(6)] + [(6, [0.0, 0.0]), (7, None), (8, [1.0]), (9, [1.0, 5.0])], schema)
    found = V.top_k_of_each(rows.where("id < 6"), rows, 2, "id", "id").collect()
    assert len(found) == 12 and {(r.query_id, r.chunk_id) for r in found if r.rank == 1} == {(k, k) for k in range(6)}
    assert [(r.chunk_id, r.score) for r in found if r.query_id == 5] == [(5, 1.0), (9, 1.0)]  # a tie
    every = V.top_k_of_each(rows.where("id = 1"), rows, 20, "id", "id").collect()
    assert [r["rank"] for r in every] == list(range(1, len(every) + 1)) and {r.chunk_id for r in every if r.score is not None} == {0, 1, 2, 3, 4, 5, 9}
    assert V.top_k_of_each(rows.limit(0), rows, 2, "id", "id").count() == 0 == V.top_k_of_each(rows, rows.limit(0), 2, "id", "id").count()


def test_relations_of_hits_filter_calls_first(spark):
    calls = spark.createDataFrame([("a", f"x{k:02}") for k in range(20)] * 3 + [("b", "a"), ("c", "d")], "caller_name string, callee_name string")
    hits = spark.createDataFrame([(1, "p", 0.5, 1, 2, "text", "function:p:a", "function"), (2, "p", 0.4, 3, 4, None, "function:p:`b`", "function"), (3, "q", 0.3, 1, 1, "t", None, "file")], "rank long, path string, score double, start_line int, end_line int, preview string, entity_id string, entity_type string")
    made = context.smart_sections(hits, calls)
    found = {r["rank"]: r for r in made.collect()}
    assert found[1].calls == "- **function** `function:p:a` calls: x00, x01, x02, x03, x04" and found[1].called_by == "- **function** `function:p:a` is called by: b"
    assert found[2].calls.endswith("calls: a") and found[2].called_by is None and found[3].calls is None
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("LeftSemi, BuildRight") == 2 and plan.count("WindowGroupLimit") == 4  # broadcast first; partial and final
    assert [tuple(r) for r in graph.lists(calls, "caller_name", "callee_name", 2).orderBy("caller_name").collect()] == [("a", "x00, x01", 20), ("b", "a", 1), ("c", "d", 1)]


def test_cuts_take_linear_time():
    import time

    took = []
    for n in (200_000, 2_000_000):
        sizes = np.random.default_rng(1).integers(1, 90, n)
        begin = time.perf_counter()
        assert chunking.cuts(sizes)[-1][3] == n
        took.append(time.perf_counter() - begin)
    assert took[1] < 40 * took[0]


def test_block_ends():
    lines = ["fn a() {", "  if x {", "  }", "}", "fn b() {}", "def c():", "    pass", "", "x = 1"]
    assert [block_end(lines, k) for k in (0, 4, 5)] == [4, 5, 7]


def test_cursor_of_a_finished_plan(spark):
    plans = spark.createDataFrame([("t", [("a", "x")], [("b", "y")])], "task_name string, files_to_create array<struct<path:string,description:string>>, files_to_modify array<struct<path:string,description:string>>")
    items = tasks.plan_items(plans)
    done = spark.createDataFrame([("t", 0), ("t", 1), ("t", 1)], "task_name string, ordinal int")
    assert tuple(tasks.cursor(items, done).first()) == ("t", 2, 2, None, None, None)
    assert tuple(tasks.cursor(items, done.where("ordinal = 0")).first()) == ("t", 2, 1, 1, "modify", "b")
    assert graph.contained(spark.createDataFrame([], "edge_type string, src string, dst string"), spark.createDataFrame([], "path string")).count() == 0
