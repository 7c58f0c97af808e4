"""Sources, extraction, chunks, change detection, context, tasks, streaming, and the engine from end to end."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plain import fallback
from tessera.engine import Engine
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import chunking, context, corpus, extract, graph, tasks
from tessera.plans.extraction import FIXTURES
from tessera.sources import config, documents, trees


@pytest.fixture
def tree(tmp_path):
    for name, text in FIXTURES.items():
        path = tmp_path / "code" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    root = tmp_path / "code"
    (root / ".hidden.py").write_text("x")
    (root / "_priv").mkdir()
    (root / "_priv/deep.py").write_text("def kept():\n    pass\n")
    (root / "build").mkdir()
    (root / "build/made.js").write_text("x")
    (root / "notes.log").write_text("x")
    (root / "Makefile").write_text("all:")
    (root / "bad.py").write_bytes(b"\xff\xfe")
    (root / ".gitignore").write_text("build/\n*.md\n!README.md\n")
    (root / "skip.md").write_text("x")
    return str(root)


def test_tree_source(spark, tree):
    found = {r.path for r in trees.read_tree(spark, tree, extensions=",".join(corpus.INDEX_EXTENSIONS)).collect()}
    assert found == set(FIXTURES) | {"_priv/deep.py"}
    with pytest.raises(Exception, match="utf-8"):
        trees.read_tree(spark, tree, strict="true").collect()


def chunks_by_hand(text):
    lines = text.split("\n")
    lines = [x.removesuffix("\r") for x in (lines[:-1] if lines and lines[-1] == "" else lines)] if text else []
    out, buffer, start = [], "", 1
    for c, line in enumerate(lines, 1):
        buffer += line + "\n"
        if len(buffer.encode()) >= 1000:
            out.append((start, c, buffer.strip()))
            o = max(c - 2, 0)
            low = max(o - 1, 0)
            buffer, start = "".join(x + "\n" for x in lines[low : low + c - o + 1]), o
    return out + ([(start, len(lines), buffer.strip())] if buffer.strip() else [])


def test_chunks_equal_a_plain_loop(spark):
    draw = random.Random(9)
    texts = ["", "\n\n", "x" * 1500, "a" * 400 + "\n" + "b" * 700 + "\nc\nd", "é" * 600 + "\r\n" + "z", "a" * 999, "a" * 999 + "\n"]
    texts += ["\n".join("w" * draw.choice([0, 3, 80, 400, 1200]) for _ in range(draw.randint(1, 40))) for _ in range(40)]
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, content string")
    found = {}
    for r in chunking.chunks(files).orderBy("file_path", "ordinal").collect():
        found.setdefault(r.file_path, []).append((r.start_line, r.end_line, r.content))
    assert found == {str(k): c for k, t in enumerate(texts) if (c := chunks_by_hand(t))}


EXPECTED = {
    "src/shape.rs": {"struct": {"Shape"}, "trait": {"Area"}, "impl": {"Area_for_Shape"}, "function": {"Shape::area", "load"}, "enum": {"Kind"}, "const": {"LIMIT"}},
    "src/queue.ts": {"enum": {"Level"}, "trait": {"Sink"}, "struct": {"Queue"}, "function": {"write", "flush"}},
    "pkg/__init__.py": {"struct": {"Store"}, "function": {"__init__", "load", "_hidden"}},
    "cmd/main.go": {"struct": {"Server"}, "trait": {"Handler"}, "function": {"Server.Start", "helper"}},
    "app/Account.java": {"struct": {"Account"}, "function": {"Account.pay", "owner"}, "enum": {"State"}, "trait": {"Owned"}},
    "app/Order.cs": {"struct": {"Order"}, "function": {"Order.Send", "Price"}, "enum": {"Status"}, "trait": {"IPriced"}},
    "src/global.rs": {"static": {"COUNT", "NAME"}},
    "src/broken.rs": {"struct": {"Half"}, "function": {"still_found"}},
    "src/View.kt": {"struct": {"View"}, "function": {"draw"}},
    "empty.py": {},
}


def rows_of(path):
    found = extract.extract_file(path, FIXTURES[path])
    return fallback(path, FIXTURES[path]) if found is None else found


@pytest.mark.parametrize("path", sorted(EXPECTED))
def test_entities(path):
    found = {}
    for r in rows_of(path):
        if not r["edge_type"]:
            found.setdefault(r["kind"], set()).add(r["qualified_name"] if r["kind"] == "function" else r["name"])
    assert found == EXPECTED[path]


def test_calls_and_flags():
    calls = {(r["src"].rpartition(":")[2], r["dst"].rpartition(":")[2]): (r["call_type"], r["is_conditional"], r["is_in_loop"]) for p in FIXTURES for r in rows_of(p) if r["edge_type"] == "calls"}
    assert calls["area", "measure"] == ("direct", True, False) and calls["load", "walk"] == ("direct", False, True)
    assert calls["write", "Logger"] == ("constructor", False, False) and calls["load", "Row"] == ("constructor", True, True)
    assert calls["Server.Start", "Apply"] == ("method", False, True) and calls["Account.pay", "audit"] == ("method", True, False)
    edges = [(r["edge_type"], r["dst"]) for r in extract.extract_file("src/shape.rs", FIXTURES["src/shape.rs"]) if r["edge_type"] not in (None, "calls", "contains")]
    assert edges == [("extends", "trait:?:Named"), ("extends", "trait:?:Sized"), ("implements", "trait:?:Area"), ("returns_type", "type:?:Result<Shape, Error>")]


def test_registered_parsers():
    assert {"rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "pyi", "go", "java", "cs"} <= set(extract.PARSERS)
    assert extract.extract_file("a.PY", "def f(): pass")[0]["kind"] == "function"
    extract.register("zz", lambda path, text: [{"kind": "none"}])
    assert extract.extract_file("a.zz", "x") == [{"kind": "none"}]


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    assert not engine.is_initialized()
    engine.initialize()
    assert engine.is_initialized() and engine.stats().first()["files"] == 0
    assert engine.count_indexable(tree) == len(FIXTURES) + 2
    first = engine.index_directory(tree).first().asDict()
    assert first["files"] == len(FIXTURES) + 1 and first["function"] >= 12 and first["impl"] == 1
    assert engine.index_directory(tree).first().asDict() == first
    assert [r.name for r in engine.dependencies("load").collect()] == ["Row", "append", "default", "push", "read", "walk"]
    assert [r.name for r in engine.impact("function:?:`measure`").collect()] == ["Shape::area"] or [r.name for r in engine.impact("measure").collect()] == ["area"]
    assert engine.find_function("flush").first()["file_path"] == "src/queue.ts"
    assert engine.search("async load rows", 3).count() == 3 and "### " in engine.context("load rows")
    nodes, edges = engine.graph()
    assert nodes.where("category = 'impl'").first()["label"] == "Area for Shape"
    assert {r.rel for r in edges.collect()} == {"calls", "implements", "has_method"}
    assert '"nodes"' in engine.graph_json().first()["json"]
    engine.write_graph(str(tmp_path / "graph"))
    whole, written = json.loads(engine.graph_json().first()["json"]), json.loads("".join(documents.read_document(str(tmp_path / "graph"), 1)))
    assert all(sorted(map(str, whole[k])) == sorted(map(str, written[k])) for k in ("nodes", "edges")) and written["edges"]
    with open(os.path.join(tree, "src/View.kt"), "w") as f:
        f.write("class Other {\n    fun draw() {\n        fill(1)\n    }\n}\n")
    engine.index_directory(tree)
    assert {r.name for r in engine.entities("struct").where("file_path = 'src/View.kt'").collect()} == {"Other"}
    assert engine.impact("paint").count() == 0 and engine.impact("fill").count() == 1
    engine.remove_file("src/View.kt")
    assert engine.table("entity").where("file_path = 'src/View.kt'").count() == 0 and engine.impact("fill").count() == 0


def test_last_and_first_wins(spark):
    rows = [("function", 1, "a", "m::a", "f.rs", 1), ("struct", 1, "a", "a", "g.rs", 2), ("function", 2, "b", "b", "f.rs", 3), ("function", 3, "b", "b", "h.rs", 4)]
    e = spark.createDataFrame([(*r, r[5] + 1, None, None, None) for r in rows], "family string, ordinal long, name string, qualified_name string, file_path string, start_line int, end_line int, target_type string, trait_name string, parent string")
    for n in (1, 7):
        ids = {r.id: r.key for r in graph.id_map(e.repartition(n)).collect()}
        assert ids["a"] == "struct:g.rs:2:a" and ids["m::a"] == "fn:f.rs:1:a" and ids["b"] == "fn:h.rs:4:b" and ids["function:f.rs:b"] == "fn:f.rs:3:b"


@pytest.mark.parametrize("one_task", [context.ONE_TASK, 10])
def test_budget_stops_at_the_first_overflow(spark, monkeypatch, one_task):
    monkeypatch.setattr(context, "ONE_TASK", one_task)
    draw = random.Random(1)
    for _ in range(6):
        files = [(f"p{k:03}", draw.choice([0, 0, 5, 20, 60, 200])) for k in range(40)]
        want, total = [], 0
        for path, size in files:
            if size > 100:
                continue
            if total + size > 300:
                break
            total += size
            want.append(path)
        found = context.within_budget(spark.createDataFrame(files, "path string, size long"), max_file=100, max_total=300)
        assert sorted(r.path for r in found.collect()) == want


def test_tree_text(spark, tmp_path):
    files = spark.createDataFrame([("b.rs",), ("a/z.rs",), ("a/c/d.rs",)], "path string")
    context.write_tree(files, str(tmp_path / "tree"))
    assert "".join(documents.read_document(str(tmp_path / "tree"))) == context.rendered_tree(files)
    assert context.rendered_tree(files) == "├── a/\n│   ├── c/\n│   │   └── d.rs\n│   └── z.rs\n└── b.rs"


def test_documents_are_written_in_order(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 2).cast("int").alias("section"), F.col("id").alias("k"), F.concat(F.lit("r\u00e9"), "id").alias("text"))
    to = str(tmp_path / "doc")
    for n in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            documents.write_document(rows.repartition(3), to, ("k",), head="<", between=",", joint="|", tail=">")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert "".join(documents.read_document(to)) == "<" + ",".join(f"ré{k}" for k in range(0, 5000, 2)) + "|" + ",".join(f"ré{k}" for k in range(1, 5000, 2)) + ">"
    documents.write_document(rows.limit(0), to, ("k",), head="[", joint="][", tail="]")
    assert "".join(documents.read_document(to, 1)) == "[][]" and os.listdir(to) == [documents.MANIFEST]
    documents.write_document(rows.where("k < 4").withColumn("section", F.lit(2)), to, ("k",), head="[", joint="|", tail="]")
    assert "".join(documents.read_document(to)) == "[||ré0\nré1\nré2\nré3]"
    with pytest.raises(Exception, match="lost"):
        documents.write_document(rows.withColumn("text", F.when(F.col("k") == 4999, F.raise_error(F.lit("lost"))).otherwise("x")), str(tmp_path / "none"), ("k",))
    assert not os.path.exists(tmp_path / "none" / documents.MANIFEST)


def test_text_functions(spark):
    row = spark.range(1).select(
        X.simple_name(F.lit("impl a::Bc<T>")).alias("a"), X.task_name(F.lit(" Add  the New: parser, quickly please ")).alias("b"), X.json_block(F.lit('x {"k": 1} y')).alias("c"), X.sse_token(F.lit("data: [DONE]")).alias("d"),
        X.html_escaped(F.lit("<a & 'b'>")).alias("e"), X.occurrences(F.lit("ififx"), "if").alias("f"), X.extension(F.lit("a/.bashrc")).alias("g"), X.bare_name(F.lit("function:?:`m`")).alias("h"), X.without_prefix(F.lit("/r/a/b"), "/r").alias("i"),
    ).first()
    assert tuple(row) == ("Bc", "add-the-new-parser-quickly", '{"k": 1}', None, "&lt;a &amp; &#39;b&#39;&gt;", 2, "", "m", "a/b")


def test_tasks(spark):
    record = tasks.created("Fix the slow search in big repositories now")
    assert record["name"] == "fix-the-slow-search-in" and record["phase"] == "research"
    answer = '```json\n{"summary": "s", "findings": [{"title": "t", "description": "d"}], "dependencies": [], "suggested_approach": "a"}\n```'
    found = spark.createDataFrame([(answer,), ('{"summary": "s"}',)], "a string").select(tasks.parsed_answer(F.col("a")).alias("p")).collect()
    assert found[0].p.findings[0].related_files == [] and found[1].p is None
    assert tasks.markdown({"task_name": "n", "summary": "s", "suggested_approach": "a"}).startswith("# Research: n")


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[context]\nmax_file_size = 5\n[storage]\ndata_dir = "/d"\n')
    loaded = config.load([str(tmp_path / "none.toml"), str(path)], {"TESSERA_DATA_DIR": "/e"})
    assert loaded.context.max_file_size == 5 and loaded.storage.data_dir == "/e" and loaded.llm.max_tokens == 4096
    assert config.load([], {"TESSERA_DATA_DIR": "/e"}) == config.Config()
    path.write_text("not toml [")
    assert config.load([str(path)], {}) == config.Config()


def test_stream_equals_batch(spark, sf, tmp_path):
    from tessera.streaming.ingest import ingest

    source = tmp_path / "in"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(source))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    path = F.col("doc_id").cast("string")
    found = ingest(spark, str(source), schema, str(tmp_path / "store"), path, F.col("text"))
    want = corpus.file_rows(docs.select(path.alias("path"), F.col("text").alias("content")))
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
    again = ingest(spark, str(source), schema, str(tmp_path / "store"), path, F.col("text"))
    assert again.count() == want.count()


def test_cosine_and_embedder(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id int, embedding array<double>")
    assert [(r.id, r.score) for r in V.top_k(rows, [2.0, 0.0], 2, ties=("id",)).collect()] == [(1, 1.0), (2, 0.707107)]
    embed = V.hashing_embedder(16)
    assert embed(["a b"]) == embed(["a b"]) and embed([]) == [] and len(embed([""])[0]) == 16


def test_without_the_training_operators(tmp_path):
    """The library and the entry point work without the subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
