"""Extraction hands on only what is asked for, and looks no file up again."""

import pyarrow as pa
import pytest

from tessera.operators import extract
from tessera.plans import extraction

FILES = [("a.py", "def fine(x):\n    go(x)\n"), ("b.py", "def broken(:\n    pass\n"), ("c.rs", "pub static N: u32 = 1;\n"), ("d.kt", "class Kt {\n}\n"), ("e.py", "")]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def test_failed_files_are_not_joined_again(files):
    plan = extract.extracted(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "path#" not in "".join(x for x in plan.split("\n") if "LeftSemi" in x) and "MapIn" not in plan  # parsed once, stored


@pytest.mark.parametrize("wanted", [("static",), ("function", "calls"), ("contains",), ("struct", "static"), None])
def test_only_what_is_wanted_is_given(files, wanted):
    every = extract.extracted(files).collect()
    own = [r for r in every if wanted is None or (r.edge_type or r.kind) in wanted]
    assert own
    rows = extract.extracted(files, ("file_path", "ordinal", "name", "dst"), wanted)
    assert rows.columns == ["file_path", "ordinal", "name", "dst"]
    assert sorted(map(str, rows.collect())) == sorted(str(r) for r in [type(rows.first())(file_path=r.file_path, ordinal=r.ordinal, name=r.name, dst=r.dst) for r in own])


def test_kinds_that_patterns_never_give_are_one_pass(spark, sf):
    for name in ("list_statics", "list_enums", "list_impls", "list_traits", "list_constants", "list_implements"):
        plan = extraction.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "ExistingRDD" not in plan and "Union" not in plan and "Window" not in plan, name


def test_hidden_parts_keep_their_lines():
    text = 'a "b\\"c" /* x /* y */\nz */ d // e\n\'f\' \'g "h'
    shown = extract.masked(text, quotes="\"'", nested=True, chars=True)
    assert [len(x) for x in shown.split("\n")] == [len(x) for x in text.split("\n")] and shown.split() == ["a", '"', '"', "d", "'", "'", "'g", '"']
    assert extract.masked("x /* y", nested=True) == "x     "
    assert extract.split_top("a<b, c>, d -> e, (f, g)") == ["a<b, c>", "d -> e", "(f, g)"] and extract.split_top(" a,, b ") == ["a", "b"]


def test_constructors_are_found_by_the_class_name():
    rows = extract.extract_file("A.java", "class A {\n  public A(int x) { go(x); }\n  public static B make() { return new B(); }\n}\n")
    assert [r["name"] for r in rows if r["kind"] == "function"] == ["A", "make"]


def test_rows_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(extract, "HANDED", 2)
    made = extract.parsed(spark.createDataFrame([(f"{k}.py", "def f():\n    g()\n") for k in range(20)], "path string, content string").coalesce(1), ("name",))
    assert made.count() == 60


@pytest.mark.parametrize("columns", [("edge_type",), ("ordinal", "name", "doc_comment", "visibility"), ("signature", "start_line", "end_line", "is_in_loop"), ("fields", "cyclomatic", "bases", "attributes")])
def test_only_asked_columns_are_made_and_are_the_same(monkeypatch, columns):
    columns = (*columns, "file_path", "kind")
    every = {p: extract.extract_file(p, t) for p, t in extraction.FIXTURES.items() if t}
    if "doc_comment" not in columns:
        monkeypatch.setattr(extract.Source, "doc", None)  # can't be called
    with extract.asking(columns):
        made = {p: extract.extract_file(p, t) for p, t in extraction.FIXTURES.items() if t}
    assert {p: rows and [{c: r.get(c) for c in columns} for r in rows] for p, rows in made.items()} == {p: rows and [{c: r[c] for c in columns} for r in rows] for p, rows in every.items()}
    assert extract.extract_file("a.py", "def f(): pass")[0].keys() == set(extract.COLUMNS)


def test_answers_are_parsed_once(spark, sf):
    from tessera.plans import catalogue

    plan = catalogue.QUERIES["answer_parse"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") == 1


def test_constructors_are_sought_only_where_their_name_is_called(monkeypatch):
    made = {p: extract.extract_file(p, t) for p, t in extraction.FIXTURES.items() if p.endswith((".java", ".cs"))}
    monkeypatch.setattr(extract, "_CONSTRUCTOR", None)  # can't be searched
    assert made and all(made.values()) and made == {p: extract.extract_file(p, extraction.FIXTURES[p]) for p in made}


def test_batches_are_made_of_what_rows_have():
    kinds = pa.schema([("a", pa.string()), ("n", pa.int32()), ("items", pa.list_(pa.struct([("name", pa.string())]))), ("none", pa.bool_())])

    class Row(dict):
        def get(self, *_):
            raise AssertionError("each column asks each row")

    rows = [Row(a="x", n=1), Row(a="y", items=[{"name": "p"}], more=5), Row(a="z", n=None, items=[]), Row(a="", none=False)]
    made = extract._batch(rows, kinds)
    assert made.schema == kinds and made.to_pylist() == [{k: dict.get(r, k) for k in kinds.names} for r in rows]
    assert extract._batch([], kinds).to_pylist() == []


def test_rust_items_begin_at_lines_and_unbalanced_files_are_not_scanned(monkeypatch):
    text = "/* pub fn no() { */\npub(crate)\n  async fn a() { b(); }\n  x fn c() {}\nconst D: [u8; 1]\n= [1]; static E: u8 = 1;\n\tstatic F: u8 = 2;\nimpl A for B { fn g(&self) {} pub fn h() {} }\n"
    assert [(r["kind"], r["name"]) for r in extract.rust("a.rs", text) if r["kind"] != "edge"] == [("function", "a"), ("const", "D"), ("static", "F"), ("impl", "A_for_B"), ("function", "g"), ("function", "h")]
    monkeypatch.setattr(extract, "Source", None)  # can't be made
    assert extract.extract_file("a.rs", "fn a() {\n  b();\n") is None


def test_names_of_fields_are_read_alone(spark, sf):
    plan = extraction.QUERIES["extract_typescript"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "fields#" in plan and "lambdafunction" not in plan
