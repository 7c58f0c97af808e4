"""Patterns, block ends, containment: table operators against plain loops over each file."""

import random

import pytest
from plain import block_end, fallback
from pyspark.sql import functions as F

from tessera.operators import blocks, extract

LINES = [
    "pub struct Ab {", "  x: u8,", "}", "", "export async function go(x) {", "    if (x) { run(x); }", "  }", "class Q {", " public static one(y) {", "  const f = async (a) => b(a);", "async def foo(x):", "    return bar (x)",
    "func (r *T) Met(x int) {", "interface I {", "pub enum E { A, B }", "type T struct {", "pub async fn z(w: W) {", "  call", "(x)", "\t", "é = 1", "while (x) {", "} else {", "abstract class Zed:", "private void go2 (int x) {", "  fn weird()", "}}", "{{", "def ünder(ß):",
]


def known(rows):
    return [{k: v for k, v in r.items() if v is not None} for r in rows]


def test_fallback_equals_plain_loops(spark):
    draw = random.Random(1)
    files = [(f"f{k}", "\n".join(draw.choices(LINES, k=draw.randint(0, 70))) + draw.choice(["", "\n", "\r\n"])) for k in range(120)] + [("none", None), ("blank", "\n\n"), ("one", "fn a(")]
    files.append(("long", "\n".join(["struct Deep {"] * 400 + ["}"] * 399 + ["fn a() {", "  b()"] * 300)))
    found = {}
    for r in blocks.fallback_rows(spark.createDataFrame(files, "path string, content string")).orderBy("file_path", "ordinal").collect():
        found.setdefault(r.file_path, []).append(r.asDict(True))
    for path, text in files:
        assert known(found.get(path, [])) == known(fallback(path, text or "")), path
    assert blocks.fallback_rows(spark.createDataFrame([], "path string, content string")).count() == 0


def test_block_ends_of_every_line(spark):
    draw = random.Random(2)
    texts = {f"f{k}": draw.choices(LINES, k=draw.randint(1, 120)) for k in range(25)}
    texts["deep"] = ["{" * 3] * 50 + ["}"] * 149 + ["x", "}"]
    files = spark.createDataFrame([(p, "\n".join(t) + "\n") for p, t in texts.items()], "path string, content string")
    lines = blocks.lines_table(files)
    found = {(r.file_path, r.line): r.end for r in blocks.block_ends(lines, lines.select("file_path", "line")).collect()}
    assert found == {(p, k): block_end(t, k) for p, t in texts.items() for k in range(len(t))}


@pytest.mark.parametrize("block", [1, 7, 64])
def test_every_range_around_a_part_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    draw = random.Random(block)
    ranges = [(draw.choice("ab"), a, a + draw.choice([0, 1, 5, 80, 400]), k) for k, a in enumerate(draw.choices(range(1, 300), k=60))]
    parts = [(draw.choice("ab"), a, a + draw.choice([0, 0, 1, 9]), k) for k, a in enumerate(draw.choices(range(1, 500), k=150))]
    got = blocks.contained_in(spark.createDataFrame(ranges, "file_path string, first int, last int, range int"), spark.createDataFrame(parts, "file_path string, start_line int, end_line int, part int"))
    assert sorted((r.range, r.part) for r in got.collect()) == sorted((r[3], p[3]) for r in ranges for p in parts if r[0] == p[0] and r[1] <= p[1] and p[2] <= r[2])
    assert got.columns == ["file_path", "start_line", "end_line", "part", "range"]


def test_methods_have_the_innermost_struct(spark):
    text = "class A {\n  class B {\n    fun one() {\n    }\n  }\n  fun two() {\n  }\n}\nfun three() {\n}\n"
    rows = blocks.fallback_rows(spark.createDataFrame([("f", text)], "path string, content string"), with_methods=True)
    assert sorted((r.src, r.dst) for r in rows.where("edge_type = 'has_method'").collect()) == [("struct:f:A", "function:f:two"), ("struct:f:B", "function:f:one")]


def test_files_that_a_parser_cannot_read_are_read_by_patterns(spark, monkeypatch):
    monkeypatch.setitem(extract.PARSERS, "odd", lambda path, text: [][1])  # registered in the driver only
    files = [("a.py", "def fine():\n    pass\n"), ("b.py", "def broken(:\n    pass\n"), ("c.odd", "class Odd {\n}\n"), ("d.kt", "class Kt {\n}\n"), ("e.py", None), ("f", "class NoExtension {\n}\n")]
    rows = extract.extracted(spark.createDataFrame(files, "path string, content string")).where("edge_type is null").select("file_path", "kind", "name").distinct().collect()
    assert sorted(tuple(r) for r in rows) == [("a.py", "function", "fine"), ("b.py", "function", "broken"), ("c.odd", "struct", "Odd"), ("d.kt", "struct", "Kt"), ("f", "struct", "NoExtension")]


def test_no_operator_of_blocks_runs_python(spark):
    plan = blocks.fallback_rows(spark.createDataFrame([("a", "b")], "path string, content string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_matches_keep_offsets(spark):
    files = spark.createDataFrame([("f", "fn a\n\n\n fn b\nx\nfn\n c"), ("g", "x")], "path string, content string")
    got = blocks.matches(files, {0: blocks.FUNCTION_PATTERNS[0][0]}).orderBy("k").collect()
    assert [(r.start_line, r.end_line, r.whole) for r in got] == [(1, 1, "fn a"), (2, 4, "\n\n fn b"), (6, 7, "fn\n c")]
    assert blocks.matches(files, {0: r"x"}).agg(F.count(F.lit(1))).first()[0] == 2


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(text):
        read.add(1)
        return text

    files = spark.createDataFrame([(f"f{k}", "fn a() {\n  b()\n}\n") for k in range(20)], "path string, content string").withColumn("content", F.udf(counted)("content"))
    assert blocks.fallback_rows(files).where("kind = 'function'").count()
    assert read.value == 20
