"""Chunks whose texts nobody asks for have none made."""

import pytest

from tessera.operators import chunking
from tessera.plans import catalogue


@pytest.mark.parametrize("columns", [("file_path", "start_line", "end_line"), ("end_line", "ordinal"), ("content", "file_path")])
@pytest.mark.parametrize("fixed", [False, True])
def test_columns_are_those_of_whole_chunks(spark, columns, fixed):
    texts = ["", None, "\n \n", "a\n" * 900, "b" * 2500 + "\n\n", ("c" * 99 + "\n") * 10 + " \n", "\r\n".join(["d" * 300] * 9)]
    files = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "path string, content string")
    made = chunking.chunks(files, fixed=fixed, columns=columns)
    assert made.columns == list(columns)
    assert sorted(made.collect()) == sorted(chunking.chunks(files, fixed=fixed).select(*columns).collect())


@pytest.mark.parametrize("name", ["chunk_stats", "chunk_spans"])
def test_texts_do_not_leave_python(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    made = next(x for x in plan.split("\n") if "MapInArrow" in x)
    assert "content" not in made.partition("]")[2], made
    assert "content" not in chunking.chunks(spark.createDataFrame([("a", "b")], "path string, content string"), columns=("file_path",)).columns
