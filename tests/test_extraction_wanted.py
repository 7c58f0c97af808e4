"""Extraction of some kinds only: the same rows as from whole extraction, without making the others."""

import random

import pytest

from tessera.operators import extract
from tessera.plans import extraction

KINDS = [(kind,) for kind in extraction.LISTINGS] + [("calls",), ("contains", "extends"), ("implements", "returns_type", "trait")]


def damaged(draw, text):
    for _ in range(draw.randrange(4)):
        k = draw.randrange(len(text) + 1)
        text = text[:k] + draw.choice(["", "{", "}", "(", ")", '"', "fn x(", "class A {", "\n", ";"]) + text[k + draw.randrange(3) :]
    return text


def made(path, text, wanted):
    try:
        rows = extract.extract_file(path, text)
    except (AttributeError, TypeError) as error:  # some malformed Rust
        return type(error).__name__
    return rows if rows is None else [{k: v for k, v in r.items() if k != "ordinal"} for r in rows if (r.get("edge_type") or r["kind"]) in wanted]


@pytest.mark.parametrize("wanted", KINDS, ids="-".join)
def test_only_wanted_rows_are_made_and_they_are_the_same(wanted):
    draw = random.Random(7)
    for path, text in [(p, damaged(draw, t)) for p, t in extraction.FIXTURES.items() if t for _ in range(60)]:
        with extract.asking(extract.COLUMNS):
            every = made(path, text, wanted)
        with extract.asking(extract.COLUMNS, wanted):
            own = made(path, text, wanted)
            if isinstance(every, str):
                continue
            assert own == every
            rows = extract.extract_file(path, text) or []
        assert all((r.get("edge_type") or r["kind"]) in wanted for r in rows)
        assert [r["ordinal"] for r in rows] == sorted({r["ordinal"] for r in rows})


def test_firsts_are_made_without_a_shuffle(spark):
    files = spark.createDataFrame([("a.ts", "class A {}\nclass B {}\nclass A { x: number; }\n"), ("b.kt", "class A {\n}\nclass A {\n}\n")], "path string, content string")
    rows = extract.extracted(files, ("id", "name", "start_line", "file_path", "ordinal"), ("struct",), firsts=True)
    assert sorted((r.id, r.start_line) for r in rows.collect()) == [("struct:a.ts:A", 1), ("struct:a.ts:B", 2), ("struct:b.kt:A", 1)]
    parsed = extract.parsed(files, ("id", "ordinal"), ("struct",), firsts=True)
    assert "Exchange" not in parsed._jdf.queryExecution().sparkPlan().toString() and parsed.where("kind = 'struct'").count() == 2
