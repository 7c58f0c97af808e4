"""Queries of the pattern extraction over code that is made of the documents, each with its DuckDB SQL.

The test tables hold no code, so every line of a document becomes one: the line's number and the document's id choose one of
the shapes below, its first two words are the names in it. Documents so become files with nested, overlapping and unclosed
blocks in which all patterns occur. The SQL finds block ends, containment and calls by comparing lines with lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators.stats import CALL_KEYWORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SHAPES = (
    "pub struct A {", "    field: B,", "}", "export async function a(b) {", "    if (b) { a(b); }", "}", "abstract class A {", "  public static a(b) {", "    const b = async (a) => b(a);", "  }", "}", "async def a(b):",
    "    return b(a)", "func (r *A) b(x int) {", "} else {", "interface A {", "pub enum A { B, C }", "type A struct {", "}", "pub async fn a(b: B) {", "  b (a);", "}", "private void b(int a) {", "  while (a) { b(); }", "",
)


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def code(spark: SparkSession, sf: str) -> DataFrame:
    """path, content."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shapes = F.array(*map(F.lit, SHAPES))

    def shaped(words: F.Column, i: F.Column) -> F.Column:
        named = lambda k, lone: F.coalesce(F.get(words, F.lit(k)), F.lit(lone))
        shape = F.get(shapes, F.pmod(F.col("doc_id") + i, F.lit(len(SHAPES))))
        for own, name in (("A", F.initcap(named(0, "x"))), ("B", F.initcap(named(1, "y")))):
            shape = F.regexp_replace(shape, F.lit(rf"\b{own}\b"), name)
        for own, name in (("a", F.lower(named(0, "x"))), ("b", F.lower(named(1, "y")))):
            shape = F.regexp_replace(shape, F.lit(rf"\b{own}\b"), name)
        return F.when(F.size(words) > 0, shape).otherwise("")

    words = F.transform(F.split("text", "\n"), lambda line: F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0)))  # made once a line
    lines = F.transform(words, shaped)
    return docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".kt")).alias("path"), F.array_join(lines, "\n").alias("content"))


def _pattern_sql() -> str:
    """file_path, pattern, line (from 0), name, kind of every match: shapes hold no pattern across lines but for blank ones in front."""
    parts = []
    for n, (kind, pattern, stop) in enumerate(blocks.PATTERNS):
        groups = ["regexp_extract(text, p, 0)"] + [f"regexp_extract(text, p, {g})" for g in range(1, pattern.count("(") - pattern.count(r"\(") + 1)]
        words = f"list_filter(list_transform([{', '.join(groups)}], lambda w: trim(w)), lambda w: regexp_full_match(w, '\\w+')" + (f" AND w NOT IN {stop}" if stop else "") + ")"
        parts.append(f"SELECT file_path, {n} AS pattern, '{kind}' AS kind, line, begins, regexp_extract(text, p, 0) AS whole, {words} AS words FROM led, (SELECT '{pattern.removeprefix('(?m)')}' AS p) WHERE regexp_matches(text, p)")
    return " UNION ALL ".join(parts)


_SHAPED = f"""list_transform(string_split(text, chr(10)), lambda line, i: CASE WHEN regexp_matches(line, '[A-Za-z]') THEN [{', '.join(repr(s) for s in SHAPES)}][(doc_id + i - 1) % {len(SHAPES)} + 1] ELSE '' END)"""
_WORDS = "list_transform(string_split(text, chr(10)), lambda line: regexp_extract_all(line, '[A-Za-z]+'))"


def _in_place(shape: str) -> str:
    upper = lambda k, lone: f"upper(left(coalesce(w[{k}], '{lone}'), 1)) || lower(substr(coalesce(w[{k}], '{lone}'), 2))"
    for own, name in (("A", upper(1, "x")), ("B", upper(2, "y")), ("a", "lower(coalesce(w[1], 'x'))"), ("b", "lower(coalesce(w[2], 'y'))")):
        shape = rf"regexp_replace({shape}, '\b{own}\b', {name}, 'g')"
    return shape


CODE = f"""code AS (
  SELECT 'd/' || CAST(doc_id AS VARCHAR) || '.kt' AS file_path, i - 1 AS line, {_in_place('shape')} AS text
  FROM (SELECT doc_id, i, s[i] AS shape, w[i] AS w FROM (SELECT doc_id, {_SHAPED} AS s, {_WORDS} AS w, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
), sized AS (SELECT *, max(line) OVER (PARTITION BY file_path) + 1 AS all_lines, last_value(text) OVER (PARTITION BY file_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM code
), lines AS (SELECT * EXCLUDE (all_lines, final), all_lines - CASE WHEN final = '' THEN 1 ELSE 0 END AS n FROM sized WHERE final <> '' OR line + 1 < all_lines
), led AS (SELECT *, coalesce(max(CASE WHEN text <> '' THEN line END) OVER (PARTITION BY file_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS begins FROM lines
), matched AS ({_pattern_sql()}
), named AS (SELECT *, words[-1] AS name FROM matched WHERE len(words) > 0 AND (kind = 'struct' OR words[-1] NOT IN {blocks.NO_FUNCTION})
), starts AS (SELECT DISTINCT file_path, begins AS line FROM named
), ahead AS (
  SELECT s.file_path, s.line, l.line AS k, l.n, l.text, f.text AS head, sum(length(l.text) - length(replace(l.text, '{{', '')) - length(l.text) + length(replace(l.text, '}}', ''))) OVER w AS balance, bool_or(contains(l.text, '{{') OR ends_with(trim(l.text), ':')) OVER w AS opened
  FROM starts s JOIN lines f USING (file_path, line) JOIN lines l ON l.file_path = s.file_path AND l.line >= s.line WINDOW w AS (PARTITION BY s.file_path, s.line ORDER BY l.line)
), closed AS (
  SELECT file_path, line, min(k) FILTER (opened AND balance <= 0 AND k > line) AS k, any_value(n) AS n, arg_min(text, k) FILTER (opened AND balance <= 0 AND k > line) AS text, any_value(head) AS head FROM ahead GROUP BY file_path, line
), ends AS (
  SELECT file_path, line, CAST(CASE WHEN k IS NULL THEN least(line + 50, n) WHEN trim(text) <> '' AND NOT contains(text, '}}') AND length(text) - length(ltrim(text)) <= length(head) - length(ltrim(head)) THEN k ELSE k + 1 END AS INT) AS end_line FROM closed
), definitions AS (
  SELECT named.file_path, pattern, kind, name, CAST(begins + 1 AS INT) AS start_line, end_line, CASE WHEN contains(whole, 'pub') OR contains(whole, 'export') THEN 'public' ELSE 'private' END AS visibility, CASE WHEN kind = 'function' THEN contains(whole, 'async') END AS is_async
  FROM named JOIN ends ON ends.file_path = named.file_path AND ends.line = begins
)"""
# `contains` of the whole match sees the same as in the match with its leading blank lines


@query(f"WITH {CODE} SELECT file_path, pattern, kind, name, start_line, end_line, visibility, is_async FROM definitions")
def legacy_definitions(spark, sf):
    """What the eleven patterns find in every file, with the ends of blocks."""
    named, _ = blocks.located(code(spark, sf))
    return named.select("file_path", "pattern", "kind", "name", "start_line", "end_line", "visibility", "is_async")


for _n, _label in enumerate(("struct", "enum", "class", "go_struct", "interface", "fn", "function", "arrow", "def", "func", "typed")):

    def _one(spark, sf, n=_n):
        found = blocks.definitions(blocks.matches(code(spark, sf), {n: blocks.PATTERNS[n][1]}))
        return found.select("file_path", "k", "name", "start_line", "visibility", "is_async")

    QUERIES[f"legacy_pattern_{_label}"] = _one
    ORACLE_SQL[f"legacy_pattern_{_label}"] = f"WITH {CODE}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_path ORDER BY line) - 1 AS INT) AS k FROM matched WHERE pattern = {_n}) SELECT file_path, k, name, start_line, visibility, is_async FROM definitions JOIN (SELECT file_path, k, CAST(begins + 1 AS INT) AS start_line FROM k) USING (file_path, start_line) WHERE pattern = {_n}"


@query(f"WITH {CODE} SELECT file_path, line, end_line AS \"end\" FROM ends")
def block_ends(spark, sf):
    files = code(spark, sf)
    named = blocks.definitions(blocks.matches(files, {n: p for n, (_, p, _) in enumerate(blocks.PATTERNS)}))
    return blocks.block_ends(blocks.lines_table(files), named.select("file_path", (F.col("start_line") - 1).alias("line")))


CALLED = f"""{CODE}, calls AS (
  SELECT file_path, line + 1 AS line, unnest(regexp_extract_all(text, '(\\w+)\\s*\\(', 1)) AS callee FROM lines
), kept AS (SELECT * FROM calls WHERE callee NOT IN {CALL_KEYWORDS})"""


@query(f"WITH {CALLED} SELECT 'function:' || file_path || ':' || name AS id, pattern, callee, count(*) AS n FROM definitions JOIN kept USING (file_path) WHERE kind = 'function' AND line BETWEEN start_line AND end_line GROUP BY ALL")
def calls_of_bodies(spark, sf):
    """Nested bodies have the calls of the inner ones too."""
    named, calls = blocks.located(code(spark, sf))
    return blocks.calls_of_bodies(named, calls).groupBy("id", "pattern", "callee").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CODE}, f AS (SELECT DISTINCT file_path, start_line, end_line, 'function:' || file_path || ':' || name AS id FROM definitions WHERE kind = 'function'),
s AS (SELECT DISTINCT file_path, start_line AS a, end_line AS b, 'struct:' || file_path || ':' || name AS parent FROM definitions WHERE kind = 'struct')
SELECT file_path, parent, id FROM f JOIN s USING (file_path) WHERE a <= start_line AND end_line <= b QUALIFY row_number() OVER (PARTITION BY file_path, start_line, end_line, id ORDER BY a DESC, b, parent DESC) = 1""")
def has_method(spark, sf):
    """Each function with the innermost struct around it."""
    return blocks.methods(blocks.located(code(spark, sf))[0])


@query(f"""WITH {CALLED}, rows AS (
  SELECT file_path, kind AS label, count(*) AS n FROM definitions GROUP BY ALL UNION ALL SELECT file_path, 'contains', count(*) FROM definitions GROUP BY ALL
  UNION ALL SELECT file_path, 'calls', count(*) FROM definitions JOIN kept USING (file_path) WHERE kind = 'function' AND line BETWEEN start_line AND end_line GROUP BY ALL)
SELECT * FROM rows""")
def fallback_counts(spark, sf):
    """Nodes and edges of the whole fallback, by file."""
    rows = blocks.fallback_rows(code(spark, sf))
    return rows.groupBy("file_path", F.coalesce("edge_type", "kind").alias("label")).agg(F.count(F.lit(1)).alias("n"))
