"""Structs, functions and calls of files without a parser, as table operators: patterns, block ends and containment.

Everything is native and keyed by path, which is unique, as in the table of files. A file is a table of lines here, so that
running sums, not loops, find where a block ends, and lines meet ranges by a join. Joins are by shuffles (hint "merge"):
estimates are of compressed files, by which tables of many times that size would be broadcast by way of the driver.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X
from tessera.operators.chunking import lines_of
from tessera.operators.stats import CALL_KEYWORDS
from tessera.session import stored

# The fallback's patterns and stop words.
STRUCT_PATTERNS = (r"(?m)^(\s*)(pub\s+)?struct\s+(\w+)", r"(?m)^(\s*)(pub\s+)?enum\s+(\w+)", r"(?m)^(\s*)(export\s+|public\s+|abstract\s+)?(class)\s+(\w+)", r"(?m)^(\s*)type\s+(\w+)\s+struct", r"(?m)^(\s*)(export\s+|public\s+)?interface\s+(\w+)")
FUNCTION_PATTERNS = (
    (r"(?m)^(\s*)(pub\s+)?(async\s+)?fn\s+(\w+)", True), (r"(?m)^(\s*)(export\s+)?(async\s+)?function\s+(\w+)", True),
    (r"(?m)^(\s*)(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(async\s*)?\([^)]*\)\s*=>", False), (r"(?m)^(\s*)(async\s+)?def\s+(\w+)", True), (r"(?m)^(\s*)func\s+(\([^)]*\)\s+)?(\w+)", False),
    (r"(?m)^(\s*)(public|private|protected)?\s*(static\s+)?(async\s+)?(\w+)\s+(\w+)\s*\(", False),
)
STRUCT_STOP = ("pub", "export", "public", "class", "struct", "abstract")
FUNCTION_STOP = ("pub", "async", "fn", "function", "export", "const", "let", "var", "def", "func", "public", "private", "protected", "static")
NO_FUNCTION = ("if", "for", "while", "match", "switch", "return", "new", "void", "int", "string", "bool")
CALL_PATTERN = r"\b(\w+)\s*\("
DEFAULT_LINES = 50
#: Kinds of nodes and types of edges that patterns give.
GIVEN = frozenset(("struct", "function", "contains", "calls", "has_method"))

#: Lines of a block of the containment join.
BLOCK = 64
#: kind, pattern, words that are no name.
PATTERNS = tuple(("struct", p, STRUCT_STOP) for p in STRUCT_PATTERNS) + tuple(("function", p, FUNCTION_STOP if simple else ()) for p, simple in FUNCTION_PATTERNS)
CALLS = len(PATTERNS)


def _java(pattern: str) -> str:
    """A pattern whose classes know all of Unicode and in which only a line feed ends a line."""
    return "(?Ud)" + pattern


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _found(patterns: Mapping[int, str]) -> Column:
    """An array of all matches of all patterns in content: pattern, k (from 0), whole, and the line ends before it, since the pattern's last match, and within.

    A pattern matches no empty string.
    """

    def found(n: int, p: str) -> Column:
        between = F.split("content", _java(p))
        return F.transform(
            F.arrays_zip(F.regexp_extract_all("content", F.lit(_java(p)), F.lit(0)).alias("whole"), F.transform(between, _newlines).alias("before")),
            lambda m, k: F.struct(F.lit(n).alias("pattern"), k.alias("k"), m["whole"].alias("whole"), m["before"].alias("before"), _newlines(m["whole"]).alias("within")),
        )

    return F.filter(F.concat(*[found(n, p) for n, p in patterns.items()]), lambda m: m["whole"].isNotNull())  # what lies behind the last match has none


def _placed(rows: DataFrame) -> DataFrame:
    """file_path, found → file_path, pattern, k, start_line, end_line, whole."""
    rows = rows.select("file_path", F.explode("found").alias("m")).select("file_path", "m.*")
    order = Window.partitionBy("file_path", "pattern").orderBy("k")
    line = F.sum(F.col("before") + F.col("within")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return rows.select("file_path", "pattern", "k", (line - F.col("within")).cast("int").alias("start_line"), line.cast("int").alias("end_line"), "whole")


def matches(files: DataFrame, patterns: Mapping[int, str]) -> DataFrame:
    """file_path, pattern (its number), k (from 0), start_line, end_line, whole: all matches of all patterns, in one pass over the texts.

    What lies between the matches of a pattern says, by its line ends, on which line each begins; of texts only the matches
    are shuffled. A pattern matches no empty string.
    """
    return _placed(files.select(F.col("path").alias("file_path"), _found(patterns).alias("found")))


def _named(pattern: str, stop: tuple[str, ...]) -> Column:
    """The last group, trimmed, that is a word and none of the stop words; null if none is."""
    groups = [F.col("whole"), *[F.regexp_extract("whole", _java(pattern), g) for g in range(1, re.compile(pattern).groups + 1)]]
    words = F.transform(F.array(*groups), X.trimmed)
    return F.get(F.reverse(F.filter(words, lambda w: X.word(w) & ~w.isin(*stop) if stop else X.word(w))), F.lit(0))


def definitions(found: DataFrame) -> DataFrame:
    """file_path, pattern, k, kind, name, start_line, visibility, is_async of matches of PATTERNS that name something."""
    own = found.where(F.col("pattern") < CALLS)
    pick = lambda values: functools.reduce(lambda c, nv: c.when(F.col("pattern") == nv[0], nv[1]), enumerate(values[1:], 1), F.when(F.col("pattern") == 0, values[0]))
    kind = F.when(F.col("pattern") < len(STRUCT_PATTERNS), "struct").otherwise("function")
    public = F.col("whole").contains("pub") | F.col("whole").contains("export")
    rows = own.select(
        "file_path", "pattern", "k", kind.alias("kind"), pick([_named(p, stop) for _, p, stop in PATTERNS]).alias("name"), "start_line",
        F.when(public, "public").otherwise("private").alias("visibility"), F.when(kind == "function", F.col("whole").contains("async")).alias("is_async"),
    )
    return rows.where(F.col("name").isNotNull() & ((F.col("kind") == "struct") | ~F.col("name").isin(*NO_FUNCTION)))


def _marks(content: Column) -> Column:
    """An array of what decides where blocks end, for each line: step (of the balance of braces), opens, and look: 4 times the indent, and 2 if a brace closes or 1 if the line is blank."""

    def marked(text: Column) -> Column:
        closes = X.occurrences(text, "}")
        return F.struct(
            (X.occurrences(text, "{") - closes).alias("step"), (F.contains(text, F.lit("{")) | text.rlike(r"(?U):\s*\z")).alias("opens"),
            (4 * (F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))) + F.when(closes > 0, 2).when(text.rlike(r"(?U)\S"), 0).otherwise(1)).alias("look"),
        )

    return F.transform(lines_of(content), marked)


def lines_table(files: DataFrame) -> DataFrame:
    """file_path, line (from 0), step, opens, look (see _marks)."""
    return _lines(files.select(F.col("path").alias("file_path"), _marks(F.col("content")).alias("lines")))


def _lines(rows: DataFrame) -> DataFrame:
    """file_path, lines → file_path, line (from 0), step, opens, look."""
    return rows.select("file_path", F.posexplode("lines").alias("line", "mark")).select("file_path", "line", "mark.*")


def block_ends(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """file_path, line, end: the last line, from 1, of the block that begins at each start. lines: as of lines_table; starts: file_path, line (from 0).

    The end is the first line behind the start at which, after a line that opens a block ({, or a colon at its end), the
    balance of braces since the start is none or less; the line before, if that one holds no } and is indented no deeper
    than the start; else DEFAULT_LINES lines, or the end of the file. With running balances that is the first line at
    which a level is undercut: every closing brace is a row (level, line), a start asks for the next row of its level.
    """
    in_file = Window.partitionBy("file_path").orderBy("line")
    rows = lines.withColumn("level", F.sum("step").over(in_file.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    here = F.struct("line", "level", "look")
    onward = in_file.rowsBetween(0, Window.unboundedFollowing)
    # the first line that may end a block that begins here: the next, or the one that opens it
    asked = rows.withColumn("first", F.when(F.col("opens"), F.lead(here).over(in_file)).otherwise(F.min(F.when(F.col("opens"), here)).over(onward))).withColumn("lines", F.count(F.lit(1)).over(Window.partitionBy("file_path")))
    begun = asked.join(starts.select("file_path", "line").distinct().hint("merge"), ["file_path", "line"], "left_semi").withColumn("least", F.col("level") - F.col("step"))
    default = F.least(F.col("line") + DEFAULT_LINES, F.col("lines"))
    follows = (F.col("first.look") % 4 == 0) & (F.col("first.look") <= F.col("look") - F.col("look") % 4)
    at_once = begun.where(F.col("first.level") <= F.col("least")).select("file_path", "line", F.when(follows, F.col("first.line")).otherwise(F.col("first.line") + 1).alias("end"))
    open_ended = begun.where("first is null").select("file_path", "line", default.alias("end"))
    undercut = rows.where("step < 0").select("file_path", "line", F.explode(F.sequence("level", F.col("level") - F.col("step") - 1)).alias("least"), F.col("line").alias("closed"))
    waiting = begun.where(F.col("first.level") > F.col("least")).select("file_path", F.col("first.line").alias("line"), "least", F.col("line").alias("start"), default.alias("default"))
    both = waiting.withColumn("closed", F.lit(None).cast("int")).unionByName(undercut, allowMissingColumns=True)
    behind = Window.partitionBy("file_path", "least").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    later = both.withColumn("end", F.min("closed").over(behind) + 1).where("start is not null").select("file_path", F.col("start").alias("line"), F.coalesce("end", "default").alias("end"))
    return at_once.unionByName(open_ended).unionByName(later)


def contained_in(ranges: DataFrame, parts: DataFrame) -> DataFrame:
    """Every part with every range of its file that contains it. ranges: file_path, first, last, range (anything); parts: file_path, start_line, end_line and more.

    A range stands for the blocks of lines that it covers, a part for the one that it begins in, so ranges and parts of a
    long file do not all meet, and no file is one key.
    """
    at = lambda c: F.floor(F.col(c) / BLOCK)
    spread = ranges.select("file_path", "first", "last", "range", F.explode(F.sequence(at("first"), at("last"))).alias("_block"))
    met = parts.withColumn("_block", at("start_line")).join(spread.hint("merge"), ["file_path", "_block"])
    return met.where((F.col("start_line") >= F.col("first")) & (F.col("end_line") <= F.col("last"))).drop("_block", "first", "last")


def located(files: DataFrame, with_calls: bool = True) -> tuple[DataFrame, DataFrame]:
    """The definitions, with end_line, and the calls (file_path, k, start_line, end_line, name; none if not asked for) of files (path, content). Texts are read once, and only matches and what decides on block ends are stored."""
    patterns = {n: p for n, (_, p, _) in enumerate(PATTERNS)} | ({CALLS: CALL_PATTERN} if with_calls else {})
    read = stored(files.select(F.col("path").alias("file_path"), _found(patterns).alias("found"), _marks(F.col("content")).alias("lines")))
    found = stored(_placed(read))
    named = definitions(found).withColumn("line", F.col("start_line") - 1)
    ends = block_ends(_lines(read), named.select("file_path", "line"))
    calls = found.where(F.col("pattern") == CALLS).select("file_path", "k", "start_line", "end_line", F.regexp_extract("whole", _java(CALL_PATTERN), 1).alias("name"))
    return stored(named.join(ends.hint("merge"), ["file_path", "line"]).drop("line").withColumnRenamed("end", "end_line")), calls.where(~F.col("name").isin(*CALL_KEYWORDS))


def _id() -> Column:
    return F.concat_ws(":", "kind", "file_path", "name")


def calls_of_bodies(named: DataFrame, calls: DataFrame) -> DataFrame:
    """Each function with each call between its first and last line: id, pattern, nth (of the function), k (of the call), callee, file_path."""
    bodies = named.where("kind = 'function'").select("file_path", F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.struct(_id().alias("id"), "pattern", F.col("k").alias("nth")).alias("range"))
    return contained_in(bodies, calls).select("file_path", "range.*", "k", F.col("name").alias("callee"))


def methods(named: DataFrame) -> DataFrame:
    """file_path, parent, id: each function with the innermost struct around it, the one that begins last."""
    structs = named.where("kind = 'struct'").select("file_path", F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.struct(F.col("start_line").alias("begins"), (-F.col("end_line")).alias("ends"), _id().alias("parent")).alias("range"))
    inside = contained_in(structs, named.where("kind = 'function'").select("file_path", "start_line", "end_line", _id().alias("id")))
    return inside.groupBy("file_path", "start_line", "end_line", "id").agg(F.max("range").alias("r")).select("file_path", F.col("r.parent").alias("parent"), "id")


def fallback_rows(files: DataFrame, with_methods: bool = False, wanted: Collection[str] | None = None) -> DataFrame:
    """wanted: the rows that may not be left out, and ordinals only rise in the order of a file; None: all. Rows of the schema Extracted: structs and functions by pattern, in the order of patterns and places, each with the file that contains it and the calls of its block; has_method edges, if asked for."""
    wants = lambda kind: wanted is None or kind in wanted
    named, calls = located(files, wants("calls"))
    nodes = named.withColumn("id", _id()).withColumn("qualified_name", F.col("name")).withColumn("step", F.lit(0)).withColumn("at", F.lit(0))
    edge = lambda kind, src, dst: [F.lit("edge").alias("kind"), F.lit(kind).alias("edge_type"), src.alias("src"), dst.alias("dst")]
    contains = named.select("file_path", "pattern", "k", F.lit(1).alias("step"), F.lit(0).alias("at"), *edge("contains", F.concat(F.lit("file:"), "file_path"), _id()))
    called = calls_of_bodies(named, calls).select(
        "file_path", "pattern", F.col("nth").alias("k"), F.lit(2).alias("step"), F.col("k").alias("at"), *edge("calls", F.col("id"), F.concat(F.lit("function:?:"), "callee")),
        F.lit("direct").alias("call_type"), F.lit(False).alias("is_conditional"), F.lit(False).alias("is_in_loop"),
    )
    rows = nodes
    for kind, own in (("contains", contains), ("calls", called)):
        rows = rows.unionByName(own if wants(kind) else own.where(F.lit(False)), allowMissingColumns=True)
    if with_methods:
        owned = methods(named).select("file_path", F.lit(CALLS).alias("pattern"), F.lit(0).alias("k"), F.lit(3).alias("step"), F.lit(0).alias("at"), *edge("has_method", F.col("parent"), F.col("id")))
        rows = rows.unionByName(owned, allowMissingColumns=True)
    order = Window.partitionBy("file_path").orderBy("pattern", "k", "step", "at", "src", "dst")
    rows = rows.withColumn("ordinal", F.row_number().over(order) - 1)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.Extracted.fields])
