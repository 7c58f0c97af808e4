"""Counts over the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WORD, cyclomatic, occurrences

# Fixed values.
CALL_KEYWORDS = (
    "if", "for", "while", "match", "switch", "return", "new", "fn", "function", "def", "func",
    "class", "struct", "enum", "type", "import", "from", "use", "pub", "async", "await",
)
RUST_BRANCHES = ("if", "else", "match", "for", "while", "loop", "?", "&&", "||")
OTHER_BRANCHES = ("if", "else", "for", "while", "switch", "case", "catch", "?", "&&", "||")

NODE_KINDS = ("function", "struct", "trait", "impl", "enum", "const")
EDGE_KINDS = ("contains", "calls", "implements", "extends", "imports", "uses_type", "returns_type", "has_field")


def kinds_by_file(rows: DataFrame) -> DataFrame:
    """Of each file, how many nodes and edges of each kind were extracted."""
    nodes = [F.count_if(F.col("kind") == k).alias(f"{k}_nodes") for k in NODE_KINDS]
    return rows.groupBy("file_path").agg(*nodes, *[F.count_if(F.col("edge_type") == k).alias(f"{k}_edges") for k in EDGE_KINDS])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, n: one row per table, 0 for an empty one."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def wide_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, a column per table."""
    return table_counts(tables).groupBy().pivot("kind", list(tables)).agg(F.first("n"))


def calls_in(texts: DataFrame, key: str, content: str, keywords: tuple[str, ...] = CALL_KEYWORDS) -> DataFrame:
    """key, name: a row for every word before an opening bracket that is no keyword, repeats included."""
    found = texts.select(key, F.explode(F.regexp_extract_all(F.col(content), F.lit(rf"({WORD})\s*\("), F.lit(1))).alias("name"))
    return found.where(~F.col("name").isin(*keywords))


def complexity(texts: DataFrame, key: str, content: str, branches: tuple[str, ...] = OTHER_BRANCHES) -> DataFrame:
    """key, cyclomatic, loc."""
    return texts.select(key, cyclomatic(F.col(content), branches).alias("cyclomatic"), (occurrences(F.col(content), "\n") + 1).alias("loc"))
