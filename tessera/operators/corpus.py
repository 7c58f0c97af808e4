"""File rows, change detection and snapshot maintenance. Writes replace snapshots; the file table is committed last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.schemas import LANGUAGE_OF

# Fixed values.
INDEX_EXTENSIONS = (
    "rs", "c", "cpp", "h", "hpp", "go", "java", "kt", "scala", "cs", "fs", "py", "rb", "php", "js", "ts", "tsx", "jsx", "vue", "svelte", "swift",
    "ml", "hs", "ex", "exs", "clj", "html", "css", "scss", "yaml", "yml", "toml", "json", "md", "sql",
)


def file_rows(files: DataFrame, path: str = "path", content: str = "content", keep_content: bool = False) -> DataFrame:
    """path, name, extension, hash, size of each file; and its content, if asked for."""
    p, c = F.col(path), F.col(content)
    more = [c.alias("content")] if keep_content else []
    return files.select(p.alias("path"), X.file_name(p).alias("name"), X.extension(p).alias("extension"), F.sha2(c, 256).alias("hash"), F.octet_length(c).cast("long").alias("size"), *more)


def indexable(path: Column, extensions: tuple[str, ...] = INDEX_EXTENSIONS) -> Column:
    """Case-sensitive allow-list; names without extension are out."""
    return X.extension(path).isin(*extensions)


def language(path: Column) -> Column:
    return X.lookup(F.lower(X.extension(path)), LANGUAGE_OF, "unknown")


def changed(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming files that are new or whose hash differs."""
    return incoming.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def unchanged(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return incoming.join(known.select("path", "hash"), ["path", "hash"], "left_semi")


def upserted(known: DataFrame, incoming: DataFrame, key: str = "path") -> DataFrame:
    """The snapshot with incoming rows in place of those with the same key."""
    return known.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def without_files(table: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """A table's rows that don't belong to the given paths (column path); the step of a cascade."""
    return table.join(paths.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def edges_without_files(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges whose source isn't in the given files: ids are kind:path:name, files file:path."""
    owner = F.when(F.startswith("src", F.lit("file:")), F.substring("src", 6, 2**30)).otherwise(F.regexp_extract("src", r"^[^:]*:(.*?):", 1))
    return edges.withColumn("_path", owner).join(paths.select(F.col("path").alias("_path")).distinct(), "_path", "left_anti").drop("_path")


def cascade(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """All tables without what came from the given files: files, chunks, nodes, and edges by their source."""
    out = {}
    for name, table in tables.items():
        owner = next((c for c in ("path", "file_path") if c in table.columns), None)
        out[name] = without_files(table, paths, owner) if owner else edges_without_files(table, paths)
    return out


def first_per_id(rows: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    """The first row of each id; which one doesn't depend on the partitioning."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(F.col(order), *[F.col(c) for c in rows.columns if c not in (key, order) and dict(rows.dtypes)[c] in ("string", "int", "bigint")])).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def file_at(files: DataFrame, path) -> DataFrame:
    """The row of a file, by its path (a string or a column)."""
    return files.where(F.col("path") == path).limit(1)
