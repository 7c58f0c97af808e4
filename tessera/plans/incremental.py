"""Queries over a partitioned store that is filled from the test tables and then changed, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.schemas import struct
from tessera.session import cut, shared_folder
from tessera.sources.store import Store, Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FILE = "path string;name string;extension string;hash string;size long"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _store(spark: SparkSession, tables: dict[str, Table], last: str = "file") -> Store:
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4()}", tables, last, parts=16)
    store.create()
    return store


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return spark.read.parquet(f"{sf}/documents.parquet").select("lang", path.alias("path"), F.col("text").alias("content"))


def _first_index(spark: SparkSession, sf: str) -> Store:
    """German files with other text, Spanish ones not there yet."""
    store = _store(spark, {"file": Table(struct(FILE), "path")})
    old = F.when(F.col("lang") == "de", F.concat(F.lit("old "), "content")).otherwise(F.col("content"))
    rows = cut(corpus.file_rows(_documents(spark, sf).where("lang <> 'es'").withColumn("content", old)))
    store.replace(rows, {"file": rows})
    return store


ROWS = "rows AS (SELECT lang, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(doc_id AS VARCHAR) || '.md' AS name, 'md' AS extension, text FROM documents)"


@query(f"WITH {ROWS}, old AS (SELECT * REPLACE (CASE lang WHEN 'de' THEN 'old ' ELSE '' END || text AS text) FROM rows WHERE lang <> 'es') SELECT path, name, extension, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM old")
def store_before_change(spark, sf):
    return _first_index(spark, sf).table("file")


@query(f"WITH {ROWS} SELECT path, name, extension, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM rows WHERE lang <> 'fr'")
def store_after_change(spark, sf):
    """The same store after a run over all files, and the removal of the French ones."""
    store = _first_index(spark, sf)
    fresh = cut(corpus.changed(corpus.file_rows(_documents(spark, sf)), store.table("file")))
    store.replace(fresh, {"file": fresh})
    store.replace(_documents(spark, sf).where("lang = 'fr'"), {})
    return store.table("file")


KIND = {"R": "calls", "A": "contains", "N": "imports"}
EDGES = "edges AS (SELECT 'f' || CAST(l_suppkey AS VARCHAR) AS file_path, CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'contains' ELSE 'imports' END AS edge_type, 'part:' || CAST(l_partkey AS VARCHAR) AS dst, l_quantity FROM lineitem)"


def _edges(spark: SparkSession, sf: str) -> Store:
    """Lines as edges of suppliers' files; files of suppliers with a negative balance are indexed anew, and keep calls of large quantities only."""
    store = _store(spark, {"edge": Table(struct("file_path string;edge_type string;dst string"), kind="edge_type")}, last="edge")
    kind = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])[F.col("l_returnflag")]
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("f"), "l_suppkey").alias("file_path"), kind.alias("edge_type"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), "l_quantity")
    store.replace(rows.select(F.col("file_path").alias("path")), {"edge": rows})
    again = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal < 0").select(F.concat(F.lit("f"), "s_suppkey").alias("path"))
    store.replace(again, {"edge": rows.where("edge_type = 'calls' AND l_quantity > 40")})
    return store


LEFT = f"{EDGES}, again AS (SELECT 'f' || CAST(s_suppkey AS VARCHAR) AS path FROM supplier WHERE s_acctbal < 0), left_over AS (SELECT * FROM edges WHERE file_path NOT IN (SELECT path FROM again) OR edge_type = 'calls' AND l_quantity > 40)"


@query(f"WITH {LEFT} SELECT file_path, dst FROM left_over WHERE edge_type = 'calls'")
def store_edges_of_one_type(spark, sf):
    """Only the folders of one type are listed and read."""
    return _edges(spark, sf).table("edge").where("edge_type = 'calls'").select("file_path", "dst")


@query(f"WITH {LEFT} SELECT edge_type, count(*) AS n, count(DISTINCT file_path) AS files FROM left_over GROUP BY edge_type")
def store_edge_counts(spark, sf):
    return _edges(spark, sf).table("edge").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"))
