"""A store of partitioned tables, rewritten file by file of the corpus with Spark's dynamic partition overwrite.

Every table lies below one folder as Parquet, partitioned by `part`, a hash of the path a row came from, and, where it has
kinds that are read apart, by that column too. Replacing what came from some files reads and rewrites only the partitions
that these files fall into; all others keep their files. Readers give conditions on the kind as on any column and Spark
lists only its folders.

The tables of one replacement are written one after the other and the table of files last. A file counts as known only by
its row there, so after a crash its rows are replaced once more by the next run, whole: repeating a replacement changes
nothing. An overwritten partition whose new content is empty keeps a row without a path, since Spark leaves partitions
alone that get no row; `table` hides these.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas

PARTS = 64
VERSION = "2"


@dataclass(frozen=True)
class Table:
    """owner: the column with the path that a row came from. kind: a column to partition by as well. defaults: for columns that older files lack or leave null."""

    schema: T.StructType
    owner: str = "file_path"
    kind: str | None = None
    defaults: Mapping[str, object] = field(default_factory=dict)


def with_defaults(rows: DataFrame, schema: T.StructType, defaults: Mapping[str, object]) -> DataFrame:
    """rows with the columns of a schema: those they lack, or leave null, have their default, or null."""
    there = {c.lower() for c in rows.columns}
    own = lambda f: F.col(f.name) if f.name.lower() in there else F.lit(None).cast(f.dataType)
    return rows.select(*[(F.coalesce(own(f), F.lit(defaults[f.name])) if f.name in defaults else own(f)).alias(f.name) for f in schema.fields])


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table], last: str = "file", parts: int = PARTS):
        """parts: partitions a table, for a new store; one that exists keeps its own. As many as make a partition some 128 MB."""
        self.spark, self.root, self.tables, self.last = spark, root.rstrip("/"), dict(tables), last
        self.parts = int(self._known().get("parts", parts))

    # Metadata

    def metadata(self) -> DataFrame:
        """key, value, updated_at."""
        return self.spark.read.schema(schemas.Metadata).parquet(f"{self.root}/metadata")

    def _known(self) -> dict[str, str]:
        try:
            return {r["key"]: r["value"] for r in self.metadata().collect()}  # a handful of rows
        except AnalysisException:
            return {}

    def exists(self) -> bool:
        return bool(self._known())

    def create(self, **about: str) -> None:
        """Empty tables in place of whatever there is."""
        for name in self.tables:
            self._written(self._blank(name), name, "static")
        rows = list(({"version": VERSION, "parts": str(self.parts)} | about).items())
        dated = self.spark.createDataFrame(rows, "key string, value string").withColumn("updated_at", F.current_timestamp())
        dated.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/metadata")

    # Tables

    def part(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.parts)).cast("int")

    def _columns(self, name: str) -> list[str]:
        kind = self.tables[name].kind
        return ["part", kind] if kind else ["part"]

    def _blank(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.tables[name].schema).withColumn("part", F.lit(0))

    def _stored(self, name: str) -> DataFrame:
        """All rows as they lie on disk."""
        schema = T.StructType([f for f in self.tables[name].schema.fields] + [T.StructField("part", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        own = self.tables[name]
        return with_defaults(self._stored(name).where(F.col(own.owner).isNotNull()), own.schema, own.defaults)

    def of_files(self, name: str, paths: list[str]) -> DataFrame:
        """What came from a few files, read from their partitions alone."""
        parts = sorted({r[0] for r in self.spark.createDataFrame([(p,) for p in paths], "path string").select(self.part(F.col("path"))).collect()})
        own = self.tables[name]
        return self._stored(name).where(F.col("part").isin(parts) & F.col(own.owner).isin(paths)).select(*own.schema.names)

    def _written(self, rows: DataFrame, name: str, mode: str) -> None:
        rows.hint("rebalance", *self._columns(name)).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*self._columns(name)).parquet(f"{self.root}/{name}")

    def replace(self, paths: DataFrame, rows: Mapping[str, DataFrame]) -> None:
        """paths: a column path. All that came from these files goes, in every table; the given rows come in its place, those of other files are left out.

        What is given may be read from the store only if it has been cut off from it before. One writer at a time. The part numbers of the paths come to the driver, `parts` at most, so that the scan lists only their folders.
        """
        gone = paths.select("path").distinct()
        parts = [r[0] for r in gone.select(self.part(F.col("path")).alias("part")).distinct().collect()]
        if not parts:
            return
        for name in sorted(self.tables, key=lambda n: n == self.last):
            own = self.tables[name]
            before = self._stored(name).where(F.col("part").isin(parts))
            kept = before.where(F.col(own.owner).isNotNull()).join(gone.withColumnRenamed("path", own.owner), own.owner, "left_anti")
            # every partition that is there keeps a row, or it would keep its old ones
            marks = before.select(*self._columns(name)).distinct()
            for f in own.schema.fields:
                if f.name != own.kind:
                    marks = marks.withColumn(f.name, F.lit(None).cast(f.dataType))
            new = kept.unionByName(marks)
            if name in rows:
                own_rows = rows[name].select(*own.schema.names).join(gone.withColumnRenamed("path", own.owner), own.owner, "left_semi")
                new = new.unionByName(own_rows.withColumn("part", self.part(F.col(own.owner))))
            self._written(new, name, "dynamic")
