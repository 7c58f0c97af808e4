"""The engine over a warehouse folder: index a corpus, search it, ask for calls, counts and the graph.

Tables are partitioned Parquet below `store` (`sources.store`): indexing rewrites the partitions of new and changed files
and no others. Files are read and parsed once; what an index run works on is cut off in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import vectors as V
from tessera.operators import chunking, context, corpus, extract, graph, stats
from tessera.session import cut
from tessera.sources.config import Config
from tessera.sources.documents import write_document
from tessera.sources.store import PARTS, Store, Table
from tessera.sources.trees import list_tree, read_tree, unreadable

NODES = ("function", "struct", "trait", "impl", "enum", "const", "static")
TABLES = {
    "chunk": Table(schemas.Chunk),
    "entity": Table(schemas.Extracted, kind="kind", defaults={"visibility": "private"}),
    "edge": Table(schemas.Extracted, kind="edge_type"),
    "file": Table(schemas.struct("path string;name string;extension string;hash string;size long"), owner="path"),
}


class Engine:
    def __init__(self, spark: SparkSession, store: str, config: Config | None = None, embedder: V.Embedder | None = None, parts: int = PARTS):
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, store, TABLES, parts=parts)
        self.embedder = embedder or V.hashing_embedder(self.config.knowledge.dimension)
        #: Counts of the last index run, observed while it read and wrote: files, bytes (unchanged ones included), changed, chunks, entities, edges.
        self.run: dict[str, int] = {}

    # Tables

    def table(self, name: str) -> DataFrame:
        return self.store.table(name) if self.is_initialized() else self.spark.createDataFrame([], TABLES[name].schema)

    def is_initialized(self) -> bool:
        return self.store.exists()

    def initialize(self, force: bool = False) -> None:
        """Empty tables, unless there are tables already; force replaces them."""
        if force or not self.is_initialized():
            self.store.create(dimension=str(self.config.knowledge.dimension))

    # Ingest

    def index_directory(self, root: str) -> DataFrame:
        return self.index(read_tree(self.spark, root, extensions=",".join(corpus.INDEX_EXTENSIONS)))

    def count_indexable(self, root: str) -> int:
        """Files that would be indexed; none is opened."""
        return list_tree(self.spark, root, extensions=",".join(corpus.INDEX_EXTENSIONS)).count()

    def unreadable(self, root: str) -> DataFrame:
        """The files of a directory that indexing leaves out, and why."""
        return unreadable(self.spark, root, extensions=",".join(corpus.INDEX_EXTENSIONS))

    def index(self, files: DataFrame) -> DataFrame:
        """Indexes files (path, content): unchanged ones are skipped, what came from changed ones is replaced as a whole. Returns the statistics."""
        self.initialize()
        seen = {name: Observation() for name in ("files", "changed", "made", "chunks")}
        rows = F.count(F.lit(1)).alias("n")
        wanted = files.where(corpus.indexable(F.col("path"))).select("path", "content").observe(seen["files"], rows, F.sum(F.octet_length("content")).alias("bytes"))
        fresh = cut(corpus.changed(corpus.file_rows(wanted, keep_content=True), self.store.table("file")).observe(seen["changed"], rows))
        made = cut(extract.extracted(fresh).observe(seen["made"], F.count_if(F.col("edge_type").isNull()).alias("entities"), F.count_if(F.col("edge_type").isNotNull()).alias("edges")))
        chunks = V.embedded(chunking.chunks(fresh), "content", self.embedder).select("file_path", F.lit(None).cast("string").alias("entity_id"), F.lit("file").alias("entity_type"), "content", "start_line", "end_line", "embedding")
        self.store.replace(fresh, {
            "chunk": chunks.observe(seen["chunks"], rows), "entity": corpus.first_per_id(made.where("edge_type is null")), "edge": made.where("edge_type is not null"), "file": fresh,
        })
        self.run = {"files": seen["files"].get["n"], "bytes": seen["files"].get["bytes"] or 0, "changed": seen["changed"].get["n"]}
        if self.run["changed"]:
            self.run |= {"chunks": seen["chunks"].get["n"]} | seen["made"].get
        return self.stats()

    def remove_file(self, path: str) -> None:
        self.store.replace(self.spark.createDataFrame([(path,)], "path string"), {})

    # Questions

    def search(self, text: str, limit: int | None = None) -> DataFrame:
        return V.search_text(self.table("chunk"), text, self.embedder, limit or self.config.knowledge.search_limit)

    def calls(self) -> DataFrame:
        return graph.call_edges(self.table("edge").where("edge_type = 'calls'").select("src", "dst"))

    def dependencies(self, entity: str, loose: bool = False) -> DataFrame:
        return graph.dependencies(self.calls(), entity, loose)

    def impact(self, entity: str, loose: bool = False) -> DataFrame:
        return graph.impact(self.calls(), entity, loose)

    def entities(self, kind: str) -> DataFrame:
        return self.table("entity").where(F.col("kind") == kind)

    def list_functions(self, limit: int = 20) -> DataFrame:
        return self.entities("function").orderBy("name", "id").limit(limit)

    def find_function(self, name: str) -> DataFrame:
        return self.entities("function").where(F.col("name") == name).orderBy("id").limit(1)

    def files(self) -> DataFrame:
        return self.table("file").select("path")

    def get_file(self, path: str) -> DataFrame:
        return corpus.file_at(self.table("file"), path)

    def implements(self) -> DataFrame:
        return graph.implementations(self.table("edge"))

    def contained(self) -> DataFrame:
        """What known files contain."""
        return graph.contained(self.table("edge"), self.table("file"))

    def known_calls(self) -> DataFrame:
        """Calls of functions that are in the store."""
        return graph.known_calls(self.table("edge"), self.entities("function"))

    def stats(self) -> DataFrame:
        tables = {"files": self.table("file"), "chunks": self.table("chunk"), "calls": self.calls(), "implements": self.implements()} | {k: self.entities(k) for k in NODES}
        return stats.wide_counts(tables)

    def _graph_rows(self) -> DataFrame:
        rows = self.table("entity").where(F.col("kind").isin("function", "struct", "trait", "enum", "impl"))
        own = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
        return rows.select(F.col("kind").alias("family"), F.col("ordinal").cast("long").alias("ordinal"), "name", "qualified_name", "file_path", "start_line", "end_line", own("impl", "return_type").alias("target_type"), own("impl", "parent").alias("trait_name"), own("function", "parent").alias("parent"))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.graph(self._graph_rows(), self.calls())

    def write_graph(self, path: str) -> None:
        """The document of graph_json as ordered parts, written in parallel (`sources.documents.read_document`)."""
        nodes, edges = self.graph()
        rows = [df.select(F.lit(k).alias("section"), F.struct(*df.columns[:3]).alias("place"), F.to_json(F.struct(*df.columns)).alias("text")) for k, df in enumerate((nodes, edges))]
        order = [r.withColumn("place", F.to_json("place")) for r in rows]
        write_document(order[0].unionByName(order[1]), path, ("place",), head='{"nodes":[', between=",\n", joint='],\n"edges":[', tail="]}\n")

    def graph_json(self) -> DataFrame:
        """One JSON document of nodes and edges for a viewer. A renderer: the graph goes into one row."""
        nodes, edges = self.graph()
        pack = lambda df: df.agg(F.collect_list(F.struct(*df.columns))).scalar()
        return self.spark.range(1).select(pack(nodes).alias("nodes"), pack(edges).alias("edges")).select(F.to_json(F.struct("nodes", "edges")).alias("json"))

    def context(self, text: str, root: str | None = None) -> str:
        """Context for a question: search hits with their relations; without hits the files of a directory within the budget."""
        from pyspark.sql import Window

        hits = self.search(text, 15).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path", "start_line")))
        sections = context.smart_sections(hits, self.calls()).orderBy("rank").collect()  # 15 rows
        if sections:
            relations = [x for s in sections for x in (s["calls"], s["called_by"]) if x]
            return "\n\n".join([*(s["part"] for s in sections if s["part"]), *(["Relations:\n" + "\n".join(relations)] if relations else [])])
        if root is None:
            return ""
        limits = self.config.context
        files = read_tree(self.spark, root, extensions=",".join(context.EXTENSIONS), maxSize=limits.max_file_size).withColumn("size", F.octet_length("content"))
        taken = context.within_budget(files, max_file=limits.max_file_size, max_total=limits.max_total_size, excluded=context.EXCLUDED, mode=limits.exclude_mode)
        text = context.joined(context.prompt_parts(taken), "part", "path").first()[0]
        return f"## Directory Structure\n\n{context.rendered_tree(taken)}\n\n## File Contents\n\n{text}"
