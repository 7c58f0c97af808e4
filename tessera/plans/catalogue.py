"""Queries over the test tables by name, each with its DuckDB SQL.

The tables hold no source code, so they stand in for the engine's own: documents are files, embeddings chunks, lineitem
calls from suppliers to parts, and part, supplier, customer, nation and region are five families of entities.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import chunking, context, corpus, graph, stats, tasks
from tessera.plans import extraction, incremental, legacy
from tessera.sources import documents
from tessera.sources.store import with_defaults
from tessera.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """documents as files: path, content."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return t(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("content"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as calls of parts by suppliers."""
    ids = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return graph.call_edges(t(spark, sf, "lineitem").select(ids("supplier:", "l_suppkey").alias("src"), ids("part:", "l_partkey").alias("dst")))


FILES = "files AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, text AS content FROM documents)"
ROWS = FILES + ", rows AS (SELECT path, string_split(path, '/')[-1] AS name, 'md' AS extension, sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS size FROM files)"
CALLS = "calls AS (SELECT 'supplier:' || CAST(l_suppkey AS VARCHAR) AS caller_id, 'part:' || CAST(l_partkey AS VARCHAR) AS callee_id, CAST(l_suppkey AS VARCHAR) AS caller_name, CAST(l_partkey AS VARCHAR) AS callee_name FROM lineitem)"


# Files and change detection


@query(f"WITH {ROWS} SELECT * FROM rows")
def file_nodes(spark, sf):
    return corpus.file_rows(files(spark, sf))


@query(f"WITH {ROWS} SELECT * FROM rows")
def incremental_ingest(spark, sf):
    """The file rows that a stream over the table merges, batch by batch, into a snapshot."""
    source = f"{sf}/documents.parquet"
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    # a pattern: the stream's source takes folders and patterns, not the name of a single file
    return ingest.ingest(spark, f"{source}*", spark.read.parquet(source).schema, f"{ingest.shared_folder(spark)}/ingest-{uuid.uuid4()}", path, F.col("text"))


@query(f"WITH {ROWS} SELECT count(*) AS n FROM rows")
def indexable_count(spark, sf):
    return files(spark, sf).where(corpus.indexable(F.col("path"))).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ROWS} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size FROM rows")
def total_size(spark, sf):
    return corpus.file_rows(files(spark, sf)).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_size"))


#: A path per row whose extension depends on the language column.
AS_CODE = {"en": "rs", "fr": "py", "de": "Kt", "es": ""}


def _code_path() -> F.Column:
    return F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), *[F.when(F.col("lang") == k, F.lit(f".{v}" if v else "")).otherwise("") for k, v in AS_CODE.items()]))


CODE_PATH = "source || '/' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.rs' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.Kt' ELSE '' END"


@query(f"SELECT {CODE_PATH} AS path FROM documents WHERE lang IN ('en', 'fr')")
def extension_filter(spark, sf):
    return t(spark, sf, "documents").select(_code_path().alias("path")).where(corpus.indexable(F.col("path")))


@query(f"SELECT {CODE_PATH} AS path, CASE lang WHEN 'en' THEN 'rust' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'kotlin' ELSE 'unknown' END AS language FROM documents")
def language_of(spark, sf):
    return t(spark, sf, "documents").select(_code_path().alias("path")).withColumn("language", corpus.language(F.col("path")))


def _known(spark, sf) -> DataFrame:
    """An earlier snapshot: German files had other text, Spanish ones weren't there yet."""
    rows = t(spark, sf, "documents").where("lang <> 'es'")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return corpus.file_rows(rows.select(path.alias("path"), F.when(F.col("lang") == "de", F.concat(F.lit("old "), "text")).otherwise(F.col("text")).alias("content")))


@query(f"WITH {ROWS} SELECT rows.* FROM rows WHERE path LIKE '%/de/%' OR path LIKE '%/es/%'")
def changed_files(spark, sf):
    return corpus.changed(corpus.file_rows(files(spark, sf)), _known(spark, sf))


@query(f"WITH {ROWS} SELECT rows.* FROM rows WHERE NOT (path LIKE '%/de/%' OR path LIKE '%/es/%')")
def unchanged_files(spark, sf):
    return corpus.unchanged(corpus.file_rows(files(spark, sf)), _known(spark, sf))


@query(f"WITH {ROWS} SELECT * FROM rows")
def upsert_snapshot(spark, sf):
    known = _known(spark, sf)
    return corpus.upserted(known, corpus.changed(corpus.file_rows(files(spark, sf)), known))


@query(f"WITH {ROWS} SELECT * FROM rows WHERE NOT (path LIKE '%/de/%' OR path LIKE '%/es/%')")
def cascade_delete(spark, sf):
    rows = corpus.file_rows(files(spark, sf))
    return corpus.cascade({"file": rows}, corpus.changed(rows, _known(spark, sf)).select("path"))["file"]


@query("WITH e AS (SELECT DISTINCT 'file:' || CAST(l_suppkey AS VARCHAR) AS src, 'part:' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem) SELECT src, dst FROM e WHERE CAST(substr(src, 6) AS BIGINT) NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def cascade_delete_edges(spark, sf):
    edges = t(spark, sf, "lineitem").select(F.concat(F.lit("file:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    gone = t(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("path"))
    return corpus.edges_without_files(edges, gone)


# Chunks

CHUNKS = f"""WITH RECURSIVE {FILES}, split AS (
  SELECT path, list_transform(CASE WHEN string_split(content, chr(10))[-1] = '' THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END, lambda x: regexp_replace(x, '\\r$', '')) AS lines FROM files WHERE length(content) > 0
), sized AS (SELECT path, lines, len(lines) AS n, list_transform(lines, lambda x: strlen(x) + 1) AS sz FROM split WHERE len(lines) > 0
), fold AS (
  SELECT path, lines, n, sz, 0 AS c, 0 AS low, 0 AS high, 0 AS then_, CAST(0 AS BIGINT) AS size, 1 AS first, false AS cut, 0 AS e_low, 0 AS e_high, 0 AS e_then, 1 AS e_first, 0 AS k FROM sized
  UNION ALL
  SELECT path, lines, n, sz, c + 1,
    CASE WHEN size + sz[c + 1] >= 1000 THEN greatest(c - 2, 0) ELSE low END,
    CASE WHEN size + sz[c + 1] >= 1000 THEN least(greatest(c - 2, 0) + (c + 1 - greatest(c - 1, 0) + 1), n) ELSE high END,
    CASE WHEN size + sz[c + 1] >= 1000 THEN c + 1 ELSE then_ END,
    CAST(CASE WHEN size + sz[c + 1] >= 1000 THEN list_sum(sz[greatest(c - 2, 0) + 1 : least(greatest(c - 2, 0) + (c + 1 - greatest(c - 1, 0) + 1), n)]) ELSE size + sz[c + 1] END AS BIGINT),
    CASE WHEN size + sz[c + 1] >= 1000 THEN greatest(c - 1, 0) ELSE first END,
    size + sz[c + 1] >= 1000, low, high, then_, first, k + CASE WHEN size + sz[c + 1] >= 1000 THEN 1 ELSE 0 END
  FROM fold WHERE c < n
), made AS (
  SELECT path, k - 1 AS ordinal, e_first AS start_line, c AS end_line, list_concat(lines[e_low + 1 : e_high], lines[e_then + 1 : c]) AS part, false AS rest FROM fold WHERE cut
  UNION ALL
  SELECT path, k, first, c, list_concat(lines[low + 1 : high], lines[then_ + 1 : c]), true FROM fold WHERE c = n
), chunks AS (
  SELECT * FROM (SELECT path AS file_path, ordinal, start_line, end_line, trim(array_to_string(part, chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content, rest FROM made) WHERE content <> '' OR NOT rest
) """


@query(CHUNKS + "SELECT file_path, ordinal, start_line, end_line FROM chunks")
def chunk_spans(spark, sf):
    return chunking.chunks(files(spark, sf), columns=("file_path", "ordinal", "start_line", "end_line"))


@query(CHUNKS + "SELECT file_path, ordinal, sha256(content) AS hash, strlen(content) AS size FROM chunks")
def chunk_rows(spark, sf):
    return chunking.chunks(files(spark, sf)).select("file_path", "ordinal", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


@query(CHUNKS + "SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines, count(*) FILTER (start_line = 0) AS from_zero FROM chunks")
def chunk_stats(spark, sf):
    rows = chunking.chunks(files(spark, sf), columns=("file_path", "start_line", "end_line"))
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_path").alias("files"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.count_if(F.col("start_line") == 0).alias("from_zero"))


# Names, lines, scores

KEYWORDS = ", ".join(f"'{k}'" for k in stats.CALL_KEYWORDS)
FOUND = rf"found AS (SELECT page_id, unnest(regexp_extract_all(html, '([\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+)\s*\(', 1)) AS name FROM pages)"


@query(f"WITH {FOUND} SELECT page_id, name FROM found WHERE name NOT IN ({KEYWORDS})")
def legacy_calls(spark, sf):
    return stats.calls_in(t(spark, sf, "pages"), "page_id", "html")


@query(f"WITH {FOUND} SELECT name, count(*) AS n FROM found WHERE name NOT IN ({KEYWORDS}) GROUP BY name")
def legacy_call_counts(spark, sf):
    return stats.calls_in(t(spark, sf, "pages"), "page_id", "html").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def regex_links(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def line_counts(spark, sf):
    return t(spark, sf, "documents").select("doc_id", (X.occurrences(F.col("text"), "\n") + 1).cast("long").alias("lines"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT doc_id, CAST(length(left(text, strpos(text, ',') - 1)) - length(replace(left(text, strpos(text, ',') - 1), chr(10), '')) + 1 AS BIGINT) AS line FROM documents WHERE contains(text, ',')")
def line_of_first_match(spark, sf):
    at = F.locate(",", F.col("text")) - 1
    return t(spark, sf, "documents").where(F.col("text").contains(",")).select("doc_id", X.line_of(F.col("text"), at).cast("long").alias("line"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS part FROM documents")
def line_range(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"), X.lines_between(F.col("text"), F.lit(2), F.lit(3)).alias("part"))


def _branches(words: tuple[str, ...]) -> str:
    return " + ".join(f"(length(c) - length(replace(c, '{w}', ''))) / {len(w)}" for w in words)


@query(f"SELECT page_id, CAST(1 + {_branches(stats.OTHER_BRANCHES).replace('(c', '(html')} AS INT) AS cyclomatic, CAST(length(html) - length(replace(html, chr(10), '')) + 1 AS INT) AS loc FROM pages".replace("replace(c,", "replace(html,"))
def complexity_score(spark, sf):
    return stats.complexity(t(spark, sf, "pages"), "page_id", "html")


@query(f"SELECT doc_id, CAST(1 + {_branches(stats.RUST_BRANCHES).replace('(c', '(text')} AS INT) AS cyclomatic, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS loc FROM documents".replace("replace(c,", "replace(text,"))
def complexity_score_rust(spark, sf):
    return stats.complexity(t(spark, sf, "documents"), "doc_id", "text", stats.RUST_BRANCHES)


# Vector search

COSINE = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def _vector(spark, sf, vec_id: int = 0) -> list[float]:
    return t(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"SELECT e.vec_id, e.label, {COSINE.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, vec_id LIMIT 10")
def semantic_search_topk(spark, sf):
    return V.top_k(t(spark, sf, "embeddings"), _vector(spark, sf), 10, ties=("vec_id",)).select("vec_id", "label", "score")


@query(f"SELECT e.vec_id, e.label, {COSINE.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = q.label ORDER BY score DESC, vec_id LIMIT 10")
def search_with_filter(spark, sf):
    rows = t(spark, sf, "embeddings")
    own = rows.where("vec_id = 0").first()
    return V.top_k(rows.where(F.col("label") == own["label"]), own["embedding"], 10, ties=("vec_id",)).select("vec_id", "label", "score")


@query(f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)), s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {COSINE.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, q)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5""")
def semantic_search_batch(spark, sf):
    rows = t(spark, sf, "embeddings")
    chosen = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("id"))  # one query a label
    return V.top_k_of_each(chosen, rows, 5, "id", "vec_id")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {COSINE.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, embeddings q)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 3""")
def semantic_search_all(spark, sf):
    """Every vector of the table asks."""
    rows = t(spark, sf, "embeddings")
    return V.top_k_of_each(rows, rows, 3, "vec_id", "vec_id")


@query("SELECT doc_id, left(text, 200) AS preview, array_to_string(string_split(left(text, 200), chr(10))[1:3], chr(10)) AS lines FROM documents")
def search_preview(spark, sf):
    preview = F.substring("text", 1, 200)
    return t(spark, sf, "documents").select("doc_id", preview.alias("preview"), F.array_join(F.slice(F.split(preview, "\n"), 1, 3), "\n").alias("lines"))


@query(f"""SELECT 'chunk:' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || CASE WHEN d.lang = 'en' THEN '.rs' ELSE '.md' END || ':1' AS key, left(d.text, 200) AS label,
  CASE WHEN d.lang = 'en' THEN 'function' ELSE 'unknown' END AS category, d.source || '/' || CAST(d.doc_id AS VARCHAR) || CASE WHEN d.lang = 'en' THEN '.rs' ELSE '.md' END AS path, {COSINE.format(a='e.embedding', b='q.embedding')} AS score
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, path LIMIT 20""")
def http_search_shape(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".rs").otherwise(".md")).alias("path"), F.substring("text", 1, 200).alias("preview"))
    found = V.top_k(t(spark, sf, "embeddings").join(docs, "vec_id"), _vector(spark, sf), 20, ties=("path",))
    return V.http_shape(found.withColumn("start_line", F.lit(1)))


# Calls


@query(f"WITH {CALLS} SELECT DISTINCT callee_name AS name FROM calls WHERE caller_name = '1'")
def deps(spark, sf):
    return graph.dependencies(calls(spark, sf), "supplier:1")


@query(f"WITH {CALLS} SELECT DISTINCT caller_name AS name FROM calls WHERE callee_name = '1'")
def impact(spark, sf):
    return graph.impact(calls(spark, sf), "part:`1`")


@query(f"WITH {CALLS} SELECT caller_name, string_agg(callee_name, ', ' ORDER BY callee_name) AS names, count(*) AS n FROM (SELECT DISTINCT caller_name, callee_name FROM calls) GROUP BY caller_name")
def deps_all(spark, sf):
    return graph.lists(calls(spark, sf), "caller_name", "callee_name")


@query(f"WITH {CALLS} SELECT callee_name, string_agg(caller_name, ', ' ORDER BY caller_name) AS names, count(*) AS n FROM (SELECT DISTINCT caller_name, callee_name FROM calls) GROUP BY callee_name")
def impact_all(spark, sf):
    return graph.lists(calls(spark, sf), "callee_name", "caller_name")


@query(f"WITH {CALLS}, d AS (SELECT DISTINCT caller_name, callee_name FROM calls), r AS (SELECT *, row_number() OVER (PARTITION BY caller_name ORDER BY callee_name) AS k, count(*) OVER (PARTITION BY caller_name) AS n FROM d) SELECT caller_name, string_agg(callee_name, ', ' ORDER BY callee_name) AS names, any_value(n) AS n FROM r WHERE k <= 5 GROUP BY caller_name")
def deps_top5(spark, sf):
    return graph.lists(calls(spark, sf), "caller_name", "callee_name", 5)


@query(f"WITH {CALLS} SELECT * FROM calls")
def call_name_extract(spark, sf):
    return calls(spark, sf)


@query("SELECT count(*) AS n FROM lineitem")
def count_calls(spark, sf):
    return calls(spark, sf).agg(F.count(F.lit(1)).alias("n"))


TABLES = {"functions": "part", "structs": "supplier", "traits": "customer", "enums": "nation", "impls": "region", "calls": "lineitem", "files": "documents", "chunks": "embeddings"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM {v}" for k, v in TABLES.items()))
def table_counts(spark, sf):
    return stats.table_counts({k: t(spark, sf, v) for k, v in TABLES.items()})


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {v}) AS {k}" for k, v in TABLES.items()))
def extended_stats(spark, sf):
    return stats.wide_counts({k: t(spark, sf, v) for k, v in TABLES.items()})


@query("SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM supplier) AS structs, (SELECT count(*) FROM part) AS functions, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS total_size")
def index_stats(spark, sf):
    counts = stats.wide_counts({k: t(spark, sf, TABLES[k]) for k in ("files", "chunks", "structs", "functions")})
    return counts.withColumn("total_size", t(spark, sf, "documents").agg(F.sum(F.octet_length("text"))).scalar())


@query("SELECT label, count(*) FILTER (vec_id >= 0) AS n, count(*) FILTER (label % 2 = 0) AS even FROM embeddings GROUP BY label")
def node_type_counts(spark, sf):
    return t(spark, sf, "embeddings").groupBy("label").agg(F.count_if(F.col("vec_id") >= 0).alias("n"), F.count_if(F.col("label") % 2 == 0).alias("even"))


@query("SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other FROM events")
def edge_type_counts(spark, sf):
    kind = F.col("event_type")
    return t(spark, sf, "events").agg(F.count_if(kind == "click").alias("click"), F.count_if(kind == "view").alias("view"), F.count_if(~kind.isin("click", "view")).alias("other"))


@query("SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_name, p_partkey LIMIT 20")
def list_functions(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).orderBy("name", "id").limit(20)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name = (SELECT min(p_name) FROM part) ORDER BY p_partkey LIMIT 1")
def find_by_name(spark, sf):
    rows = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return rows.where(F.col("name") == rows.agg(F.min("name")).scalar()).orderBy("id").limit(1)


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)")
def known_callers(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id")).distinct().join(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi")


def _listing(name: str, table: str, columns: dict[str, str]):
    def f(spark, sf):
        return t(spark, sf, table).select(*[F.col(c).alias(a) for a, c in columns.items()])

    f.__name__ = name
    return query(f"SELECT {', '.join(f'{c} AS {a}' for a, c in columns.items())} FROM {table}")(f)


_listing("list_calls", "lineitem", {"caller": "l_suppkey", "callee": "l_partkey", "line": "l_linenumber"})
_listing("list_indexed_files", "documents", {"id": "doc_id", "source": "source"})


# The graph: part → functions, supplier → structs, customer → traits, nation → enums, region → impls of a trait per nation


def entities(spark, sf) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def family(table, kind, ordinal, name, qualified, file, line, target=none, trait=none, parent=none):
        return t(spark, sf, table).select(
            F.lit(kind).alias("family"), F.col(ordinal).cast("long").alias("ordinal"), name.alias("name"), qualified.alias("qualified_name"), file.alias("file_path"), line.cast("int").alias("start_line"), (line.cast("int") + 1).alias("end_line"),
            target.alias("target_type"), trait.alias("trait_name"), parent.alias("parent"),
        )

    parts = family("part", "function", "p_partkey", text("p_partkey"), F.concat(F.lit("part:"), text("p_partkey")), F.concat(text("p_brand"), F.lit(".rs")), F.col("p_size"), parent=text("p_size"))
    suppliers = family("supplier", "struct", "s_suppkey", text("s_suppkey"), F.concat(F.lit("supplier:"), text("s_suppkey")), F.concat(F.lit("n"), text("s_nationkey"), F.lit(".rs")), F.col("s_nationkey"))
    customers = family("customer", "trait", "c_custkey", F.concat(F.lit("c"), text("c_custkey")), F.concat(F.lit("customer:"), text("c_custkey")), F.concat(F.lit("n"), text("c_nationkey"), F.lit(".rs")), F.col("c_nationkey"))
    nations = family("nation", "enum", "n_nationkey", text("n_nationkey"), F.concat(F.lit("nation:"), text("n_nationkey")), F.concat(F.lit("r"), text("n_regionkey"), F.lit(".rs")), F.col("n_regionkey"))
    regions = family("region", "impl", "r_regionkey", text("r_name"), F.concat(F.lit("region:"), text("r_regionkey")), F.lit("world.rs"), F.col("r_regionkey"), target=F.concat(F.lit("impl geo::"), text("r_name"), F.lit("<T>")), trait=F.concat(F.lit("std::c"), text("r_regionkey")))
    return parts.unionByName(suppliers).unionByName(customers).unionByName(nations).unionByName(regions)


GRAPH = f"""WITH {CALLS}, e AS (
  SELECT 'function' AS family, 0 AS rank, CAST(p_partkey AS BIGINT) AS ordinal, CAST(p_partkey AS VARCHAR) AS name, 'part:' || CAST(p_partkey AS VARCHAR) AS qualified_name, p_brand || '.rs' AS file_path, CAST(p_size AS INT) AS start_line, NULL AS target, NULL AS trait, CAST(p_size AS VARCHAR) AS parent FROM part
  UNION ALL SELECT 'struct', 1, s_suppkey, CAST(s_suppkey AS VARCHAR), 'supplier:' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) || '.rs', s_nationkey, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'trait', 2, c_custkey, 'c' || CAST(c_custkey AS VARCHAR), 'customer:' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) || '.rs', c_nationkey, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'enum', 3, n_nationkey, CAST(n_nationkey AS VARCHAR), 'nation:' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) || '.rs', n_regionkey, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'impl', 4, r_regionkey, r_name, 'region:' || CAST(r_regionkey AS VARCHAR), 'world.rs', r_regionkey, r_name, 'c' || CAST(r_regionkey AS VARCHAR), NULL FROM region
), n0 AS (
  SELECT *, CASE WHEN family = 'impl' THEN trait || ' for ' || target ELSE name END AS label, CASE family WHEN 'function' THEN 'fn' ELSE family END AS prefix FROM e
), n1 AS (SELECT *, prefix || ':' || file_path || ':' || CAST(start_line AS VARCHAR) || ':' || label AS key FROM n0
), nodes AS (
  SELECT key, label, family AS category, CASE family WHEN 'function' THEN '#0969da' WHEN 'struct' THEN '#1a7f37' WHEN 'trait' THEN '#9a6700' WHEN 'enum' THEN '#cf222e' ELSE '#8250df' END AS color,
    CASE family WHEN 'function' THEN 8 WHEN 'impl' THEN 10 ELSE 12 END AS size, file_path, start_line, start_line + 1 AS end_line FROM n1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, ordinal) = 1
), pairs AS (
  SELECT qualified_name AS id, key, rank, ordinal FROM n1 WHERE rank < 4 UNION ALL SELECT name, key, rank, ordinal FROM n1 WHERE rank < 4 UNION ALL SELECT 'function:' || file_path || ':' || name, key, rank, ordinal FROM n1 WHERE rank = 0
), ids AS (SELECT id, key FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank DESC, ordinal DESC) = 1
), call_edges AS (
  SELECT DISTINCT coalesce(a.key, b.key) AS src, 'calls' AS rel, coalesce(c.key, d.key) AS dst FROM (SELECT DISTINCT * FROM calls) x LEFT JOIN ids a ON a.id = caller_id LEFT JOIN ids b ON b.id = caller_name LEFT JOIN ids c ON c.id = callee_id LEFT JOIN ids d ON d.id = callee_name
  WHERE coalesce(a.key, b.key) IS NOT NULL AND coalesce(c.key, d.key) IS NOT NULL
), impl_edges AS (SELECT DISTINCT n1.key AS src, 'implements' AS rel, ids.key AS dst FROM n1 JOIN ids ON ids.id = n1.trait WHERE family = 'impl'
), method_edges AS (SELECT DISTINCT ids.key AS src, 'has_method' AS rel, n1.key AS dst FROM n1 JOIN ids ON ids.id = n1.parent WHERE family = 'function'
), edges AS (
  SELECT * FROM (SELECT * FROM call_edges UNION SELECT * FROM impl_edges UNION SELECT * FROM method_edges) WHERE src IN (SELECT key FROM nodes) AND dst IN (SELECT key FROM nodes)
) """


@query(GRAPH + "SELECT * FROM nodes")
def graph_nodes(spark, sf):
    return graph.nodes(entities(spark, sf))


@query(GRAPH + "SELECT * FROM ids")
def graph_id_map(spark, sf):
    return graph.id_map(entities(spark, sf))


@query(GRAPH + "SELECT * FROM call_edges")
def graph_call_edges(spark, sf):
    return graph.resolved_calls(calls(spark, sf), graph.id_map(entities(spark, sf)))


@query(GRAPH + "SELECT * FROM impl_edges")
def graph_implements_edges(spark, sf):
    e = entities(spark, sf)
    return graph.implements_edges(e, graph.id_map(e))


@query(GRAPH + "SELECT * FROM method_edges")
def graph_method_edges(spark, sf):
    e = entities(spark, sf)
    return graph.method_edges(e, graph.id_map(e))


@query(GRAPH + "SELECT * FROM edges")
def graph_edges(spark, sf):
    return graph.graph(entities(spark, sf), calls(spark, sf))[1]


@query(GRAPH + "SELECT DISTINCT src, dst FROM edges")
def graph_edge_dedup(spark, sf):
    return graph.simple_edges(graph.graph(entities(spark, sf), calls(spark, sf), repeated=True)[1])


@query(GRAPH + ", p AS (SELECT DISTINCT src, dst FROM edges) SELECT key, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS key, 1 AS o, 0 AS i FROM p UNION ALL SELECT dst, 0, 1 FROM p) GROUP BY key")
def graph_degree(spark, sf):
    return graph.degrees(graph.graph(entities(spark, sf), calls(spark, sf), repeated=True)[1])


@query(GRAPH + "SELECT DISTINCT unnest([src, dst]) AS key FROM edges WHERE src = 'struct:n0.rs:0:' || (SELECT min(name) FROM n1 WHERE key LIKE 'struct:n0.rs:0:%') OR dst = 'struct:n0.rs:0:' || (SELECT min(name) FROM n1 WHERE key LIKE 'struct:n0.rs:0:%')")
def graph_neighbors(spark, sf):
    nodes = graph.nodes(entities(spark, sf))
    first = nodes.where(F.startswith("key", F.lit("struct:n0.rs:0:"))).agg(F.min("label")).first()[0]
    return graph.around(entities(spark, sf), calls(spark, sf), f"struct:n0.rs:0:{first}")


@query(GRAPH + ", d AS (SELECT caller_name AS label, string_agg(callee_name, ', ' ORDER BY callee_name) AS names FROM (SELECT DISTINCT caller_name, callee_name FROM calls) GROUP BY 1), i AS (SELECT callee_name AS label, string_agg(caller_name, ', ' ORDER BY caller_name) AS names FROM (SELECT DISTINCT caller_name, callee_name FROM calls) GROUP BY 1) SELECT nodes.key, CASE WHEN key LIKE 'fn:%' THEN 'function' WHEN key LIKE 'impl:%' THEN NULL ELSE category END AS node_type, nodes.label, coalesce(d.names, '') AS dependencies, coalesce(i.names, '') AS impact FROM nodes LEFT JOIN d ON d.label = nodes.label LEFT JOIN i ON i.label = nodes.label")
def node_detail(spark, sf):
    return graph.node_detail(graph.nodes(entities(spark, sf)), calls(spark, sf))


@query(GRAPH + "SELECT key, contains(lower(label), 'asia') OR contains(lower(label), '12') AS matches FROM nodes WHERE category IN ('function', 'impl')")
def graph_filter(spark, sf):
    label = F.lower("label")
    return graph.nodes(entities(spark, sf)).where(F.col("category").isin("function", "impl")).select("key", (label.contains("asia") | label.contains("12")).alias("matches"))


@query(GRAPH + "SELECT src, rel, dst FROM edges")
def graph_document(spark, sf):
    """The edges of the graph, written in parallel as one ordered document and read back from its parts."""
    _, edges = graph.graph(entities(spark, sf), calls(spark, sf))
    path = f"{ingest.shared_folder(spark)}/document-{uuid.uuid4()}"
    documents.write_document(edges.select(F.lit(0).alias("section"), "src", "dst", F.to_json(F.struct("src", "rel", "dst")).alias("text")), path, ("src", "dst"))
    text = spark.read.text(f"{path}/part-*")
    return text.select(F.from_json("value", "src string, rel string, dst string").alias("e")).select("e.*")


@query(GRAPH + "SELECT category, min(color) AS color, count(*) AS n FROM nodes GROUP BY category ORDER BY category")
def graph_categories(spark, sf):
    return graph.nodes(entities(spark, sf)).groupBy("category").agg(F.min_by("color", "key").alias("color"), F.count(F.lit(1)).alias("n")).orderBy("category")


# Context


@query(f"WITH {FILES}, p AS (SELECT string_split(path, '/') AS p FROM files), s AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM p) SELECT DISTINCT array_to_string(p[1:depth], '/') AS entry, array_to_string(p[1:depth - 1], '/') AS parent, p[depth] AS name, CAST(depth AS INT) AS depth, depth < len(p) AS is_dir FROM s")
def dir_tree_entries(spark, sf):
    return context.tree_entries(files(spark, sf))


@query(f"""WITH {FILES}, p AS (SELECT string_split(path, '/') AS p FROM files), s AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM p),
e AS (SELECT DISTINCT array_to_string(p[1:depth], '/') AS entry, array_to_string(p[1:depth - 1], '/') AS parent, p[depth] AS name, depth, depth < len(p) AS is_dir FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir, name DESC) = 1 AS is_last FROM e)
SELECT f.entry, coalesce(string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) FILTER (a.entry IS NOT NULL), '') || CASE WHEN f.is_last THEN '└── ' ELSE '├── ' END || f.name || CASE WHEN f.is_dir THEN '/' ELSE '' END AS text
FROM f LEFT JOIN f a ON starts_with(f.entry, a.entry || '/') GROUP BY f.entry, f.is_last, f.name, f.is_dir""")
def dir_tree_lines(spark, sf):
    return context.tree_lines(files(spark, sf)).select("entry", "text")


@query(f"WITH {ROWS}, r AS (SELECT path, size, sum(size) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS running FROM rows WHERE size <= 102400) SELECT path, size FROM r WHERE running <= 512000")
def context_budget(spark, sf):
    return context.within_budget(corpus.file_rows(files(spark, sf)).select("path", "size"))


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT (contains(path, 'src1') OR contains(path, 'fr'))")
def exclude_dirs_substring(spark, sf):
    return files(spark, sf).where(~X.in_excluded_dir(F.col("path"), ["src1", "fr"])).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT list_has_any(string_split(path, '/'), ['src1', 'fr'])")
def exclude_dirs_segment(spark, sf):
    return files(spark, sf).where(~X.in_excluded_dir(F.col("path"), ["src1", "fr"], "segment")).select("path")


@query(f"""WITH {FILES}, r AS (SELECT path, content, sum(strlen(content)) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS running FROM files WHERE strlen(content) <= 4096)
SELECT string_agg('### ' || path || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10), chr(10) || chr(10) ORDER BY path) AS text FROM r WHERE running <= 65536""")
def context_prompt(spark, sf):
    taken = context.within_budget(files(spark, sf).withColumn("size", F.octet_length("content")), max_file=4096, max_total=65536)
    return context.joined(context.prompt_parts(taken), "part", "path")


@query(f"""WITH {CALLS}, hits AS (
  SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, * FROM (SELECT e.vec_id, 'dir' || CAST(e.label AS VARCHAR) AS path, {COSINE.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY score DESC, vec_id LIMIT 15
), d AS (SELECT caller_name, string_agg(callee_name, ', ' ORDER BY callee_name) AS names FROM (SELECT DISTINCT caller_name, callee_name FROM calls QUALIFY dense_rank() OVER (PARTITION BY caller_name ORDER BY callee_name) <= 5) GROUP BY 1
), i AS (SELECT callee_name, string_agg(caller_name, ', ' ORDER BY caller_name) AS names FROM (SELECT DISTINCT caller_name, callee_name FROM calls QUALIFY dense_rank() OVER (PARTITION BY callee_name ORDER BY caller_name) <= 5) GROUP BY 1)
SELECT rank, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY rank) = 1 THEN path || ':1-2 (score: ' || format('{{:.2f}}', score) || ')' END AS source, '### ' || path || ' (lines 1-2)' || chr(10) || '```' || chr(10) || 'v' || CAST(vec_id AS VARCHAR) || chr(10) || '```' AS part,
  '- **file** `chunk:' || CAST(vec_id AS VARCHAR) || '` calls: ' || d.names AS calls, '- **file** `chunk:' || CAST(vec_id AS VARCHAR) || '` is called by: ' || i.names AS called_by
FROM hits LEFT JOIN d ON d.caller_name = CAST(vec_id AS VARCHAR) LEFT JOIN i ON i.callee_name = CAST(vec_id AS VARCHAR)""")
def smart_context(spark, sf):
    from pyspark.sql import Window

    found = V.top_k(t(spark, sf, "embeddings"), _vector(spark, sf), 15, ties=("vec_id",))
    hits = found.select(
        F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long").alias("rank"), F.concat(F.lit("dir"), F.col("label").cast("string")).alias("path"), "score", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("preview"), F.concat(F.lit("chunk:"), F.col("vec_id").cast("string")).alias("entity_id"), F.lit("file").alias("entity_type"),
    )
    return context.smart_sections(hits, calls(spark, sf))


# Tasks and texts


@query(r"SELECT conv_id, turn, regexp_replace(lower(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:5], '-')), '[^\p{L}\p{N}-]', '', 'g') AS name FROM conversations")
def task_names(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", X.task_name(F.col("text")).alias("name"))


def _tasks(spark, sf) -> DataFrame:
    phase = X.lookup(F.col("o_orderstatus"), {"O": "research", "P": "planning", "F": "agent"}, "complete")
    return t(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), phase.alias("phase"), F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_totalprice") > 200000, "doc").alias("research_doc"), F.when(F.col("o_custkey") > 700, "plan").alias("plan")
    )


TASKS = "tasks AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'O' THEN 'research' WHEN 'P' THEN 'planning' WHEN 'F' THEN 'agent' ELSE 'complete' END AS phase, o_orderdate AS updated_at, CASE WHEN o_totalprice > 200000 THEN 'doc' END AS research_doc, CASE WHEN o_custkey > 700 THEN 'plan' END AS plan FROM orders)"


@query(f"WITH {TASKS} SELECT id, phase FROM tasks ORDER BY updated_at DESC, id")
def task_list(spark, sf):
    return tasks.listing(_tasks(spark, sf)).select("id", "phase")


@query(f"WITH {TASKS}, f AS (SELECT * FROM tasks WHERE starts_with(id, '12')) SELECT CASE count(*) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS outcome, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM f")
def prefix_match(spark, sf):
    return tasks.by_prefix(_tasks(spark, sf), "12")


@query(f"WITH {TASKS}, c AS (SELECT id, phase, CASE phase WHEN 'research' THEN research_doc IS NOT NULL WHEN 'planning' THEN plan IS NOT NULL WHEN 'agent' THEN true ELSE false END AS can_advance FROM tasks) SELECT *, CASE WHEN can_advance THEN CASE phase WHEN 'research' THEN 'planning' WHEN 'planning' THEN 'agent' WHEN 'agent' THEN 'complete' END END AS next_phase FROM c")
def advance_guard(spark, sf):
    return tasks.advanced(_tasks(spark, sf)).select("id", "phase", "can_advance", "next_phase")


def _plans(spark, sf) -> DataFrame:
    """Orders as plans: lines that came back are files to create, the others files to modify, in the order of their numbers."""
    spec = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_linestatus").alias("description"))
    back = F.col("l_returnflag") == "R"
    named = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, spec))), lambda x: F.struct(x["path"].alias("path"), x["description"].alias("description")))
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("task_name"))
    return rows.agg(named(back).alias("files_to_create"), named(~back).alias("files_to_modify"))


def _results(spark, sf) -> DataFrame:
    """The first items of the plans of some orders are done."""
    done = t(spark, sf, "lineitem").where("l_linenumber <= 2 AND l_orderkey % 3 = 0")
    return done.select(F.col("l_orderkey").cast("string").alias("task_name"), (F.col("l_linenumber") - 1).cast("int").alias("ordinal"))


ITEMS = "lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS task_name, CASE l_returnflag WHEN 'R' THEN 'create' ELSE 'modify' END AS action, 'f' || CAST(l_partkey AS VARCHAR) AS path, l_linenumber AS n, l_linestatus AS description FROM lineitem), items AS (SELECT task_name, CAST(row_number() OVER (PARTITION BY task_name ORDER BY action, n, path, description) - 1 AS INT) AS ordinal, action, path FROM lines)"
DONE = "done AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS task_name, CAST(l_linenumber - 1 AS INT) AS ordinal FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 = 0)"


@query(f"WITH {ITEMS} SELECT * FROM items")
def plan_items(spark, sf):
    return tasks.plan_items(_plans(spark, sf))


@query(f"WITH {ITEMS} SELECT task_name, CAST(count(*) AS INT) AS files FROM items GROUP BY task_name")
def files_affected(spark, sf):
    return tasks.files_affected(_plans(spark, sf))


@query(f"WITH {ITEMS}, {DONE}, r AS (SELECT items.*, done.task_name IS NOT NULL AS is_done FROM items LEFT JOIN done USING (task_name, ordinal)), f AS (SELECT * FROM r WHERE NOT is_done QUALIFY row_number() OVER (PARTITION BY task_name ORDER BY ordinal) = 1), c AS (SELECT task_name, count(*) AS total, count(*) FILTER (is_done) AS completed FROM r GROUP BY task_name) SELECT task_name, total, completed, f.ordinal AS next_ordinal, action, path FROM c LEFT JOIN f USING (task_name)")
def plan_cursor(spark, sf):
    return tasks.cursor(tasks.plan_items(_plans(spark, sf)), _results(spark, sf))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS task_name, count(*) AS total, count(*) FILTER (l_linestatus <> 'F') AS completed, bool_and(l_linestatus <> 'F' AND l_returnflag = 'N') AS all_passed FROM lineitem GROUP BY l_orderkey")
def execution_progress(spark, sf):
    passed = F.when(F.col("l_returnflag") == "N", "passed").otherwise("failed")
    return tasks.progress(t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("task_name"), F.when(F.col("l_linestatus") != "F", passed).alias("conformance")))


@query(f"WITH {TASKS} SELECT id, phase FROM tasks WHERE id = (SELECT min(id) FROM tasks)")
def current_task(spark, sf):
    rows = _tasks(spark, sf)
    return tasks.current(rows, rows.agg(F.min("id").alias("id"))).select("id", "phase")


@query(f"WITH {TASKS} SELECT id FROM tasks WHERE id <> '1'")
def task_deletion(spark, sf):
    rows = _tasks(spark, sf)
    return tasks.without(rows, rows.select("id").limit(1), "1")[0].select("id")


@query(f"WITH {ROWS} SELECT path, size // 1024 AS kilobytes FROM rows")
def file_kilobytes(spark, sf):
    return corpus.file_rows(files(spark, sf)).select("path", X.kilobytes(F.col("size")).alias("kilobytes"))


@query(f"WITH {ROWS} SELECT * FROM rows WHERE path = (SELECT min(path) FROM rows)")
def get_file(spark, sf):
    rows = corpus.file_rows(files(spark, sf))
    return corpus.file_at(rows, rows.agg(F.min("path")).scalar())


@query("SELECT p_partkey, p_brand || '<' || p_type || '>' AS type, CASE WHEN length(p_name) > 30 THEN left(p_name, 27) || '...' ELSE p_name END AS name, split_part(p_brand, '#', 1) AS simple FROM part")
def simple_name(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("<"), "p_type", F.lit(">")).alias("type"), F.concat(F.lit("impl std::fmt::"), "p_name").alias("long"))
    return rows.select("p_partkey", "type", X.simple_name(F.col("long")).alias("name"), X.simple_name(F.col("type")).alias("simple"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def html_escape(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.sha2(X.html_escaped(F.col("html")), 256).alias("escaped"))


@query("SELECT DISTINCT source, left(sha256(source), 8) AS project FROM documents")
def project_hash(spark, sf):
    return t(spark, sf, "documents").select("source", X.short_hash(F.col("source")).alias("project")).distinct()


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' AND text <> '' THEN text END AS token FROM conversations")
def sse_tokens(spark, sf):
    body = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    line = F.when(F.col("role") == "assistant", body).otherwise("data: [DONE]")
    return t(spark, sf, "conversations").select("conv_id", "turn", X.sse_token(line).alias("token"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' AND text <> '' THEN text END AS token FROM conversations")
def sse_deltas(spark, sf):
    body = F.concat(F.when(F.col("role") == "assistant", "event: content_block_delta").otherwise("event: ping"), F.lit("\ndata: "), F.to_json(F.struct(F.struct("text").alias("delta"))))
    return t(spark, sf, "conversations").select("conv_id", "turn", X.sse_delta(body).alias("token"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\n"))
    return t(spark, sf, "events").select("event_id", F.get_json_object(X.json_block(answer), "$.k").cast("long").alias("k"))


@query("SELECT event_id, event_type AS summary, 1 AS findings, 0 AS dependencies FROM events WHERE event_type IS NOT NULL")
def answer_parse(spark, sf):
    finding = F.array(F.struct(F.col("event_type").alias("title"), F.lit("seen").alias("description")))
    dependency = F.array().cast("array<struct<name:string,description:string,is_external:boolean>>")
    answer = F.concat(F.lit("Sure. "), F.to_json(F.struct(F.col("event_type").alias("summary"), finding.alias("findings"), dependency.alias("dependencies"), F.lit("do").alias("suggested_approach"))))
    # a filter on what was parsed would parse it once more
    rows = t(spark, sf, "events").select("event_id", F.explode(F.array_compact(F.array(tasks.parsed_answer(answer)))).alias("a"))
    return rows.select("event_id", "a.summary", F.size("a.findings").alias("findings"), F.size("a.dependencies").alias("dependencies"))


@query(r"SELECT conv_id, turn, 'Study the code below for this task and answer in JSON with summary, findings, dependencies and suggested_approach.' || chr(10) || chr(10) || 'Task: ' || role || chr(10) || chr(10) || coalesce(text, '') AS research, 'Revise the answer below.' || chr(10) || chr(10) || 'Summary:' || chr(10) || role || chr(10) || chr(10) || 'Suggested approach:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'What to change:' || chr(10) || 'all' AS refinement FROM conversations")
def task_prompts(spark, sf):
    role, said = F.col("role"), F.col("text")
    return t(spark, sf, "conversations").select("conv_id", "turn", tasks.research_prompt(role, said).alias("research"), tasks.refinement_prompt(role, said, F.lit("all")).alias("refinement"))


@query("""WITH l AS (SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS task_name, l_linenumber AS n, CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supp, l_returnflag AS flag, l_linestatus AS status FROM lineitem),
g AS (SELECT task_name, string_agg('### part ' || part || chr(10) || chr(10) || flag || chr(10) || CASE WHEN status = 'F' THEN chr(10) || '- `f' || part || '`' ELSE '' END, chr(10) ORDER BY n, part, supp, flag, status) FILTER (flag <> 'N') AS findings,
  string_agg('### s' || supp || chr(10) || chr(10) || status || chr(10), chr(10) ORDER BY n, part, supp, flag, status) FILTER (flag = 'N') AS dependencies, string_agg('- n' || CAST(n AS VARCHAR), chr(10) ORDER BY n, part, supp, flag, status) FILTER (status = 'O') AS sources, count(*) AS lines FROM l GROUP BY task_name)
SELECT task_name, '# Research: ' || task_name || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || CAST(lines AS VARCHAR) || ' lines' || chr(10) || chr(10) || coalesce('## Codebase analysis' || chr(10) || chr(10) || findings || chr(10), '') || coalesce('## Dependencies' || chr(10) || chr(10) || dependencies || chr(10), '')
  || '## Suggested approach' || chr(10) || chr(10) || 'go' || chr(10) || coalesce(chr(10) || '## Sources' || chr(10) || chr(10) || sources, '') AS text FROM g""")
def research_documents(spark, sf):
    """Orders as research documents: lines that came back are findings, the others dependencies."""
    text = lambda c: F.col(c).cast("string")
    order = [F.col(c).alias(f"o{k}") for k, c in enumerate(("l_linenumber", "part", "supp", "l_returnflag", "l_linestatus"))]
    lines = t(spark, sf, "lineitem").withColumns({"part": text("l_partkey"), "supp": text("l_suppkey")})
    back, files = F.col("l_returnflag") != "N", F.when(F.col("l_linestatus") == "F", F.array(F.concat(F.lit("f"), "part")))
    finding = F.struct(*order, F.concat(F.lit("part "), "part").alias("title"), F.col("l_returnflag").alias("description"), files.alias("related_files"))
    dependency = F.struct(*order, F.concat(F.lit("s"), "supp").alias("name"), F.col("l_linestatus").alias("description"), F.lit(True).alias("is_external"))
    listed = lambda which, x: F.array_sort(F.collect_list(F.when(which, x)))
    rows = lines.groupBy(text("l_orderkey").alias("task_name")).agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" lines")).alias("summary"), listed(back, finding).alias("codebase_analysis"), listed(~back, dependency).alias("dependencies"), F.lit("go").alias("suggested_approach"),
        F.transform(listed(F.col("l_linestatus") == "O", F.struct(*order)), lambda x: F.concat(F.lit("n"), x["o0"].cast("string"))).alias("sources"),
    )
    return tasks.documents(rows)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS created FROM orders")
def task_times(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", X.to_the_minute(F.col("o_orderdate")).alias("created"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(repeat('Brand#', p_partkey % 3) || p_brand || repeat('.x', p_size % 3), '^(Brand#)+', ''), '([.]x)+$', '') AS name FROM part")
def stripped_names(spark, sf):
    wrapped = F.concat(F.repeat(F.lit("Brand#"), (F.col("p_partkey") % 3).cast("int")), "p_brand", F.repeat(F.lit(".x"), F.col("p_size") % 3))
    return t(spark, sf, "part").select("p_partkey", X.stripped(wrapped, "Brand#", ".x").alias("name"))


@query(f"SELECT {CODE_PATH} AS path FROM documents WHERE lang IN ('en', 'fr') UNION ALL SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.tar.kts' FROM documents WHERE lang = 'es'")
def context_files(spark, sf):
    """Files for a plain context: extensions count as they are written, and names such as Makefile are no extensions."""
    rows = t(spark, sf, "documents")
    others = rows.where("lang = 'es'").select(F.explode(F.array(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tar.kts")), F.concat("source", F.lit("/Makefile")))).alias("path"))
    paths = rows.select(_code_path().alias("path")).unionByName(others)
    return paths.where(context.eligible(F.col("path")))


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'private') AS visibility, 0 AS start_line, CASE WHEN c_acctbal >= 0 THEN c_name END AS doc_comment, CAST(NULL AS VARCHAR) AS note FROM customer")
def column_defaults(spark, sf):
    """Columns that rows lack or leave null have their defaults."""
    good = F.col("c_acctbal") >= 0
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(good, F.col("c_mktsegment")).alias("visibility"), F.when(good, F.col("c_name")).alias("doc_comment"))
    return with_defaults(rows, schemas.struct("id long;visibility string;start_line int;doc_comment string?;note string?"), {"visibility": "private", "start_line": 0})


ORACLE_SQL["chunk_embeddings"] = extraction.ORACLE_SQL.pop("chunk_embeddings").replace("{chunks}", CHUNKS.rstrip())
QUERIES |= extraction.QUERIES | incremental.QUERIES | legacy.QUERIES
ORACLE_SQL |= extraction.ORACLE_SQL | incremental.ORACLE_SQL | legacy.ORACLE_SQL
