"""Vector similarity and search, and the embedder interface."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block: of queries, and of what is searched.
QUERIES, CHUNKS = 4096, 16384
#: Queries of a block that are multiplied at once.
ASKED = 256
#: Texts that are embedded at once.
TEXTS = 256
SPACE = re.compile(r"[\x20\x09-\x0D]+")
Embedder = Callable[[Sequence[str]], list[list[float]]]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def top_k(chunks: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", ties: Sequence[str] = ()) -> DataFrame:
    """The k rows most similar to one query vector, with their score. Plans as TakeOrderedAndProject: k rows a task reach the driver."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return chunks.withColumn("score", F.round(cosine(F.col(vector), literal), 6)).orderBy(F.desc("score"), *ties).limit(k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; one that is null or of another length than the first whole one is not a number."""
    rows = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    size = int(sizes[sizes > 0][0]) if (sizes > 0).any() else 0
    values = rows.flatten()
    if (sizes == size).all() and not values.null_count:
        return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    whole = [r if r is not None and len(r) == size and None not in r else [np.nan] * size for r in rows.to_pylist()]
    return np.array(whole, np.float64).reshape(len(rows), size)


def _best_of_block(queries: pa.Table, chunks: pa.Table, k: int) -> pa.Table:
    """The k best chunks of a block for each query of another."""
    q, c = _matrix(queries.column("v")), _matrix(chunks.column("v"))
    if not len(q) or not len(c) or q.shape[1] != c.shape[1]:
        return _scored([], [], [])
    order = np.lexsort(([-1 if x is None else x for x in chunks.column("id").to_pylist()],))
    c, ids, owners = c[order], np.array(chunks.column("id").to_pylist(), object)[order], np.array(queries.column("id").to_pylist(), object)
    norms, k = np.linalg.norm(c, axis=1), min(k, len(c))
    parts = []
    for at in range(0, len(q), ASKED):
        own = q[at : at + ASKED]
        lengths = np.linalg.norm(own, axis=1)[:, None] * norms[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(lengths > 0, np.round(own @ c.T / lengths, 6), np.nan)
        rows, places = _greatest(np.where(np.isnan(score), -np.inf, score), k)  # what is no number comes last
        taken = score[rows, places]
        parts.append((owners[at + rows].tolist(), ids[places].tolist(), [None if np.isnan(x) else x for x in taken.tolist()]))
    return _scored(*(list(itertools.chain.from_iterable(x)) for x in zip(*parts)))


def _greatest(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest values of each row, greatest first, of equal ones the first columns. Only values from the k-th on are sorted."""
    least = np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]
    above, level = values > least[:, None], values == least[:, None]
    level &= np.cumsum(level, axis=1, dtype=np.int32) <= (k - above.sum(axis=1))[:, None]
    rows, columns = np.nonzero(above | level)
    sort = np.lexsort((columns, -values[rows, columns], rows))
    return rows[sort], columns[sort]


def _scored(owners: list, ids: list, scores: list) -> pa.Table:
    return pa.table({"query_id": pa.array(owners, pa.int64()), "chunk_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})


def top_k_of_each(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, chunk_id: str, vector: str = "embedding") -> DataFrame:
    """The k most similar chunks of each query of a table: query_id, chunk_id, score, rank. Both tables: a whole number as id, and a vector.

    Blocks of QUERIES queries meet blocks of CHUNKS chunks, each pair of blocks in one task as a product of matrices, of which
    k chunks a query go on; these are ranked once more. So chunks are copied once a block of queries, queries once a block of
    chunks, and no task holds more than two blocks. Ids of queries are distinct. Scores are rounded to six places; ties go to
    smaller ids; vectors that are null, of no length, or of another size than the others come last, without a score.
    """
    blocks_q, blocks_c = -(-queries.count() // QUERIES) or 1, -(-chunks.count() // CHUNKS) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
        return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), block.alias(own)).select("*", every(m).alias(other))

    q, c = dealt(queries, query_id, "_q", blocks_q, "_c", blocks_c), dealt(chunks, chunk_id, "_c", blocks_c, "_q", blocks_q)
    met = q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInArrow(lambda a, b: _best_of_block(a, b, k), "query_id long, chunk_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


@functools.lru_cache(1 << 16)
def _place(word: str) -> tuple[int, float]:
    """A number and a sign from a word's MD5."""
    h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(h[:15], 16), 1.0 if h[15] >= "8" else -1.0


def hashing_embedder(dimension: int = 384) -> Embedder:
    """A deterministic stand-in for a model: signed counts of words in buckets by their MD5, at unit length. Each word is hashed once a process, up to a bound."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            for word, n in Counter(SPACE.split((text or "").lower())).items():
                if word:
                    number, sign = _place(word)
                    row[number % dimension] += sign * n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1.0)).tolist()

    return embed


def embedded(df: DataFrame, text: str, embedder: Embedder | Callable[[], Embedder], into: str = "embedding") -> DataFrame:
    """df with a vector for each text, in Arrow batches, of which TEXTS at a time are embedded and kept as plain arrays."""

    step = TEXTS

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            made = (v for k in range(0, len(texts), step) for v in embedder(texts[k : k + step]))
            yield pd.Series([np.asarray(v, np.float32) for v in made], dtype=object)

    return df.withColumn(into, run.asNondeterministic()(text))  # or a filter on vectors would have them made twice


def search_text(chunks: DataFrame, text: str, embedder: Embedder, k: int = 10) -> DataFrame:
    """Search results for a text: path, score, lines, preview, entity."""
    found = top_k(chunks, embedder([text])[0], k, ties=("file_path", "start_line"))
    return found.select(F.col("file_path").alias("path"), "score", "start_line", "end_line", F.substring("content", 1, 200).alias("preview"), "entity_id", "entity_type")


def http_shape(results: DataFrame) -> DataFrame:
    """Search results as graph nodes: key, label, category, path, score."""
    kind = F.when(F.endswith("path", F.lit(".rs")), "function").otherwise("unknown")
    label = F.coalesce(F.nullif(F.col("preview"), F.lit("")), F.col("path"))
    return results.select(F.concat_ws(":", F.lit("chunk"), "path", F.col("start_line").cast("string")).alias("key"), label.alias("label"), kind.alias("category"), "path", "score")
