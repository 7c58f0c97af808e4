"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the nearest signed axis.
A table joins as many hashes as its size asks for: each has the 2d signed axes, the last one as many of them (a power of
two) as let a cell hold about CELL vectors on average, so cells don't grow with the table. A query probes, in each
table, the cells whose axes are nearest to its rotated coordinates. How many is measured: for SAMPLED queries, drawn by a
hash, the true neighbours are found exactly, and the least number, by steps of a fifth, is taken that finds TARGET of them. Vectors with
near neighbours need few probes. If MOST_PROBES don't find as many, or all tables' probes are as many as a table's cells,
then all queries are searched exactly instead, which costs less.

Index rows meet queries by (table, cell). A cell with more than PART rows or queries becomes a grid of blocks of bounded
size, so a hot cell is no hot spot. A task compares a block's queries with its vectors by matrix products, reranks
exactly and emits at most k vectors per query; pairs are never emitted. Equal vectors are indexed once, with their k + 1
smallest ids, which is all that a list of k neighbours can hold. Queries that find fewer than k rows are searched again
with all vectors as one cell, in the same blocks; so is the sample.

Edge cases: null, empty or zero vectors, and vectors with null or non-finite components, take no part; vectors are
compared with vectors of their own length only; fewer than k other vectors give fewer rows; ties go to the smaller id;
among rows with equal ids the nearest counts, and none is a candidate of a query with that id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

TABLES = 6
CELL = 64
PART = 4096
SEED = 20_240_229
SAMPLED = 64
TARGET = 0.95
MOST_PROBES = 1 << 14
#: Cells that a worker weighs up at once.
WEIGHED = 1 << 22


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, seed: int, axes: int) -> np.ndarray:
    """Coordinates along the first `axes` signed axes after a pseudo-rotation in the next power of two of dimensions."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    random = np.random.default_rng(seed)
    for _ in range(3):
        x = _hadamard(x * random.choice([-1.0, 1.0], d))
    return np.concatenate([x[:, : axes // 2], -x[:, : axes // 2]], 1)


def hash_axes(n: int, dimension: int) -> list[int]:
    """Signed axes of each hash of a table of n vectors."""
    full = 2 << max(0, (dimension - 1).bit_length())
    out, wanted = [full], n / CELL / full
    while round(math.log2(max(wanted, 1))) > 0 and len(out) < 4:
        out.append(min(full, 1 << round(math.log2(wanted))))
        wanted /= full
    return out


def cells(x: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    """The cell of each unit vector in a table."""
    out = np.zeros(len(x), np.int64)
    for k, a in enumerate(axes):
        out = out * a + rotated(x, SEED + 8 * table + k, a).argmax(1)
    return out


def probes(x: np.ndarray, table: int, axes: list[int], count: int) -> np.ndarray:
    """The `count` cells nearest to each unit vector."""
    far, name = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for k, a in enumerate(axes):
        y = rotated(x, SEED + 8 * table + k, a)
        y = (y.max(1, keepdims=True) - y) ** 2
        far = (far[:, :, None] + y[:, None, :]).reshape(len(x), -1)
        name = (name[:, :, None] * a + np.arange(a)[None, None, :]).reshape(len(x), -1)
        if far.shape[1] > count:  # a cell among the nearest is made of nearest parts
            best = np.argpartition(far, count - 1, 1)[:, :count]
            far, name = np.take_along_axis(far, best, 1), np.take_along_axis(name, best, 1)
    return name


def probe_count(pairs: list[tuple[bytes, bytes]], axes: list[int], tables: int) -> int:
    """The least number of probes in each table, by steps of a fifth, that finds TARGET of the given neighbours (query, neighbour); 0 if it is too large."""
    most = min(MOST_PROBES, (math.prod(axes) - 1) // tables)
    if not pairs or most < 1:
        return max(0, most)
    asked, others = (_unit(_matrix([p[side] for p in pairs])) for side in (0, 1))
    own = [cells(others, t, axes) for t in range(tables)]
    count = 1
    while count <= most:
        met, step = np.zeros(len(pairs), bool), max(1, WEIGHED // (count * max(axes)))
        for t in range(tables):
            for begin in range(0, len(pairs), step):
                part = slice(begin, begin + step)
                met[part] |= (probes(asked[part], t, axes, count) == own[t][part, None]).any(1)
        if met.mean() >= TARGET:
            return count
        count = max(count + 1, count * 6 // 5)
    return 0


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vector (bytes of doubles), d: the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for own, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(own)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array([len(v) // 8 for v in out], pa.int32())], names=["id", "vector", "d"])

    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).mapInArrow(run, "id long, vector binary, d int")


def _closest(q: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the positions and exact distances of the k nearest rows of x, those tied with the last included."""
    out, squares = [], np.einsum("ij,ij->i", x, x)
    for begin in range(0, len(q), 256):
        part = q[begin : begin + 256]
        own = np.einsum("ij,ij->i", part, part)
        near = own[:, None] + squares[None, :] - 2 * (part @ x.T)
        for i in range(len(part)):
            edge = np.inf if k >= len(x) else np.partition(near[i], k - 1)[k - 1]
            at = np.flatnonzero(near[i] <= edge + 1e-9 * (own[i] + squares.max()))
            exact = np.sqrt(((part[i] - x[at]) ** 2).sum(1))
            if len(at) > k:
                fine = exact <= np.partition(exact, k - 1)[k - 1]
                at, exact = at[fine], exact[fine]
            out.append((at, exact))
    return out


def _search(index: DataFrame, asked: DataFrame, axes: dict[int, list[int]], counts: dict[int, int], tables: int, k: int) -> DataFrame:
    """query_id, vec_id, score: what the probed cells hold, at least the k nearest of each block."""

    def cell_rows(batches: Iterator[pa.RecordBatch], searching: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vector = np.array(batch.column(1).to_pylist(), np.int64), batch.column(0).to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                step = max(1, min(128, WEIGHED // (counts[d] * max(axes[d])))) if searching else 128
                for begin in range(0, len(at), step):
                    part = at[begin : begin + step]
                    x = _unit(_matrix([vector[i] for i in part]))
                    found = [probes(x, t, axes[d], counts[d]) if searching else cells(x, t, axes[d])[:, None] for t in range(tables)]
                    names = [pa.array((c * tables + t).ravel(), pa.int64()) for t, c in enumerate(found)]
                    for c, name in zip(found, names):
                        take = pa.array(np.repeat(part, c.shape[1]))
                        yield pa.RecordBatch.from_arrays([name, *[batch.column(j).take(take) for j in range(3)]], names=["cell", "vector", "d", "ids"])

    layout = "cell long, vector binary, d int, ids array<long>"
    rows = cut(index.select("vector", "d", "ids").mapInArrow(lambda b: cell_rows(b, False), layout).withColumn("q", F.lit(0)))
    wanted = cut(asked.select("vector", "d", F.array("id").alias("ids")).mapInArrow(lambda b: cell_rows(b, True), layout).withColumn("q", F.lit(1)))
    n_rows, n_asked = (df.groupBy("cell", "d").agg(F.count(F.lit(1)).alias(name)) for df, name in ((rows, "n_rows"), (wanted, "n_asked")))
    grid = n_rows.join(n_asked, ["cell", "d"]).select("cell", "d", F.ceil(F.col("n_rows") / PART).alias("across"), F.ceil(F.col("n_asked") / PART).alias("down"), (F.col("n_rows") + F.col("n_asked")).alias("size"))
    grid = cut(grid)
    bins = max(1, int((grid.agg(F.sum("size")).first()[0] or 0) // PART))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("q") == 0, F.col("down")).otherwise(F.col("across")) - 1))
    placed = rows.union(wanted).join(grid, ["cell", "d"]).withColumn("other", other).withColumn("own", F.pmod(F.xxhash64("ids"), F.when(F.col("q") == 0, F.col("across")).otherwise(F.col("down"))))
    x, y = F.when(F.col("q") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("q") == 0, F.col("other")).otherwise(F.col("own"))
    blocks = placed.select(F.xxhash64("cell", "d", x, y).alias("block"), "vector", "ids", "q").withColumn("bin", F.pmod("block", F.lit(bins)))

    def compare(part: pa.Table) -> pa.Table:
        by_block: dict[int, tuple[list, list]] = {}
        for block, vector, ids, q in zip(*(part.column(c).to_pylist() for c in ("block", "vector", "ids", "q"))):
            by_block.setdefault(block, ([], []))[q].append((vector, ids))
        best: dict[int, dict[int, float]] = {}
        for held, searching in by_block.values():
            if held and searching:
                x = _matrix([v for v, _ in held])
                times = Counter(i for _, ids in held for i in ids)
                spare = max(times[own[0]] for _, own in searching)  # places that a query's own rows may take
                for (_, own), (at, exact) in zip(searching, _closest(_matrix([v for v, _ in searching]), x, k + spare)):
                    kept = best.setdefault(own[0], {})
                    for p, s in zip(at.tolist(), exact.tolist()):
                        for i in held[p][1]:
                            if i != own[0] and s < kept.get(i, np.inf):
                                kept[i] = s
        out = [(q, i, s) for q, found in best.items() for s, i in sorted((s, i) for i, s in found.items())[:k]]
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    return blocks.groupBy("bin").applyInArrow(compare, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: F.Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest rows found for each row whose id column satisfies `queries`."""
    usable = cut(clean(vectors, id_column, vector_column))
    asked = cut(usable.withColumnRenamed("id", id_column).where(queries).withColumnRenamed(id_column, "id").dropDuplicates(["id", "vector"]))
    # equal vectors are one candidate; their copies are thinned out before they meet
    first = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    dealt = usable.groupBy("vector", "d", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("salt")).agg(first(F.collect_set("id")).alias("ids"))
    index = cut(dealt.groupBy("vector", "d").agg(first(F.flatten(F.collect_list("ids"))).alias("ids")))
    sizes = {r[0]: r[1] for r in index.groupBy("d").count().collect()}  # one row per vector length
    axes = {d: hash_axes(n, d) for d, n in sizes.items()}
    whole = {d: [2] for d in sizes}, {d: 2 for d in sizes}, 1  # all vectors in the two cells of one axis, both probed
    drawn = cut(asked.orderBy(F.xxhash64("id", "vector")).limit(SAMPLED))
    true = _search(index, drawn, *whole, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    true = true.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    near = usable.select(F.col("id").alias("vec_id"), F.col("vector").alias("other"), F.col("d").alias("other_d")).join(true, "vec_id").dropDuplicates(["query_id", "vec_id"])
    pairs = near.join(drawn, (F.col("id") == F.col("query_id")) & (F.col("d") == F.col("other_d"))).select("d", "vector", "other").collect()  # at most SAMPLED k rows for each repeated id
    counts = {d: probe_count([(r[1], r[2]) for r in pairs if r[0] == d], axes[d], tables) for d in sizes}

    probed = [d for d, n in counts.items() if n]
    found = cut(_search(index, asked.where(F.col("d").isin(probed)), axes, counts, tables, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    served = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    starving = cut(asked.join(served, "id", "left_anti"))
    if starving.limit(1).count():
        again = _search(index, starving, *whole, k)
        found = found.union(again).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
