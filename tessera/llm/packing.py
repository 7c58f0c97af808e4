"""Length buckets with the least padding, and token-budget batches inside them.

A document of n words gives ceil(n / max_len) sequences: pieces of max_len words and the rest. Lengths therefore lie in
0..max_len, and the global histogram, counted over all sequences with partial sums, has at most max_len + 1 rows however
large the corpus is. Dynamic programming over it picks the n_buckets boundaries that minimise the total padding. Each
bucket has room for budget // boundary sequences a batch. Batches are numbered through by a rank inside the bucket that
no task has to sort as a whole: sequences fall by hash into about sqrt(N) shards, the counts of bucket and shard are
summed up over the shards, and only rows of one shard are ordered together. So a bucket may hold all rows.

Edge cases: a null or empty text is one sequence of length 0; a row whose id is null is packed like any other; repeated
rows are packed each; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_CLASS, cut


def boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Ascending upper lengths of at most n_buckets buckets that cover all lengths with the least total padding."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
    m = len(lengths)
    if not m:
        return []
    counts = np.array([histogram[int(k)] for k in lengths], np.float64)
    n, words = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(counts * lengths)])
    # best[j]: least padding of the first j lengths; a bucket of lengths i..j-1 pads each up to lengths[j-1]
    best, cuts = np.full(m + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(n_buckets, m)):
        new, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (words[j] - words[:j])
            at[j] = int(np.argmin(cost))
            new[j] = cost[at[j]]
        best = new
        cuts.append(at)
    out, j = [], m
    for at in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(at[j])
    return out[::-1]


def pack(docs: DataFrame, n_buckets: int = 16, max_len: int = 2048, budget: int = 16384, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per sequence: id, piece (from 0; it starts at word piece * max_len), n_tokens, bucket, bucket_len, batch (within the bucket), slot (within the batch)."""
    size = F.when(F.length(text_column) > 0, F.regexp_count(F.col(text_column), F.lit(WORD_CLASS))).otherwise(0).cast("long")
    sequences = cut(
        docs.select(F.col(id_column), size.alias("_n"))
        .select(id_column, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / max_len) - 1, F.lit(0)))).alias("piece"))
        .select(id_column, "piece", F.least(F.col("_n") - F.col("piece") * max_len, F.lit(max_len)).cast("int").alias("n_tokens"))
    )
    histogram = {r[0]: r[1] for r in sequences.groupBy("n_tokens").count().collect()}  # at most max_len + 1 rows
    ends = boundaries(histogram, n_buckets) or [1]
    shards = max(1, math.isqrt(sum(histogram.values())))
    of_length = [next(k for k, e in enumerate(ends) if n <= e) if n <= ends[-1] else len(ends) - 1 for n in range(max_len + 1)]
    rooms = [max(1, budget // max(1, e)) for e in ends]

    def look_up(values: list[int], at: str) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(at) + 1)

    placed = sequences.withColumn("bucket", look_up(of_length, "n_tokens")).withColumn("_shard", F.pmod(F.xxhash64(id_column, "piece", "n_tokens"), F.lit(shards)))
    before = F.sum("_count").over(Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_count")).select("bucket", "_shard", F.coalesce(before, F.lit(0)).alias("_start"))
    in_shard = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy(id_column, "piece", "n_tokens"))
    ranked = placed.withColumn("_row", in_shard).join(starts, ["bucket", "_shard"]).withColumn("_rank", F.col("_start") + F.col("_row") - 1)
    room = look_up(rooms, "bucket").cast("long")
    return ranked.select(
        id_column, "piece", "n_tokens", "bucket", look_up(ends, "bucket").alias("bucket_len"), F.floor(F.col("_rank") / room).cast("long").alias("batch"), F.pmod(F.col("_rank"), room).cast("int").alias("slot")
    )
