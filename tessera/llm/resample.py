"""Resampling of documents towards a target distribution, by hashed n-gram weights and Gumbel scores.

1. The features of a text are its runs of 1 to 3 words; each falls in one of 10,000 buckets by crc32. Features per bucket
   are counted over all documents and over all texts of the target, summed within a task before they are shuffled; 10,000
   numbers a table go to the driver, which makes a bucket's gain of them.
2. Array-scored weights: a run of texts is one array of word places. The crc32 of a run of words follows from those of its
   words, since crc32(a + b) is a linear map of crc32(a), by b's length, xor crc32(b); so texts are weighted by array
   look-ups, with no string for a feature. A row's score is its weight plus a Gumbel number from a hash of its id: the
   highest scores are a draw without replacement.
3. Exact integer-score histogram: rows are counted by score; the histogram, one row a score, is dealt out by ranges of the
   score, and the counts of higher ranges and of higher scores within one give the rows above each score, whence the rank
   offset of a score and the lowest score that is drawn. Only rows at or above it are numbered, by id within their score.

Edge cases: a null or empty text has no words, no features and weight 0; rows of fewer than LEAST_WORDS words are never
drawn; a null id hashes as an empty string and comes behind others in a tie; equal rows are drawn each (they tie, and have
ranks of their own); an empty target or no documents give gains by the same formula or an empty result; other columns are
ignored. Scores are whole numbers, so no sum depends on an order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import runs_of_texts, split_words, stored

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 5
SEED = 42
#: Copies of a row that one task writes out.
RUN = 1 << 16
POLYNOMIAL = 0xEDB88320


def _zero_bytes() -> tuple[np.ndarray, np.ndarray]:
    """What n zero bytes behind a text do to its crc32, as tables by byte of the crc: for n below 64, and for n = 2^k."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    at = np.arange(256, dtype=np.uint32)
    few = np.empty((64, 4, 256), np.uint32)
    few[0] = np.stack([at << np.uint32(8 * k) for k in range(4)])
    for n in range(1, 64):
        few[n] = (few[n - 1] >> 8) ^ byte[few[n - 1] & 255]
    power = np.empty((32, 4, 256), np.uint32)
    power[0] = few[1]
    for k in range(1, 32):
        power[k] = _mapped(power[k - 1], power[k - 1])
    return few, power


def _mapped(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


FEW, POWER = _zero_bytes()


def behind(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The crc32s carried over so many bytes behind; xor the crc32 of these bytes, it is that of both together."""
    if len(sizes) and int(sizes.max()) >= 64:
        crc = crc.copy()
        for k in range(6, 32):
            if (here := np.flatnonzero((sizes >> k) & 1)).size:
                crc[here] = _mapped(POWER[k], crc[here])
        sizes = sizes & 63
    flat, at = FEW.reshape(-1), sizes.astype(np.int64) << 10
    return flat[at + (crc & 255)] ^ flat[at + 256 + ((crc >> 8) & 255)] ^ flat[at + 512 + ((crc >> 16) & 255)] ^ flat[at + 768 + (crc >> 24)]


#: Bytes of words, A-Z lower-cased; all others become spaces. Every byte from 0x80 on is part of a word.
WORD_BYTES = np.array([b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)


def _plain(texts: pa.Array) -> pa.Array:
    """texts with their words in lower case and single spaces or more between them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    begin, end = texts.offset, texts.offset + len(texts)
    places = np.frombuffer(offsets, np.int64)[begin : end + 1]
    words = WORD_BYTES[np.frombuffer(data, np.uint8)[places[0] : places[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((places - places[0]).tobytes()), pa.py_buffer(words)])


def features(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many words each text has; for runs of 1, 2 and 3 words, where they begin and the bucket of each."""
    at, sizes, words = split_words(_plain(texts))
    alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))[at]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))[at]
    length = np.fromiter(map(len, words), np.int64, len(words))[at] + 1
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(at))  # words from here to the text's end
    found, crc = [(np.arange(len(at)), (alone % BUCKETS).astype(np.int64))], alone
    for n in (2, 3):
        crc = behind(crc[: len(at) - n + 1], length[n - 1 :]) ^ spaced[n - 1 :] if len(at) >= n else crc[:0]
        inside = np.flatnonzero(left[: len(crc)] >= n)
        found.append((inside, (crc[inside] % BUCKETS).astype(np.int64)))
    return sizes, found


def bucket_counts(texts: DataFrame) -> DataFrame:
    """texts: one column of strings. bucket, n: the features of all rows in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in runs_of_texts(batch.column(0)):
                for _, buckets in features(part)[1]:
                    total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(texts: DataFrame, target: DataFrame) -> list[int]:
    """A thousandth of the logarithm of the ratio between a bucket's shares of the target and of all texts, both smoothed by one, rounded down."""
    s, t = ({r[0]: r[1] for r in bucket_counts(x).collect()} for x in (texts, target))  # at most BUCKETS rows each
    all_s, all_t = float(sum(s.values()) + BUCKETS), float(sum(t.values()) + BUCKETS)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(BUCKETS)]


def weighted(docs: DataFrame, gain: list[int]) -> DataFrame:
    """docs: an id and a text. The id, n_words, n_features, weight of every row."""
    of = np.array(gain, np.int64)
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, weights = [], []
            for part in runs_of_texts(batch.column(1)):
                sizes, found = features(part)
                sums = np.zeros(int(sizes.sum()) + 1, np.int64)
                for begin, buckets in found:
                    sums[1 + begin] += of[buckets]
                ends, sums = np.cumsum(sizes), np.cumsum(sums)
                words.append(sizes)
                weights.append(sums[ends] - sums[ends - sizes])
            n = np.concatenate([np.zeros(0, np.int64), *words])
            count = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, count, np.concatenate([np.zeros(0, np.int64), *weights])))], names=["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_column: F.Column, seed: int) -> F.Column:
    """A thousandth of a standard Gumbel number from the first 32 bits of a hash of seed and id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def offsets(scores: DataFrame) -> DataFrame:
    """scores: a column score. score, n, above: each score once, its rows, and the rows of higher scores.

    Ranges of scores and their sums take the place of one ordered task.
    """
    dealt = stored(scores.groupBy("score").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("score").withColumn("range", F.spark_partition_id()))
    higher = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before"))  # a row for each partition
    within = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(ranges), "range").select("score", "n", (F.col("before") + F.col("own")).alias("above"))


def _written_out(rows: DataFrame) -> DataFrame:
    """A row for each of its copies; `first`, the rank of the first, becomes the rank of each."""
    each = lambda x: x.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k")).withColumn("first", F.col("first") + F.col("k")).drop("k", "copies")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))).alias("k")
    parts = rows.where(F.col("copies") > RUN).select("*", begins).withColumn("first", F.col("first") + F.col("k")).withColumn("copies", F.least(F.col("copies") - F.col("k"), F.lit(RUN))).drop("k")
    return each(rows.where(F.col("copies") <= RUN)).unionByName(each(parts.repartition("first")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_features, weight, score, rank. `share` percent of the rows of at least `least_words` words are drawn; the others' rank is null."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    gain = gains(rows.select("text"), target.select(F.col(text_column)))
    scored = stored(weighted(rows, gain).select("id", "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("fit")))
    above = stored(offsets(scored.where("fit").select("score")))
    drawn = share * (above.agg(F.sum("n")).first()[0] or 0) // 100
    cutoff = above.where(F.col("above") < drawn).agg(F.min("score")).first()[0]  # none if nothing is drawn
    high = F.col("fit") & (F.col("score") >= F.lit(cutoff).cast("long"))
    rest = scored.where(~F.coalesce(high, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    equal = scored.where(high).groupBy("score", "id", "n_features", "weight").agg(F.count(F.lit(1)).alias("copies"))
    earlier = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("own", F.coalesce(F.sum("copies").over(earlier), F.lit(0))).join(above.where(F.col("above") < drawn).drop("n"), "score").withColumn("first", F.col("above") + F.col("own") + 1)
    ranked = _written_out(placed).withColumn("rank", F.when(F.col("first") <= drawn, F.col("first")))
    columns = (F.col("id").alias(id_column), "n_features", "weight", "score", "rank")
    return rest.select(*columns).unionByName(ranked.select(*columns))


#: crc32 byte by byte over the distinct features, by its table of 256 numbers.
SQL = r"""
WITH entries AS (
  SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entry
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
), texts AS (
  SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark
), split AS (
  SELECT doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT doc_id, own, w, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS i FROM split
), found AS (
  SELECT doc_id, own, w[i] AS f FROM runs
  UNION ALL SELECT doc_id, own, w[i] || ' ' || w[i + 1] FROM runs WHERE i + 1 <= n_words
  UNION ALL SELECT doc_id, own, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM runs WHERE i + 2 <= n_words
), counted AS (
  SELECT doc_id, own, f, count(*) AS n FROM found GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, octet_length(encode(f)) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), entries
), bucketed AS (
  SELECT doc_id, own, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM bucketed GROUP BY bucket
), gained AS (
  SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS gain
  FROM totals, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM totals)
), weights AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM bucketed JOIN gained USING (bucket) WHERE own GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE own
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) FILTER (fit) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
