"""Near-duplicate documents: exact Jaccard join of word shingles over token-combination prefixes.

1. Every document becomes its set of distinct five-word shingles (64-bit codes); equal sets are one node.
2. A sketch of fixed size counts shingles over all documents. It orders them, rare first, and splits them into a rare
   class and a frequent class. Any function of the shingle would keep the join exact; the sketch only keeps it fast.
3. Prefixes. A set of m shingles can miss at most t = m - ceil(0.8 m) of them in a similar set, so of the first t + k
   shingles it shares k, and k = m / 16 are asked for. The rare class is indexed by single shingles; they do if the first
   t + k are all rare. Otherwise the prefix is extended into the frequent class, which is split by hash into CLASSES
   parts indexed by pairs from one part: an extension by one shingle for each part met makes up for the one shingle a
   part may share without sharing a pair. Sets too small for that use single shingles; sets around the border use both,
   so every similar pair meets in at least one signature.
4. A set stays if enough of its signatures occur elsewhere: k of the smallest set it may be similar to, or one if pairs
   are among them. Sets left that meet in a signature, at sizes within the ratio, fall into one cluster (linked to one
   leader each, never all pairs). A rare signature has a bounded number of rows; those of frequent shingles are salted
   into SUB parts first.
5. Within a cluster, blocks of bounded size verify every pair of fitting sizes exactly and hand back a spanning forest of
   the links. Components of these links are the result. No pair of linked texts is lost: components need no more links.

Edge cases: null and empty texts and texts without words have an empty set and stand alone; short texts are one shingle;
repeated rows and copies share a component; equal ids with different texts are separate nodes; a row whose id is null takes
part, and component_id is null only where no row of the component has an id; an empty table gives an empty result; other
columns are ignored. Two different shingles, or sets, share a 64-bit code with probability 2^-64.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import WORD_CLASS, WordHashes, checkpoint_dir, cut, mixed, runs_of_texts, split_words
from tessera.llm.components import components

WIDTH = 5
SKETCH_BITS = 22
SLICES = 64
CLASSES = 32
#: From this size on, CLASSES parts leave enough shingles: m - CLASSES >= m - ceil(0.8 m) + 1.
PAIRS_FROM = 41
#: Up to this size a set may be similar to one below PAIRS_FROM.
SINGLES_TO = 51
SUB = 64
#: Bounds of a block: sets, and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Size of the filter of wanted ids.
MARKS = 1 << 23
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(WIDTH)], np.uint64)


def shingle_sets(texts: pa.Array, memory: WordHashes) -> Iterator[np.ndarray]:
    """Sorted distinct shingle codes of each text."""
    for run in runs_of_texts(texts):
        at, sizes, words = split_words(run)
        hashes = memory.array(words)[at]
        code = np.zeros(max(0, len(hashes) - WIDTH + 1), np.uint64)
        for k in range(WIDTH):
            code += hashes[k : k + len(code)] * _POWERS[k]
        code = mixed(code)
        end = 0
        for n in sizes.tolist():
            begin, end = end, end + n
            if n >= WIDTH:
                yield np.unique(code[begin : end - WIDTH + 1])
            else:
                yield np.array([xxhash.xxh3_64_intdigest(b" ".join([words[k] for k in at[begin:end]]), 1)] if n else [], np.uint64)


def set_id(codes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(codes.tobytes()) - 2**63


def bucket(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shared(m: int) -> int:
    """How many shingles of its prefix a set of m has in common with any similar set whose prefix does not end before."""
    return max(1, m // 16)


def signatures(codes: np.ndarray, counts: np.ndarray, frequent: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of one set, whether each one is made of frequent shingles, and how many of them any similar set shares. counts: of the codes, by the sketch."""
    m = len(codes)
    if not m:
        return np.empty(0, np.uint64), np.empty(0, bool), 0
    order = np.lexsort((codes, counts))
    codes, often = codes[order], counts[order] > frequent
    missing = m - (4 * m + 4) // 5 + shared(m) - 1
    needed = shared((4 * m + 4) // 5)
    found, hot = [], []
    if m <= SINGLES_TO:
        found.append(mixed(codes[: missing + 1] ^ np.uint64(0x5851F42D4C957F2D)))
        hot.append(often[: missing + 1])
    if m >= PAIRS_FROM:
        rare = min(m - int(often.sum()), missing + 1)
        found.append(codes[:rare])
        hot.append(np.zeros(rare, bool))
        if rare < missing + 1:
            needed = 1
            missing -= shared(m) - 1
        if rare < missing + 1:
            rest = codes[rare:]
            part = (rest % np.uint64(CLASSES)).astype(np.int64)
            first = np.zeros(len(rest), bool)
            first[np.unique(part, return_index=True)[1]] = True
            enough = rare + np.arange(1, len(rest) + 1) - np.cumsum(first) >= missing + 1
            end = int(np.argmax(enough)) + 1
            rest, part = rest[:end], part[:end]
            for g in np.unique(part):
                own = np.sort(rest[part == g])
                if len(own) > 1:
                    i, j = np.triu_indices(len(own), 1)
                    found.append(mixed(own[i] * np.uint64(0xD6E8FEB86659FD93) + own[j]))
                    hot.append(np.ones(len(i), bool))
    return np.concatenate(found), np.concatenate(hot), needed


def _read(docs: DataFrame, id_column: str, text_column: str, row: Column | None = None) -> DataFrame:
    """id, text, key (hash of the text), row (what else tells rows apart)."""
    key = F.xxhash64(F.col(text_column))
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), key.alias("key"), (key if row is None else row).alias("row"))


def sets_and_sketch(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(id, key, row, node, n) of every row, in a shared table; and the global counts of the sketch's buckets."""
    kind = docs.schema["id"].dataType.simpleString()
    layout = f"id {kind}, key long, row long, node long, n long, slice int, counts binary"
    types = [to_arrow_type(docs.schema["id"].dataType), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in layout.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, sketch = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            node, size = [], []
            for codes in shingle_sets(batch.column(1), memory):
                node.append(set_id(codes))
                size.append(len(codes))
                np.add.at(sketch, bucket(codes), np.uint32(1))
            n = len(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        own = np.split(sketch, SLICES)
        used = [k for k in range(SLICES) if own[k].any()]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(used), t) for t in types[:5]], pa.array(used, pa.int32()), pa.array([zlib.compress(own[k].tobytes(), 1) for k in used], pa.binary())], names=names)

    def total(key: tuple, part: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in part.column("counts").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    path = f"{checkpoint_dir(docs.sparkSession)}/ngram-{uuid.uuid4()}"
    docs.mapInArrow(run, layout).write.parquet(path)
    made = docs.sparkSession.read.schema(layout).parquet(path)
    sketch = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint32)
    for r in made.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(total, "slice int, counts binary").collect():  # SLICES rows of fixed size
        sketch[r[0]] = np.frombuffer(r[1], np.uint32)
    return made.where("slice is null").select(*names[:5]), sketch.ravel()


def clusters(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """node, label: sets that may be similar to another one, by signatures."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)  # of fixed size
    frequent = max(256.0, 4.0 * float(sketch.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen, counts = WordHashes(), set(), sent.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for codes in shingle_sets(batch.column(1), memory):
                own = set_id(codes)
                if not len(codes) or own in seen:  # copies within a task are sent once
                    continue
                seen.add(own)
                found, hot, needed = signatures(codes, counts[bucket(codes)], frequent)
                n = len(found)
                for column, values in zip(out, (found.view(np.int64), np.full(n, own, np.int64), np.full(n, len(codes), np.int32), np.where(hot, own % SUB, -1).astype(np.int8), np.full(n, needed, np.int32))):
                    column.append(values)
            if len(seen) > 500_000:
                seen.clear()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["sig", "node", "size", "sub", "needed"])

    rows = docs.mapInArrow(run, "sig long, node long, size int, sub byte, needed int")
    group = Window.partitionBy("sig", "sub")
    met = rows.withColumn("met", F.min("node").over(group) < F.max("node").over(group)).where("met or sub >= 0").drop("met")
    path = f"{checkpoint_dir(docs.sparkSession)}/ngram-{uuid.uuid4()}"
    met.write.parquet(path)
    met = docs.sparkSession.read.schema(met.schema).parquet(path).dropDuplicates(["sig", "node"])
    enough = met.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("k")).where("n >= k").select("node")
    left = met.join(enough, "node", "left_semi")
    by_size = group.orderBy("size", "node")
    begins = F.coalesce(4 * F.col("size") > 5 * F.lag("size").over(by_size), F.lit(True))
    # the leader of a run of sizes in which each fits the one before
    runs = left.withColumn("leader", F.when(begins, F.col("node"))).withColumn("leader", F.last("leader", ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    tied = cut(runs.where("leader <> node or sub >= 0").select("sig", "sub", "leader", "node", "size"))
    parts = tied.where("sub >= 0").groupBy("sig", "sub", "leader").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    by_low = Window.partitionBy("sig").orderBy("low", "sub", "leader")
    reach = F.max("high").over(by_low.rowsBetween(Window.unboundedPreceding, -1))
    joined = parts.withColumn("head", F.when(F.coalesce(4 * F.col("low") > 5 * reach, F.lit(True)), F.col("leader"))).withColumn("head", F.last("head", ignorenulls=True).over(by_low.rowsBetween(Window.unboundedPreceding, 0)))
    links = tied.select(F.col("leader").alias("a"), F.col("node").alias("b")).union(joined.select(F.col("head").alias("a"), F.col("leader").alias("b")))
    return components(links)


def _forest(groups: list[tuple[int, np.ndarray, int, int]]) -> list[tuple[int, int]]:
    """Spanning links among (node, codes, side, low) of one block; side 0 meets all later ones, sides 1 and 2 only each other."""
    if len(groups) < 2:
        return []
    groups = sorted(groups, key=lambda g: (len(g[1]), g[0]))
    sizes = np.array([len(g[1]) for g in groups], np.int64)
    side = np.array([g[2] for g in groups])
    codes = np.unique(np.concatenate([g[1] for g in groups]), return_inverse=True)[1].ravel()
    ends = np.cumsum(sizes)
    begins = ends - sizes
    flags = np.zeros(int(codes.max()) + 1, np.int32)
    root = list(range(len(groups)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = []
    for i in range(len(groups) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * 5 // 4, "right"))
        if last <= i + 1:
            continue
        own = codes[begins[i] : ends[i]]
        flags[own] = 1
        common = np.add.reduceat(flags[codes[begins[i + 1] : ends[last - 1]]], begins[i + 1 : last] - begins[i + 1])
        flags[own] = 0
        fits = 100 * common >= 80 * (sizes[i] + sizes[i + 1 : last] - common)
        if side[i]:
            fits &= side[i + 1 : last] != side[i]
        for j in np.flatnonzero(fits) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                root[b] = a
                links.append((groups[i][0], groups[j][0]))
    return links


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, key, text of the rows of docs whose key is in wanted, and a few others: a filter of fixed size before the texts are shuffled. A task sends a text once for each id."""
    mark = F.pmod(F.col("key"), F.lit(MARKS)).cast("int").alias("mark")
    marks = np.zeros(MARKS, bool)
    marks[wanted.select(mark).distinct().toArrow().column(0).to_numpy()] = True  # at most MARKS numbers
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(sent.value).astype(bool), set()
        for batch in batches:
            use = wanted[batch.column(3).to_numpy()]
            for k in np.flatnonzero(use).tolist():
                row = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                use[k] = row not in seen
                seen.add(row)
            if len(seen) > 500_000:
                seen.clear()
            yield batch.filter(pa.array(use)).select(["id", "key", "text"])

    read = docs.select("id", "key", "text")
    return docs.select("id", "key", "text", mark).mapInArrow(run, read.schema)


def verified(docs: DataFrame, nodes: DataFrame, cluster: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the links within each block."""
    # one row of the table for each node
    member = nodes.join(cluster, "node").groupBy("node", "label").agg(F.min(F.struct("id", "key")).alias("at"), F.max("n").alias("n")).select("node", "label", "n", "at.*")
    # classes of size such that similar sets are in the same or in neighbouring ones
    member = cut(member.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")))
    whole = member.groupBy("label").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("all_sets"))
    large = (F.col("all_n") > BLOCK_SHINGLES) | (F.col("all_sets") > BLOCK_SETS)
    total = whole.agg(F.sum("all_n")).first()[0] or 0
    bins = max(1, int(total // (BLOCK_SHINGLES // 2)))
    # large clusters are cut by size class and hash; each pair of parts of fitting classes meets in one block
    cuts = member.join(whole.where(large).select("label"), "label").groupBy("label", "step").agg(F.greatest(F.ceil(F.sum("n") / (BLOCK_SHINGLES // 2)), F.ceil(F.count(F.lit(1)) / (BLOCK_SETS // 2))).alias("cuts"))
    near = lambda d: cuts.select("label", (F.col("step") + d).alias("step"), F.col("cuts").alias({0: "same", 1: "below", -1: "above"}[d]))
    placed = member.join(near(0), ["label", "step"], "left").join(near(1), ["label", "step"], "left").join(near(-1), ["label", "step"], "left")
    part = F.pmod(F.xxhash64("node"), F.col("same"))
    name = lambda *x: F.xxhash64(F.lit("large"), F.col("label"), *x)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    inner = F.transform(upto(F.col("same")), lambda k: F.struct(name(F.col("step"), F.lit(0), F.least(part, k), F.greatest(part, k)).alias("block"), F.when(k == part, 0).when(k > part, 1).otherwise(2).alias("side")))
    up = F.when(F.col("above").isNotNull(), F.transform(upto(F.col("above")), lambda k: F.struct(name(F.col("step"), F.lit(1), part, k).alias("block"), F.lit(1).alias("side"))))
    down = F.when(F.col("below").isNotNull(), F.transform(upto(F.col("below")), lambda k: F.struct(name(F.col("step") - 1, F.lit(1), k, part).alias("block"), F.lit(2).alias("side"))))
    none = F.array().cast("array<struct<block:bigint,side:int>>")
    small = F.array(F.struct(F.pmod(F.xxhash64("label"), F.lit(bins)).alias("block"), F.lit(0).alias("side")))
    places = F.when(F.col("same").isNull(), small).otherwise(F.concat(inner, F.coalesce(up, none), F.coalesce(down, none)))
    wanted = placed.select("id", "key", "node", "label", places.alias("places"))
    found = _marked(docs, member).alias("d").join(wanted.alias("w"), F.col("d.key").eqNullSafe(F.col("w.key")) & F.col("d.id").eqNullSafe(F.col("w.id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            node, label, places = (batch.column(k).to_pylist() for k in (1, 2, 3))
            rows = []
            for k, codes in enumerate(shingle_sets(batch.column(0), memory)):
                if set_id(codes) == node[k]:
                    packed = codes.tobytes()
                    rows += [(p["block"], label[k], p["side"], node[k], packed) for p in places[k]]
            for at in range(0, len(rows), 256):
                part = list(zip(*rows[at : at + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "label", "side", "node", "codes"])

    def verify(part: pa.Table) -> pa.Table:
        by_label: dict[int, list] = {}
        for label, side, node, codes in zip(*(part.column(c).to_pylist() for c in ("label", "side", "node", "codes"))):
            by_label.setdefault(label, []).append((node, np.frombuffer(codes, np.uint64), side, 0))
        links = [x for g in by_label.values() for x in _forest(list({x[0]: x for x in g}.values()))]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    sent = found.select("text", "node", "label", "places").mapInArrow(run, "block long, label long, side int, node long, codes binary")
    return sent.groupBy("block").applyInArrow(verify, "a long, b long")


def _grouped(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, key, row, node, n of every row; and node, first: of every set that is not empty, the first row of its component, null ids last."""
    nodes, sketch = sets_and_sketch(read)
    linked = components(cut(verified(read, nodes, clusters(read, sketch))))
    # a set that is empty links with nothing, not even with another empty one
    own = nodes.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "row")).alias("own"))
    first = linked.join(own, "node").groupBy("label").agg(F.min("own").alias("first"))
    of_node = linked.join(first, "label").select("node", "first")
    return nodes, own.join(of_node, "node", "left").select("node", F.coalesce("first", "own").alias("first"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach, its own included)."""
    nodes, firsts = _grouped(_read(docs, id_column, text_column))
    joined = nodes.join(firsts, "node", "left")
    return joined.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs less near-duplicates: of every component the row with the smallest id (null ids last) stays, of several such rows the first by hashes of text and row, of wholly equal rows one. Texts without words stay."""
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    read = _read(docs, id_column, text_column, row)
    nodes, firsts = _grouped(read)
    same = lambda a, b: F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & F.col(f"{a}.row").eqNullSafe(F.col(f"{b}.row")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))
    stay = firsts.select("first.id", "first.key", "first.row").distinct()
    counted = nodes.where("n > 0").select("id", "key", "row").alias("n").join(stay.alias("s"), same("n", "s"), "left_semi").groupBy("id", "key", "row").agg(F.count(F.lit(1)).alias("times"))
    columns = [F.col(f"d.all.`{c}`").alias(c) for c in docs.columns]
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("key"), row.alias("row"), F.coalesce(F.col(text_column).rlike(WORD_CLASS), F.lit(False)).alias("worded"))
    kept = told.where("worded").alias("d").join(counted.alias("c"), same("d", "c"))
    once = kept.where("c.times = 1").select(*columns)
    several = kept.where("c.times > 1").select("d.all", "d.id", "d.key", "d.row").dropDuplicates(["id", "key", "row"]).alias("d").select(*columns)
    return once.union(several).union(told.where("not worded").alias("d").select(*columns))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), shared AS (SELECT shingle FROM items GROUP BY shingle HAVING count(*) > 1
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN shared USING (shingle) JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.node)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(sets.doc_id, (SELECT min(root) FROM reach WHERE node = sets.doc_id)) AS component_id FROM sets
"""
