"""Helpers shared by the operators: table access, lineage cuts, tokens and hashes."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words in every operator of this package.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's setting, or a local one where a local session has none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder; later plans read those files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written within frees its shuffle files when it is written; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: The folders of tables that were stored within passing().
_PASSING: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def dropped(spark: SparkSession, path: str) -> None:
    """A folder of this package's own tables goes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within go at its end; what is read from them must have been written by then."""
    token = _PASSING.set([])
    try:
        yield
        for path in _PASSING.get():
            dropped(spark, path)
    finally:
        _PASSING.reset(token)


def stored(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder: smaller than a checkpoint, and later plans read only the columns they use."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    if (tables := _PASSING.get()) is not None:
        tables.append(path)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs_of_texts(texts: pa.Array, limit: int = 2_000_000) -> Iterator[pa.Array]:
    """Runs of texts of about `limit` bytes at most, so that memory follows the longest text and not the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The A-Z lower-cased words of all texts in a row, as places in a list of the distinct ones; how many each text has; that list."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(split.flatten())
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in words:  # before and behind the space around a text
        none = words.index(b"")
        real = at != none
        counted = np.concatenate([[0], np.cumsum(real)])
        ends = np.cumsum(sizes)
        sizes, at = counted[ends] - counted[ends - sizes], at[real]
    return at, sizes, words


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
