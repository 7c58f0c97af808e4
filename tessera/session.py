"""Session factory: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the results depend on; a cluster's own settings win where none is given here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's checkpoint folder, or a temporary one in local mode."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    return folder


def _checkpoints(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder; later plans read it from there."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the shared folder: for many rows, of which later plans read only the columns and rows that they use."""
    path = f"{_checkpoints(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
