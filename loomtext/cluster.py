"""What depends on the cluster: the shared folder for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_AT: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context names; only without one, and in one process (tests), a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at is None and not named.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="loomtext-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at or named.get()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: like cut, but compressed, and later reads take only the columns that they need."""
    path = f"{_AT.get() or shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is kept inside goes when the block ends: for blocks that write their result elsewhere."""
    at = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _AT.set(at)
    try:
        yield
    finally:
        _AT.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
