"""Tables on the way of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one is made on a single machine (tests); on a cluster
    that is an error, as executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Tables written inside a ``scratch`` block of the same thread.
_scratch: ContextVar[list[str] | None] = ContextVar("gate_scratch", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table in the shared folder: they are worked out once, and outlive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if (held := _scratch.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside, by this thread, is removed at the end; nothing is to be computed from it any more."""
    mine: list[str] = []
    outer = _scratch.set(mine)
    try:
        yield
    finally:
        _scratch.reset(outer)
        for path in mine:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path_of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path_of, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = path_of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path_of)] if fs.exists(path_of) else []
