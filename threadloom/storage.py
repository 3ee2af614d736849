"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_scratch = threading.local()  # its ``open``: of this thread, the folders named in each scratch that is open


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode, and on
    a cluster an error, since a folder of one machine would not be shared."""
    where = spark.conf.get(_KEY, "") or spark.sparkContext.getConf().get(_KEY, "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        where = _own.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="threadloom-")
        _own[spark.sparkContext.applicationId] = where  # the setting itself cannot be changed in a running session
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scratch, "open", None):
        _scratch.open[-1].append(where)
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and what was
    written outlives any executor."""
    where = fresh_dir(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def by_merge(df: DataFrame) -> DataFrame:
    """For the side of a join that grows with the input: it is joined by sort and merge, and the driver never gathers it to broadcast it. The planner
    takes the size of a table's compressed files for the size of the table, which is larger, and larger still when it is hashed."""
    return df.hint("merge")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The folders that :func:`fresh_dir` names inside are deleted at the end: all that is to stay must have been written elsewhere, or read, by then."""
    _scratch.open = [*getattr(_scratch, "open", []), []]
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _scratch.open.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def distilled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written like :func:`materialise`; the tables that it wrote on the way are deleted."""
    where = fresh_dir(spark, name)
    with scratch(spark):
        df = build()
        df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` wrote."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path.getFileSystem(conf).delete(path, True)
